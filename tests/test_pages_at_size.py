"""Pages are dealt into parts of bounded size and parsed once."""

from pyspark.sql import functions as F

from glyphweave.operators import networks, wikitext as w
from glyphweave.plans import operator_queries as oq


def _parsers(df):
    return df._jdf.queryExecution().executedPlan().toString().count("MapIn")


def test_parts_follow_the_rows(spark):
    rows = spark.range(5000)
    assert w.deal(rows, "id", parts=2, most=500).rdd.getNumPartitions() == 10 and w.deal(rows, "id", parts=2).rdd.getNumPartitions() == 2
    pages = rows.where("id < 10").select(F.col("id").alias("lemma_ord"), F.lit("x").alias("title"), F.lit("Coptic").alias("language"), F.lit("==Coptic==\n===Noun===\n# m").alias("full_wikitext"))
    assert [r.n for r in w.parse_pages(pages, 3).select(F.size("etymologies").alias("n")).collect()] == [1] * 10


def test_pages_are_parsed_once(spark, tmp_path):
    spark.createDataFrame([(k, "hot bolt", "Brand#1", "SMALL", 3) for k in range(9)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"file://{tmp_path}/part.parquet")
    origins = oq.page_origins(spark, f"file://{tmp_path}")
    assert _parsers(origins) == 1 and origins.count() == 36
    lost = networks.orphans(oq._senses(spark, f"file://{tmp_path}"))
    assert _parsers(lost) == 0 and {(r.language, r.lemma, r.root) for r in lost.collect()} == {("cop", f"q{k}", f"nowhere{k}") for k in (2, 5, 8)}
