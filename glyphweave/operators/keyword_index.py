"""Substring search over network nodes by postings of three-letter runs.

The index has three tables. postings: (gram, network_ord, node_ord), ranged and sorted by gram, so that a gram's rows lie in few row groups
and the filter on it, pushed to the scan, skips all others. grams: how many nodes each has. texts: what a node is searched in, in slices of
networks. A query takes its rarest grams, meets their postings, and reads and verifies the texts of the slices that are left. A field ends
in a mark, so that each run of two letters starts a gram, and queries of two letters are a range of grams.

Networks are numbered by network_ord, nodes within them by node_ord. Nulls are empty texts; a query of less than two letters finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

POSTINGS, GRAMS = "network_ord long, node_ord long, gram string", "gram string, n long"
TEXTS = "network_ord long, network_id string, node_ord long, id string, form string, in_form string, in_meanings string, n_nodes long, slice long"
END = "\u0000"
#: Networks of a slice of texts; grams of a query that are met with each other.
SLICE, MET = 4096, 4


def _grams(text: Column) -> Column:
    """The distinct runs of three letters of a text and its end mark."""
    full = F.concat(text, F.lit(END))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(full) - 2, F.lit(1))), lambda i: F.substring(full, i, F.lit(3))))


def build(nodes: DataFrame, path: str, slice_: int = SLICE) -> None:
    """Write the index of nodes (network_id, network_ord, node_ord, id, form, meanings) to a folder that all executors share."""
    fields = nodes.select("network_id", *[F.col(c).cast("long").alias(c) for c in ("network_ord", "node_ord")], F.col("id").cast("string").alias("id"), "form", F.coalesce(F.lower("form"), F.lit("")).alias("in_form"), F.coalesce(F.lower(F.array_join("meanings", " ")), F.lit("")).alias("in_meanings"))
    n = nodes.groupBy("network_ord").agg(F.count("*").alias("n_nodes"))
    texts = fields.join(n, "network_ord").withColumn("slice", F.floor(F.col("network_ord") / slice_))
    texts.repartitionByRange("slice", "network_ord").sortWithinPartitions("slice", "network_ord").write.mode("overwrite").partitionBy("slice").parquet(f"{path}/texts")
    each = fields.select("network_ord", "node_ord", F.explode(F.array_distinct(F.concat(_grams(F.col("in_form")), _grams(F.col("in_meanings"))))).alias("gram"))
    each.repartitionByRange("gram", "network_ord").sortWithinPartitions("gram", "network_ord", "node_ord").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
    spark = nodes.sparkSession
    counts = spark.read.schema(POSTINGS).parquet(f"{path}/postings").groupBy("gram").agg(F.count("*").alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/grams")


def _candidates(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """(network_ord, node_ord) of nodes that may hold the query; None if a gram of it is nowhere."""
    postings = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    if len(query) == 2:
        return postings.where(F.col("gram").startswith(query)).select("network_ord", "node_ord").distinct()
    grams = sorted({query[i : i + 3] for i in range(len(query) - 2)})
    known = {r.gram: r.n for r in spark.read.schema(GRAMS).parquet(f"{path}/grams").where(F.col("gram").isin(*grams)).collect()}  # a row for each gram of the query
    if len(known) < len(grams):
        return None
    rare = sorted(grams, key=lambda g: (known[g], g))[:MET]
    return postings.where(F.col("gram").isin(*rare)).groupBy("network_ord", "node_ord").agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).drop("n")


def search(spark: SparkSession, path: str, query: str, most: int = 50, slice_: int = SLICE) -> DataFrame:
    """The rows of graph.keyword_search(), by the index at path."""
    q = query.lower()
    texts = spark.read.schema(TEXTS).parquet(f"{path}/texts")
    found = _candidates(spark, path, q) if len(q) >= 2 else None
    if found is None:
        found = texts.limit(0).select("network_ord", "node_ord")
    found = found.withColumn("slice", F.floor(F.col("network_ord") / slice_))
    rows = texts.join(found, ["slice", "network_ord", "node_ord"])
    hits = rows.where(F.col("in_form").contains(q) | F.col("in_meanings").contains(q))
    first = hits.groupBy("network_id", "network_ord", "n_nodes").agg(F.min_by(F.struct("id", "form", "in_form"), "node_ord").alias("x")).orderBy("network_ord").limit(most)
    return first.select("network_id", "network_ord", "x.id", "x.form", "n_nodes", (F.col("x.in_form") == q).alias("exact")).orderBy(F.desc("exact"), F.desc("n_nodes"), "network_ord")
