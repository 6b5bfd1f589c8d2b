"""Queries over keys beyond those of the small tables."""

from glyphweave.plans import operator_queries as oq


def test_forms_own_terms(spark, tmp_path):
    """Lemmas of both kinds stay apart where part keys go beyond a million."""
    keys = [0, 2, 4, 1_000_000, 1_000_002, 1_000_004]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"file://{tmp_path}/part.parquet")
    rows = oq.forms_own_terms(spark, f"file://{tmp_path}").collect()
    assert sorted((r.lemma_ord, r.chain) for r in rows) == [(k, f"m{k}|v{k}|z{k}") for k in keys]
