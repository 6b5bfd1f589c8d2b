"""Descent queries keep what one task holds bounded: no side that grows with the input is sent whole to all tasks, and rows fan out after they are dealt."""

import pytest

from glyphweave.plans import driver_queries as dq, operator_queries as oq


@pytest.mark.parametrize("query", [dq.redundant_edge_cleanup, oq.descent_rerouted])
def test_no_side_is_broadcast(spark, tmp_path, query):
    spark.createDataFrame([(k, k % 7) for k in range(30)], "p_partkey long, p_size int").write.parquet(f"file://{tmp_path}/part.parquet")
    df = query(spark, f"file://{tmp_path}")
    assert df.count() >= 30
    df.collect()
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
