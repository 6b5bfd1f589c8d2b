"""Networks move their rows few times: what is shuffled grows with the rows, and nothing is worked out twice."""

from glyphweave.operators import networks as nw, passes
from glyphweave.operators.networks import NODE
from glyphweave.plans import network_queries as nq, operator_queries as oq
from glyphweave.session import cut
from glyphweave.sources import ingest


def _parts(spark, tmp_path):
    spark.createDataFrame([(k,) for k in range(12)], "p_partkey long").write.parquet(f"file://{tmp_path}/part.parquet")
    return cut(oq._senses(spark, f"file://{tmp_path}"))


def test_nodes_are_settled_in_one_shuffle(spark, tmp_path):
    senses = _parts(spark, tmp_path)
    nodes = nw.settled_nodes(cut(nw._candidates(senses)[0]))
    nodes.collect()
    plan = nodes._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(nw.network_nodes(senses)) == rows(nw.build_networks(senses)[1].select(*NODE))


def test_nested_export_is_the_export_nested(spark, tmp_path):
    built = nw.build_networks(_parts(spark, tmp_path))
    built = (built[0], cut(built[1]), built[2])
    rows = lambda df: sorted(map(str, df.collect()))
    nested = nw.nested_export(*built)
    assert rows(nested.select("network_id", "root_lemma", "root_language", "root_etymology_index", "nodes", "edges")) == rows(ingest.nested_networks(*nw.export_ids(*built)).select("network_id", "root_lemma", "root_language", "root_etymology_index", "nodes", "edges"))
    ids = [n["id"] for r in sorted(nested.select("network_id", "nodes").collect()) for n in r["nodes"]]
    assert sorted(ids) == [f"N{k:05d}" for k in range(1, len(ids) + 1)]
    assert {e[k] for r in nested.select("edges").collect() for e in r["edges"] for k in ("from", "to")} <= set(ids)


def test_older_nodes_alone(spark, tmp_path, monkeypatch):
    """The older builder's nodes don't wait for its edges to be merged and rerouted, and are the same."""
    spark.createDataFrame([(k,) for k in range(12)], "p_partkey long").write.parquet(f"file://{tmp_path}/part.parquet")
    senses = cut(nq._older(spark, f"file://{tmp_path}"))
    rows = lambda df: sorted(map(str, df.select("network_id", "id", "moment", "late", *passes.VALUES).collect()))
    whole = rows(passes.older_networks(senses).nodes)
    monkeypatch.setattr(passes, "reroute", None)
    assert rows(passes.older_nodes(senses)) == whole
