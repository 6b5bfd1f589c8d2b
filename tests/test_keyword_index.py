"""The keyword index gives what a scan gives, and reads less."""

import random

import pytest

from glyphweave.operators import graph as g, keyword_index as ki

SCHEMA = "network_id string, network_ord long, node_ord long, id string, form string, meanings array<string>"


def nodes(seed, n):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice("abcÀéσ ") for _ in range(k))
    out = [(f"net{k % (n // 4)}", k % (n // 4), k, f"id{k}", word(r.randrange(7)), [word(r.randrange(9)) for _ in range(r.randrange(3))]) for k in range(n)]
    return out + [("netX", 9000, 1, "x", None, None), ("netX", 9000, 0, "y", "", []), ("netY", 9001, 0, "z", "ab", ["A long ABC meaning", "second"])]


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("slice_", [3, 4096])
def test_same_rows_as_the_scan(spark, tmp_path, slice_):
    df = spark.createDataFrame(nodes(1, 200), SCHEMA).repartition(3)
    path = f"file://{tmp_path}/index"
    ki.build(df, path, slice_)
    for query in ("ab", "AB", "é ", "abc", "ÀÉ", "cab", "long abc", "g s", "σ", "", "nowhere", "zz", "a  b", "meaning second", "ab a", "\u0000b"):
        assert rows(ki.search(spark, path, query, slice_=slice_)) == rows(g.keyword_search(df, query)), query
    assert rows(ki.search(spark, path, "ab", most=3, slice_=slice_)) == rows(g.keyword_search(df, "ab", most=3))


def test_no_nodes(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    ki.build(spark.createDataFrame([], SCHEMA), path)
    assert rows(ki.search(spark, path, "abc")) == []


def test_a_rare_query_reads_little(spark, tmp_path):
    """Rows that the scans give, by Spark's own count: pages without the grams, and slices without a candidate, are skipped."""
    n = 20_000
    df = spark.range(n).selectExpr("concat('net', id) as network_id", "id as network_ord", "0L as node_ord", "cast(id as string) as id", "substr(md5(cast(id as string)), 1, 6) as form", "array(concat(md5(cast(id as string)), case when id = 777 then ' needle in it' else '' end)) as meanings")
    path = f"file://{tmp_path}/index"
    ki.build(df, path, 256)
    postings = spark.read.parquet(f"{path}/postings").count()
    store = spark.sparkContext._jsc.sc().statusStore()
    before = {s.stageId() for s in _stages(store)}
    found = ki.search(spark, path, "needle", slice_=256)
    assert [r.network_ord for r in found.collect()] == [777]
    read = sum(s.inputRecords() for s in _stages(store) if s.stageId() not in before)
    print(f"{read} rows read, of {postings} postings and {n} texts")
    assert read < postings / 5 and "PushedFilters" in _explained(found)


def _explained(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def _stages(store):
    from pyspark import SparkContext

    listed = store.stageList(None, False, False, SparkContext._gateway.new_array(SparkContext._jvm.double, 0), None)
    return [listed.apply(k) for k in range(listed.size())]
