"""Category listings as a data source: whole lists, faults, a stream that is stopped and goes on."""

import json
import os
from collections import Counter

import pytest

from glyphweave.sources.category_source import CategoryMembers


def options(folder, categories, **more):
    names = [f"{folder}|{n}|{many}|{faults}" for n, many, faults in categories]
    return {"categories": json.dumps(names), "get": "tests.site:get", "wait": "0", "limit": "3"} | more


def want(categories):
    return sorted((n, k // 3, f"{n}{k}") for n, many, _ in categories for k in range(many) if k % 4)


def rows(df):
    return sorted((r.category.split("|")[1], r.page, r.title) for r in df.collect())


def calls(folder):
    return Counter(tuple(f.split("-")[1:3]) for f in os.listdir(folder) if f.startswith("call-"))


def test_whole_lists(spark, tmp_path):
    spark.dataSource.register(CategoryMembers)
    categories = [("a", 10, 0), ("b", 3, 2), ("c", 0, 0), ("d", 1, 0)]
    df = spark.read.format("category_members").options(**options(tmp_path, categories)).load()
    assert df.rdd.getNumPartitions() == 4 and rows(df) == want(categories)


def test_tries_are_bounded_and_statuses_checked(spark, tmp_path):
    spark.dataSource.register(CategoryMembers)
    for more, said in (({"retries": "2"}, "no answer"), ({"get": "tests.site:with_status", "retries": "1"}, "503: busy")):
        df = spark.read.format("category_members").options(**options(tmp_path, [("a", 3, 9)], **more)).load()
        with pytest.raises(Exception, match=said):
            df.collect()
    with pytest.raises(Exception, match="twice"):
        spark.read.format("category_members").options(**options(tmp_path, [("a", 3, 0), ("a", 3, 0)])).load().collect()


def test_a_stream_that_is_stopped_goes_on_without_a_double(spark, tmp_path):
    spark.dataSource.register(CategoryMembers)
    calls_in, out, cp = tmp_path / "calls", str(tmp_path / "out"), str(tmp_path / "cp")
    calls_in.mkdir()
    categories = [("a", 10, 0), ("b", 4, 1), ("c", 0, 0)]
    made = options(calls_in, categories, progress=f"file://{tmp_path}/progress")

    def start():
        stream = spark.readStream.format("category_members").options(**made).load()
        return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp)

    start().trigger(availableNow=True).start().awaitTermination()  # one page of each
    assert rows(spark.read.parquet(out)) == [x for x in want(categories) if x[1] == 0]
    query = start().start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.read.parquet(out)) == want(categories)
    assert {k: n for k, n in calls(calls_in).items()} == {("a", "0"): 1, ("a", "3"): 1, ("a", "6"): 1, ("a", "9"): 1, ("b", "0"): 2, ("b", "3"): 2, ("c", "0"): 1}
    query = start().start()  # nothing is left
    query.processAllAvailable()
    query.stop()
    assert rows(spark.read.parquet(out)) == want(categories) and sum(calls(calls_in).values()) == 9


def test_a_batch_that_failed_is_read_again(spark, tmp_path):
    spark.dataSource.register(CategoryMembers)
    calls_in, cp = tmp_path / "calls", str(tmp_path / "cp")
    calls_in.mkdir()
    categories = [("a", 7, 0)]
    made = options(calls_in, categories, progress=f"file://{tmp_path}/progress")
    kept, dead = [], []

    def take(df, batch):
        got = rows(df)
        if batch == 1 and not dead:
            dead.append(batch)
            raise RuntimeError("the sink died after the page was read")
        kept.extend(got)

    def run():
        query = spark.readStream.format("category_members").options(**made).load().writeStream.foreachBatch(take).option("checkpointLocation", cp).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    with pytest.raises(Exception, match="sink died"):
        run()
    run()
    assert sorted(kept) == want(categories)
