"""Pages to blocks as a stream (S10); nested trees for export and back (M7d)."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from glyphweave.operators import trees, wikitext as wt
from glyphweave.session import cut
from glyphweave.sources import ingest, objects
from glyphweave.streaming import blocks

PAGES = "book string, page int, text string"


def books(seed):
    r = random.Random(seed)
    return [(b, p, r.choice(["a [x] b", "end {A1}", " odd } x", "{B}  ", "", None, "} ", "word"])) for b in ("one", "two", "three") for p in range(1, 40)]


def stream_of(spark, parts, tmp_path, patience_ms=3000):
    src = tmp_path / "in"
    src.mkdir()
    for k, part in enumerate(parts):
        spark.createDataFrame(part, PAGES).coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(0.05)
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(str(src))
    got = []
    query = blocks.block_stream(pages, 5, patience_ms=patience_ms).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    return query, got


@pytest.mark.parametrize("shuffled", [False, True])
def test_blocks_of_any_cut(spark, tmp_path, shuffled):
    rows = books(1)
    r = random.Random(2)
    if shuffled:
        r.shuffle(rows)
    else:
        rows.sort(key=lambda x: x[1])
    cuts = sorted(r.sample(range(1, len(rows)), 4))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    df = spark.createDataFrame(rows, PAGES).withColumn("text", F.coalesce("text", F.lit("")))
    want = sorted((x.book, x.block, x.page, x.text) for x in ingest.accumulate_pages(df).collect())
    query, got = stream_of(spark, parts, tmp_path)
    try:
        until = time.time() + 120
        while len(got) < len(want) and time.time() < until:
            assert query.isActive, query.exception()
            time.sleep(0.5)
    finally:
        query.stop()
    assert sorted((x.book, x.block, x.page, x.text) for x in got) == want


def test_a_page_after_its_turn_is_an_error(spark, tmp_path):
    query, _ = stream_of(spark, [[("one", 5, "a"), ("one", 6, "b")], [("one", 5, "again")]], tmp_path, 600_000)
    with pytest.raises(Exception, match="after its turn"):
        query.processAllAvailable()


def nest(flat):
    """Plainly: (language, word, level, children)."""
    below = {}
    for x in reversed(flat):
        node = {"language": x[3], "word": x[4], "level": x[2], "children": below.pop(x[0], [])}
        below.setdefault(x[1], []).insert(0, node)
    return below.get(None, [])


def test_flat_to_nested_and_back(spark):
    r = random.Random(4)
    lists = [[]]
    for n in (1, 2, 30, 60):
        flat = []
        for k in range(n):
            up = r.choice([None, *range(k)][-6:]) if k else None
            flat.append((k, up, 0 if up is None else flat[up][2] + 1, r.choice(["cop", "dem", ""]), r.choice(['w"', "ⲁ\\", "x,]", "plain"]) + str(k)))
        lists.append(flat)
    df = spark.createDataFrame([(k, x) for k, x in enumerate([*lists, None])], f"k int, d {trees.FLAT}").withColumn("tree", trees.nested(F.col("d")))
    df = cut(df)
    rows = df.select("k", "d", F.to_json("tree").alias("tree"), trees.flat(F.col("tree")).alias("again")).orderBy("k").collect()
    flat_again = cut(df.select("k", trees.flat(F.col("tree")).alias("f")))
    again = flat_again.select("k", trees.nested(F.col("f")).alias("t")).select("k", F.to_json("t").alias("t")).orderBy("k").collect()
    for r_, a, flat in zip(rows, again, lists, strict=False):
        assert json.loads(r_.tree) == nest(flat) and json.loads(a.t) == json.loads(r_.tree)
        assert nest([tuple(x) for x in r_.again]) == nest(flat)
    assert rows[-1].tree is None and rows[-1].again is None


def test_pages_leave_as_objects_with_trees(spark, tmp_path):
    text = "==Coptic==\n===Etymology===\nx\n===Noun===\n# {{l|cop|\"m\"}} and } more\n====Descendants====\n* {{desc|ar|a|b}}\n** {{desc|en|c}}\n* {{desc|fr|d}}"
    parsed = wt.parse_pages(spark.createDataFrame([(k, f"w{k}", "Coptic", text) for k in range(7)], "lemma_ord long, title string, language string, full_wikitext string"))
    path = f"file://{tmp_path}/out"
    objects.write_objects(wt.nested_pages(parsed).repartition(2), path)
    back = objects.read_objects(spark, path, "struct<lemma_ord:long,etymologies:array<struct<etymology_text:string,definitions:array<struct<part_of_speech:string,definitions:array<string>,descendants:variant>>>>>")
    d = F.col("value.etymologies")[0]["definitions"][0]
    rows = back.select("key", d["definitions"].alias("m"), F.to_json(d["descendants"]).alias("t"), F.size(trees.flat(d["descendants"])).alias("n")).orderBy("key").collect()
    assert [r.key for r in rows] == [f"w{k}" for k in range(7)] and all(r.n == 4 for r in rows)
    leaf = lambda lang, word, level, *below: {"language": lang, "word": word, "level": level, "children": list(below)}
    assert json.loads(rows[0].t) == [leaf("ar", "a", 0, leaf("en", "c", 1)), leaf("ar", "b", 0), leaf("fr", "d", 0)]
