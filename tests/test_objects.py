"""Objects of objects in files of any size, by byte ranges."""

import json
import random

from pyspark.sql import functions as F

from glyphweave.session import settings
from glyphweave.sources import objects

VALUE = "struct<a:string,b:array<string>,c:struct<d:string>,n:int>"


def sample(n, seed=0):
    r = random.Random(seed)
    text = lambda: "".join(r.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "é", "\U00013000", "\n", " ", "x"]) for _ in range(r.randrange(30)))
    return {f"k{i}" if i % 9 else text() + str(i): {"a": text(), "b": [text() for _ in range(r.randrange(3))], "c": {"d": text()}, "n": i} for i in range(n)}


def want(data):
    return {k: (v["a"], tuple(v["b"]), v["c"]["d"], v["n"]) for k, v in data.items()}


def got(df):
    rows = df.orderBy("file", "ord").collect()
    return [r.key for r in rows], {r.key: (r.value.a, tuple(r.value.b), r.value.c.d, r.value.n) for r in rows}


def test_a_file_of_many_ranges(spark, tmp_path):
    data = sample(800)
    forms = {"one line": json.dumps(data, ensure_ascii=False), "escaped": json.dumps(data), "indented": json.dumps(data, ensure_ascii=False, indent=2) + "\n"}
    for name, text in forms.items():
        path = tmp_path / f"{name.replace(' ', '-')}.json"
        path.write_text(text)
        with settings(spark, {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1"}):
            df = objects.read_objects(spark, f"file://{path}", VALUE)
            assert objects._ranges(spark, f"file://{path}").rdd.getNumPartitions() > 8
            keys, rows = got(df)
        assert rows == want(data) and keys == list(data)


def test_odd_objects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"x": {"a": "1"}, "y": {"a": "2"}, "x": {"a": "3"}}')  # the last value counts, at the first place
    (tmp_path / "in/b.json").write_text('{}\n{"z":{"a":null,"n":7}}{"x":{"a":"other file"}}\n')
    (tmp_path / "in/c.json").write_text("")
    (tmp_path / "in/d.json").write_text('  {"only": {"a": "}"}}  \n\n')
    rows = objects.read_objects(spark, f"file://{tmp_path}/in", VALUE).orderBy("file", "ord").collect()
    assert [(r.file[-6], r.key, r.value.a, r.value.n) for r in rows] == [("a", "x", "3", None), ("a", "y", "2", None), ("b", "z", None, 7), ("b", "x", "other file", None), ("d", "only", "}", None)]


def test_written_and_read_again(spark, tmp_path):
    data = sample(200, 3)
    df = spark.createDataFrame([(k, (v["a"], v["b"], (v["c"]["d"],), v["n"])) for k, v in data.items()], f"key string, value {VALUE}").repartition(3)
    path = f"file://{tmp_path}/out"
    objects.write_objects(df, path)
    assert got(objects.read_objects(spark, path, VALUE))[1] == want(data)
    whole = [json.loads(f.read_text().rstrip(",")) for f in (tmp_path / "out").glob("part-*") if f.stat().st_size]
    assert {k: v["n"] for part in whole for k, v in part.items()} == {k: v["n"] for k, v in data.items()} and len(whole) == 3
    objects.write_objects(df.where(F.lit(False)), path)
    assert objects.read_objects(spark, path, VALUE).count() == 0


def test_partitions_without_rows(spark, tmp_path):
    """A split without a row group, as a file of one row group has when it is read in several, is written as no object."""
    df = spark.createDataFrame([(f"k{i}", ("}", [], ("{",), i)) for i in range(40)], f"key string, value {VALUE}").coalesce(1)
    df.write.parquet(f"file://{tmp_path}/in")
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}):
        split = spark.read.parquet(f"file://{tmp_path}/in")
        assert split.rdd.getNumPartitions() > 2
        objects.write_objects(split, f"file://{tmp_path}/out")
    assert sorted(objects.read_objects(spark, f"file://{tmp_path}/out", VALUE).select("value.n").toPandas()["n"]) == list(range(40))
