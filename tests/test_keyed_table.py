"""Keyed tables in buckets: what a batch writes, crashes, two writers, versions (K1, K2)."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from glyphweave.sources import shared_files
from glyphweave.sources.keyed_table import KeyedTable

SCHEMA = "k long, v long, x string"


@pytest.fixture
def made(spark, tmp_path):
    return KeyedTable.make(spark, f"file://{tmp_path}/table", spark.createDataFrame([], SCHEMA).schema, ["k"], "v", buckets=16)


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def content(t, version=None):
    return {r.k: (r.v, r.x) for r in t.read(version).collect()}


def test_newest_of_each_key(spark, made):
    assert content(made) == {} and made.upsert(rows(spark)) == 0
    assert made.upsert(rows(spark, (1, 1, "a"), (1, 3, "c"), (None, 1, "none"))) == 1
    assert made.upsert(rows(spark, (1, 2, "b"), (2, 1, "d"), (None, 1, "tie"))) == 2
    assert content(made) == {1: (3, "c"), 2: (1, "d"), None: (1, "tie")} and content(made, 1) == {1: (3, "c"), None: (1, "none")}
    before = content(made)
    made.upsert(rows(spark, (1, 2, "b"), (2, 1, "d"), (None, 1, "tie")))
    assert content(made) == before
    assert [(r.k, r.x) for r in made.get(rows(spark, (2, 0, ""), (9, 0, ""))).collect()] == [(2, "d")]


def test_bytes_written_follow_the_batch(spark, made, tmp_path):
    made.upsert(spark.range(20000).selectExpr("id as k", "0L as v", "repeat(md5(cast(id as string)), 4) as x"))
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "table/data").rglob("*.parquet"))
    whole, old = size(), made.state()["files"]
    made.upsert(rows(spark, (7, 1, "new")))
    assert size() - whole < whole / 8
    assert sum(old[b] != now for b, now in made.state()["files"].items()) == 1
    assert made.read().count() == 20000 and content(made)[7] == (1, "new")


def test_a_writer_that_dies_leaves_nothing_in_sight(spark, made, monkeypatch):
    made.upsert(rows(spark, (1, 1, "a")))
    with monkeypatch.context() as m:  # dies after its data, before its manifest
        m.setattr(KeyedTable, "_switch", lambda *_: (_ for _ in ()).throw(SystemExit))
        with pytest.raises(SystemExit):
            made.upsert(rows(spark, (1, 2, "lost"), (2, 1, "lost")))
    assert content(made) == {1: (1, "a")}
    fs_names = shared_files.names(spark, f"{made.path}/data")
    assert len(fs_names) == 2
    made.upsert(rows(spark, (2, 1, "b")))
    assert content(made) == {1: (1, "a"), 2: (1, "b")} and len(made.vacuum()) == 1
    assert content(made) == {1: (1, "a"), 2: (1, "b")} and made.versions() == [2]
    with pytest.raises(LookupError):
        made.read(1)


def test_a_half_written_manifest_is_not_read(spark, made, tmp_path):
    made.upsert(rows(spark, (1, 1, "a")))
    (tmp_path / "table/manifest/.v2.json-abc").write_text('{"version"')
    assert content(made) == {1: (1, "a")} and made.upsert(rows(spark, (2, 1, "b"))) == 2


def test_of_two_writers_the_loser_tries_again(spark, made):
    made.upsert(rows(spark, *[(k, 0, "start") for k in range(50)]))
    seen = []

    def write(turn):
        seen.append(KeyedTable(spark, made.path).upsert(rows(spark, *[(k, turn, f"w{turn}") for k in range(turn, 50, 2)])))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, [1, 2, 3, 4]))
    assert sorted(seen) == [2, 3, 4, 5]
    want = {k: max([(t, f"w{t}") for t in (1, 2, 3, 4) if k >= t and (k - t) % 2 == 0], default=(0, "start")) for k in range(50)}
    assert content(made) == want


def test_a_loser_keeps_its_work_if_its_buckets_were_left_alone(spark, made, monkeypatch):
    made.upsert(rows(spark, *[(k, 0, "start") for k in range(200)]))
    bucket = {k: b for k, b in made._dealt(made.read(), made.state()).select("k", "__bucket").collect()}
    other = next(k for k in bucket if bucket[k] != bucket[0])
    real, writes, wrote = KeyedTable._switch, [], KeyedTable._write

    def late(self, state):
        if "other" not in writes:
            writes.append("other")
            monkeypatch.setattr(KeyedTable, "_switch", real)
            KeyedTable(spark, made.path).upsert(rows(spark, (other, 1, "theirs")))
        return real(self, state)

    monkeypatch.setattr(KeyedTable, "_switch", late)
    monkeypatch.setattr(KeyedTable, "_write", lambda self, df: writes.append("w") or wrote(self, df))
    made.upsert(rows(spark, (0, 1, "mine")))
    assert content(made)[0] == (1, "mine") and content(made)[other] == (1, "theirs") and writes.count("w") == 2


def test_append_keeps_every_row(spark, made):
    made.append(rows(spark, (1, 1, "a"), (1, 1, "a")))
    made.append(rows(spark, (1, 1, "a"), (2, 2, "b")))
    assert sorted((r.k, r.x) for r in made.read().collect()) == [(1, "a"), (1, "a"), (1, "a"), (2, "b")]
    made.upsert(rows(spark, (1, 0, "older")))
    assert content(made) == {1: (1, "a"), 2: (2, "b")} and made.read().count() == 2


def test_what_is_there_keeps_its_settings(spark, made):
    made.upsert(rows(spark, (1, 1, "a")))
    again = KeyedTable.make(spark, made.path, made.read().schema, ["x"], "v", buckets=3)
    assert again.state()["buckets"] == 16 and content(again) == {1: (1, "a")}
    with pytest.raises(ValueError):
        KeyedTable.make(spark, made.path + "2", made.read().schema, ["nothing"], "v")


def test_a_stream_of_upserts(spark, tmp_path):
    from glyphweave.streaming import upserts

    src, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    for turn, part in enumerate(([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c")])):
        rows(spark, *part).coalesce(1).write.mode("append").parquet(src)
        upserts.upsert_keyed(stream, out, ["k"], "v", str(tmp_path / "cp")).awaitTermination()
        assert KeyedTable(spark, out).versions()[-1] == turn + 1
    assert content(KeyedTable(spark, out)) == {1: (2, "c"), 2: (1, "b")}
