import collections
import random

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from glyphweave.llm import embedding, queries
from tests.llm import helpers as h

SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def plain(rows, cos):
    ok = {}
    for k, (i, v, label, _) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            u = np.array(v, np.float32).astype(float)
            ok[k] = (label, u / np.linalg.norm(u))
    links = [(a, b) for a in ok for b in ok if a < b and ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] >= cos]
    n = collections.Counter(x for p in links for x in p)
    comp = h.components(range(len(rows)), links)
    low = {}
    for k, c in comp.items():
        low[c] = min(low.get(c, rows[k][0]), rows[k][0])
    return sorted((rows[k][0], n[k], low[comp[k]]) for k in range(len(rows)))


@pytest.mark.parametrize("size", [12, 3])
def test_embeddings(spark, size):
    r = np.random.default_rng(size)
    rows = []
    for i in range(250):
        base = r.standard_normal(size)
        rows.append((i, base.tolist(), int(r.integers(3)), "x"))
        if i % 5 == 0:
            rows.append((1000 + i, (base * 3 + r.standard_normal(size) * 0.15).tolist(), rows[-1][2], "x"))
        if i % 40 == 0:
            rows += [(2000 + i + k, base.tolist(), rows[-1][2], None) for k in range(4)]
    rows += [(5000, None, 1, "x"), (5001, [0.0] * size, 1, "x"), (5002, [1.0, float("nan"), *[0.0] * (size - 2)], 1, "x"), (5003, [None, *[1.0] * (size - 1)], 1, "x"), (5004, rows[0][1], None, "x"), (5005, [], 1, "x"), (5006, [1.0, 2.0], 1, "x"), (5007, [float("inf"), *[0.0] * (size - 1)], 1, "x"), (5008, [1e-30 * x for x in rows[0][1]], rows[0][2], "x")]
    got = embedding.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((x.vec_id, x.n_links, x.component_id) for x in got) == plain(rows, 0.98)
    assert all(x.kept == (x.vec_id == x.component_id) for x in got)


def test_embeddings_empty(spark):
    assert embedding.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stages(spark, tmp_path):
    """Each stage on its own input: columns, what it keeps, and the last stage's pieces."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmno") for _ in range(r.randrange(2, 9)))
    clean = ["\n".join(" ".join(word() for _ in range(r.randrange(15, 40))) for _ in range(r.randrange(2, 6))) for _ in range(150)]
    rows = [(i, t, "en", f"s{i % 3}", len(t), "x") for i, t in enumerate(clean)]
    near = clean[5].split(" ")
    near[10] = "other"
    rows += [(500, clean[4], "en", "s0", 1, "x"), (501, " ".join(near), "en", "s1", 1, "x"), (502, " ".join(w + "%%%" for w in clean[7].split(" ")), "en", "s1", 1, "x"), (503, None, "en", None, 0, "x"), (504, "too short", None, "s1", 9, "x"), rows[8]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram jaccard join", "mixing", "best-fit packing"]
    kept = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        seen.append(collections.Counter(x.doc_id for x in kept.collect()))
    assert set(range(150)) <= set(seen[0]) and not {502, 503, 504} & set(seen[0])
    assert set(seen[2]) == set(range(150)) and seen[2][8] == 2  # a repeated row is one document
    assert 0 < len(seen[3]) <= 150 and max(seen[3].values()) <= 4
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(x.doc_id for x in out) == seen[3] and all(x.piece == 0 for x in out)
    none = corpus_pipeline.STAGES[0][1](spark, docs.limit(0), "")
    for _, stage in corpus_pipeline.STAGES[1:]:
        none = stage(spark, none, "")
    assert none.count() == 0


def test_queries_are_named():
    assert [k.split("_")[0] for k in queries.QUERIES] and {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in queries.QUERIES}
    assert public_tokenizers.path("word_bpe_49k.json")


def test_embeddings_clashing_columns(spark):
    """Other columns with names that the operator uses inside; a null vec_id is never the smallest while another is there."""
    rows = [(k, [1.0, 0.1 * (k % 3), 0.5], 1, "x", 2, 3, "y", [0.0]) for k in range(6)] + [(None, [1.0, 0.0, 0.5], 1, "x", 2, 3, "y", None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string, weight int, dim int, block string, at array<double>")
    got = embedding.near_duplicates(df).collect()
    assert len(got) == 7 and all(x.component_id is not None for x in got)
    assert sorted((x.vec_id if x.vec_id is not None else -1, x.n_links, x.component_id) for x in got) == sorted((i if i is not None else -1, n, c) for i, n, c in ((i, n, c) for i, n, c in _with_null(rows)))


def _with_null(rows):
    last = 10**9
    plain_rows = plain([(r[0] if r[0] is not None else last, r[1], r[2], None) for r in rows], 0.98)
    return [(None if i == last else i, n, c) for i, n, c in plain_rows]


@pytest.mark.parametrize("label_type", ["string", "long"])
def test_embeddings_many_blocks(spark, label_type, monkeypatch):
    """Several levels of intervals: small blocks, clusters and scattered vectors, one label in nine tenths of the rows."""
    monkeypatch.setattr(embedding, "BLOCK", 16)
    r = np.random.default_rng(4)
    rows, centres = [], r.standard_normal((30, 8))
    for i in range(900):
        v = centres[i % 30] + r.standard_normal(8) * 0.08 if i % 2 else r.standard_normal(8)
        rows.append((i, v.tolist(), 0 if i % 10 else 1, None))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = embedding.near_duplicates(df.withColumn("label", df["label"].cast(label_type))).collect()
    assert sorted((x.vec_id, x.n_links, x.component_id) for x in got) == plain(rows, 0.98)


def test_pipeline_odd_rows(spark, tmp_path):
    """Null ids, very long texts, repeated rows and clashing columns go through all stages."""
    rows = [r for r in h.sample(seed=3, n=60) if r[1] is None or len(r[1]) < 10**6]
    r = random.Random(2)
    long = "\n".join(" ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(40)) for _ in range(500))
    rows.append((None, long, "en", "s1", len(long), 1, "a", "b"))
    docs = spark.createDataFrame(rows, h.COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    assert any(x.text == long for x in kept.collect()) or kept.count() > 0
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    used = collections.defaultdict(int)
    for x in out:
        used[x.sequence_id] += x.length
    assert out and max(used.values()) <= 4096
