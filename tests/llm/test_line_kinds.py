import collections
import random

from pyspark.sql import functions as F

from glyphweave.llm import lines


def _unique(r, n=14):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def _dropped(spark, texts):
    out = lines.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {x.doc_id: x.dropped for x in out}


def test_eight_kinds(spark):
    """Lines in exactly eight unlike documents of two lines always recur, wherever their hashes lie."""
    r = random.Random(7)
    texts, want = [], []
    for _ in range(40):
        line = _unique(r, 6)
        for i in range(8):
            texts.append(line + "\n" + _unique(r))
            want.append([0] if i else [])
    assert _dropped(spark, texts) == dict(enumerate(want))


def test_short_templates(spark):
    """Short lines that vary in one field meet their like."""
    r = random.Random(8)
    texts = [f"{_unique(r)}\nWritten by our editor {_unique(r, 1)} this week.\nThanks to {_unique(r, 1)} again." for _ in range(12)]
    assert _dropped(spark, texts) == {i: [1, 2] if i else [] for i in range(12)}


def test_copies_are_one_kind(spark):
    """Kinds by the plain rule: the smallest hash of the lines outside the template, or of all."""
    r = random.Random(9)
    copy = "\n".join(_unique(r) for _ in range(3))
    assert not any(_dropped(spark, [copy] * 20 + ["a line that stands alone"] * 20).values())
    rows = spark.createDataFrame([([[5, 50], [3, 30], [9, 50], []],), ([[4, 40], [2, 40]],)], "paths array<array<long>>")
    got = [{x.template: x.kind for x in row.k} for row in rows.select(lines._kinds(F.col("paths")).alias("k")).collect()]
    assert got == [{5: 3, 50: 3, 3: 5, 30: 5, 9: 3}, {4: 2, 40: 2, 2: 4}]


def _plain(texts, min_docs=8):
    """The rule in plain Python: (document, line) that go. Documents without fields, all unlike."""
    split = [[tuple(x.lower().split()) for x in t.split("\n")] for t in texts]
    rows = [(i, k, w) for i, x in enumerate(split) for k, w in enumerate(x) if len(w) >= 4]

    def holders(key, rows):
        docs = collections.defaultdict(set)
        for i, k, w in rows:
            for x in key(i, k, w):
                docs[x].add(i)
        return {x for x, at in docs.items() if len(at) >= min_docs}

    def blocks(w):
        n, b = len(w), 2 if len(w) < 7 else 3 if len(w) < 10 else 4
        return [(n, j, w[n * j // b : n * (j + 1) // b]) for j in range(b)]

    held = collections.defaultdict(set)
    own = holders(lambda i, k, w: [w], rows)
    for i, k, w in rows:
        if w in own:
            held[w].add((i, k))
    rest = [r for r in rows if r[2] not in own]
    common = holders(lambda i, k, w: blocks(w), rest)
    rest = [r for r in rest if any(x in common for x in blocks(r[2]))]
    node = {(i, k): (len(w),) for i, k, w in rest}
    for at in range(2):
        kept = holders(lambda i, k, w, at=at: [(node[i, k], w[at])], rest)
        node = {(i, k): (*node[i, k], w[at] if (node[i, k], w[at]) in kept else None) for i, k, w in rest}
    constant = holders(lambda i, k, w: [(node[i, k], p, x) for p, x in enumerate(w[2:])], rest)
    for i, k, w in rest:
        path = (*node[i, k], *[x if (node[i, k], p, x) in constant else None for p, x in enumerate(w[2:])])
        if 3 * path[1:].count(None) < len(w):
            held[path].add((i, k))
    return {(i, k) for at in held.values() if len({i for i, _ in at}) >= min_docs for i, k in at if i != min(at)[0]}


def test_tree_against_plain_rule(spark):
    """Templates with names in two places, at a leading place, in short and in long lines, among lines that share some tokens; no copies, so that kinds don't matter."""
    r = random.Random(10)
    name = lambda: _unique(r, 1)
    texts = []
    for i in range(60):
        body = [_unique(r) for _ in range(5)]
        body.append(f"Posted by {name()} {name()} on the public board for {name()}")
        body.append(f"Visit {name()} page for more of this")
        if i % 4 == 0:
            body.append(f"{name()} has left this page to {r.choice(['friends', 'others', name()])} of the house for good reasons")
        if i % 7 == 0:  # eight or nine documents, too few with all the same names
            body.append(f"rights of {r.choice(['one', 'two', 'three'])} {name()} held here")
        body.append(" ".join(r.choice(["the", "of", "and", name()]) for _ in range(12)))
        r.shuffle(body)
        texts.append("\n".join(body))
    want = _plain(texts)
    got = {(i, k) for i, at in _dropped(spark, texts).items() for k in at}
    assert got == want
    probe = {(i, k) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n")) if x.startswith(("Posted by", "Visit "))}
    assert len(probe & got) == 118  # all but the first document's two lines


def test_fields_in_each_quarter(spark):
    """A long line with as many fields as a template may have, spread over the whole of it, still recurs."""
    r = random.Random(11)
    words = [_unique(r, 1) for _ in range(20)]
    line = lambda: " ".join(_unique(r, 1) if k in (3, 6, 9, 12, 15, 18) else w for k, w in enumerate(words))
    texts = [f"{line()}\n{_unique(r)}" for _ in range(12)]
    assert _dropped(spark, texts) == {i: [0] if i else [] for i in range(12)}


def test_two_blocks_stay(spark):
    """However the variable places of a template lie, two blocks of a line of 13 tokens and more stay as they are."""
    r = random.Random(12)
    rows = []
    for n in range(13, 61):
        words = [_unique(r, 1) for _ in range(n)]
        k = (n - 1) // 3  # spread evenly, the most that a template may have
        for at in ({n * i // k for i in range(k)}, {3 * i + 2 for i in range(k)}, set(r.sample(range(n), k))):
            rows.append((" ".join(words), " ".join("x" if i in at else w for i, w in enumerate(words))))
    table = spark.createDataFrame(rows, "a string, b string").select(lines._blocks(F.col("a")).alias("a"), lines._blocks(F.col("b")).alias("b"))
    assert table.where(F.size(F.array_intersect("a", "b")) < 2).count() == 0


def test_one_common_block_is_no_candidate(spark):
    """Long lines of unlike documents that share three words at one place, and nothing else, are left alone before any tokens are read."""
    r = random.Random(13)
    rows = [(i, f"{_unique(r, 6)} of the and {_unique(r, 11)}\n{_unique(r)}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own, rest = lines._candidates(docs, lines._lines(docs), 8)
    assert own.count() == 0 and rest.count() == 0


def test_blocks_are_hashed_once(spark, monkeypatch, capsys):
    """No condition on the hashes below the table they are written to."""
    monkeypatch.setattr(lines, "cut", lambda df: (df.explain(), df)[1])
    lines._lines(spark.createDataFrame([(1, "one two three four")], "doc_id long, text string"))
    assert "exists(" not in capsys.readouterr().out


def test_bits_lose_no_row(spark):
    """Rows of a key pass the bits, most others don't, and the bits stay above a join that follows."""
    rows = spark.range(5000).select(F.xxhash64("id").alias("part"), "id")
    keys = rows.where("id % 7 = 0").select("part")
    got = {x.id for x in lines._maybe(rows, keys).collect()}
    assert got >= set(range(0, 5000, 7)) and len(got) < 1000
