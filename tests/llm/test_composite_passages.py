import collections
import random

import numpy as np
import xxhash
from hypothesis import given, settings, strategies as st

from glyphweave.llm import passages


def _fresh(r, n):
    return ["".join(r.choice("abcdefghijkl") for _ in range(6)) for _ in range(n)]


def _key(words):
    """The text key: Spark's xxhash64, signed."""
    return np.uint64(xxhash.xxh64_intdigest(" ".join(words), seed=42)).astype(np.int64)


def _outside(r, inner, good):
    while True:
        w = _fresh(r, 5) + inner + _fresh(r, 20)
        if good(_key(w)):
            return w


def _found(spark, texts):
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    return passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()


def test_parts_in_outsiders(spark):
    """A passage whose halves stand in texts with keys below and above both of its own."""
    r = random.Random(11)
    one, two = _fresh(r, 30), _fresh(r, 30)
    x, y = _fresh(r, 20) + one + two + _fresh(r, 9), _fresh(r, 7) + one + two + _fresh(r, 30)
    low, high = sorted((_key(x), _key(y)))
    outsiders = [_outside(r, part, good) for part in (one, two) for good in (lambda k: k < low, lambda k: k > high)]
    got = _found(spark, [x, y, *outsiders])
    assert len(got) == 1 and {got[0].doc_id, got[0].other_id} == {0, 1} and got[0].n_words == 60


def test_every_verbatim_passage(spark):
    """Texts put together from common parts: each run of 45 words that stands in two texts lies in a found passage at one of its places, by brute force."""
    r = random.Random(12)
    parts = [_fresh(r, r.randrange(12, 34)) for _ in range(24)]
    texts = []
    for _ in range(60):
        w = []
        for k in r.sample(range(24), r.randrange(2, 7)):
            w += parts[k] + (parts[(k + 1) % 24] if r.random() < 0.6 else []) + _fresh(r, r.randrange(0, 12))
        texts.append(w)
    holders = collections.defaultdict(list)
    for i, w in enumerate(texts):
        for p in range(len(w) - 44):
            holders[tuple(w[p : p + 45])].append((i, p))
    inside = collections.defaultdict(list)
    for f in _found(spark, texts):
        inside[f.doc_id].append((f.start, f.end))
        inside[f.other_id].append((f.other_start, f.other_end))
    want = [(i, [p for j, p in v if j == i]) for v in holders.values() if len({i for i, _ in v}) > 1 for i in {i for i, _ in v}]
    missed = [(i, at) for i, at in want if not any(s <= p and p + 45 <= e for p in at for s, e in inside[i])]
    assert len(want) > 300 and not missed


def test_runs_of_a_shared_passage_stay():
    """Whatever stands around a passage, none of its runs is ruled out by seeds that the other text lacks."""
    r = np.random.default_rng(3)
    for _ in range(200):
        part = r.integers(0, 2**63, 45).astype(np.uint64)
        texts = [np.concatenate((r.integers(0, 2**63, a).astype(np.uint64), part, r.integers(0, 2**63, 20).astype(np.uint64))) for a in (r.integers(0, 30), r.integers(0, 30))]
        (v, at), (other, _) = (passages.seeds(t) for t in texts)
        starts = passages.whole_runs(len(texts[0]), at[~np.isin(v, other)], 45)
        assert len(texts[0]) - 20 - 45 in starts


def test_edited_passages_quoted_in_slices(spark):
    """Recall by plants: pairs of texts share a passage of 70 words, edited in the second; each is also quoted in slices of 22 words by thirty others, whose keys lie around theirs."""
    r = random.Random(14)
    texts, want = [], []
    for _ in range(12):
        passage = _fresh(r, 70)
        edited = [w if i % 12 else "new" for i, w in enumerate(passage)]
        want.append({len(texts), len(texts) + 1})
        texts += [_fresh(r, 30) + passage + _fresh(r, 12), _fresh(r, 9) + edited + _fresh(r, 33)]
        for _ in range(30):
            start = r.randrange(0, 48)
            texts.append(_fresh(r, 25) + passage[start : start + 22] + _fresh(r, 25))
    got = _found(spark, texts)
    pairs = [{x.doc_id, x.other_id} for x in got if x.n_words >= 45]
    assert sum(w in pairs for w in want) >= 11
    assert all(p in want for p in pairs)


def test_passage_twice_in_one_text(spark):
    """Both places of a passage that stands twice in one text are reported, and one that is quoted in pieces before it stands in full."""
    r = random.Random(15)
    passage, other = _fresh(r, 60), _fresh(r, 60)
    pieces = [other[i : i + 15] for i in (45, 15, 30, 0)]
    long = _fresh(r, 20) + passage + _fresh(r, 50) + passage + _fresh(r, 20)
    mixed = sum((p + _fresh(r, 12) for p in pieces), []) + other + _fresh(r, 30)
    got = _found(spark, [long, _fresh(r, 10) + passage, mixed, other + _fresh(r, 10), ["again"] * 400, ["again"] * 300 + _fresh(r, 80)])
    spans = {(x.doc_id, x.start) for x in got if {x.doc_id, x.other_id} == {0, 1}} | {(x.other_id, x.other_start) for x in got if {x.doc_id, x.other_id} == {0, 1}}
    assert (0, 20) in spans
    if all(x.doc_id == 0 for x in got if {x.doc_id, x.other_id} == {0, 1}):
        assert (0, 130) in spans
    assert any({x.doc_id, x.other_id} == {2, 3} and x.n_words == 60 for x in got)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=40))
def test_common_subsequence(a, b):
    """Against the table of all prefixes."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if p == q else max(best[i][j + 1], best[i + 1][j])
    assert passages._equal(a, b) == best[-1][-1]


def test_chains_against_all_predecessors():
    """For matches that don't overlap, the best chain's score by the Fenwick tree is the best that trying all predecessors gives, with the same gains and gap costs."""
    r = random.Random(16)
    for _ in range(150):
        points = sorted({(r.randrange(40) * passages.K, r.randrange(40) * passages.K) for _ in range(r.randrange(1, 25))})
        x, y = (np.array(c) for c in zip(*points, strict=True))
        found = passages.chains(x, y)
        score = lambda c: passages.K + sum(_step(x, y, p, q) for p, q in zip(c, c[1:], strict=False))  # noqa: B023, E731
        best = []
        for i in range(len(x)):
            best.append(max([passages.K] + [best[j] + _step(x, y, j, i) for j in range(i) if x[j] < x[i] and y[j] < y[i]]))
        assert abs(max(score(c) for c in found) - max(best)) < 1e-9


def _step(x, y, p, q):
    gain = min(passages.K, x[q] - x[p], y[q] - y[p])
    return gain - passages.GAP * max(0, x[q] + y[q] - x[p] - y[p] - 2 * passages.K)


def test_edited_passage_of_frequent_seeds(spark, monkeypatch):
    """An edited passage whose seeds all have more than RARE holders, the smallest and the largest of them elsewhere."""
    monkeypatch.setattr(passages, "RARE", 4)
    r = random.Random(13)
    one, two = _fresh(r, 42), _fresh(r, 42)
    x, y = _fresh(r, 20) + one + _fresh(r, 1) + two + _fresh(r, 9), _fresh(r, 7) + one + _fresh(r, 1) + two + _fresh(r, 30)
    low, high = sorted((_key(x), _key(y)))
    outsiders = [_outside(r, part, good) for part in (one, two) for good in (lambda k: k < low, lambda k: k > high) for _ in range(3)]
    got = _found(spark, [x, y, *outsiders])
    assert len(got) == 1 and {got[0].doc_id, got[0].other_id} == {0, 1} and got[0].n_words == 85


def _met(spark, monkeypatch, n):
    """Pairs of the second turn among n texts that share a line of 43 words with one field, and passages found."""
    pairs, cut = [], passages.cut

    def spy(df, *by):
        out = cut(df, *by)
        if df.columns == ["t", "o", "m", "e"]:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(passages, "cut", spy)
    r = random.Random(17)
    one, two = _fresh(r, 21), _fresh(r, 21)
    found = _found(spark, [_fresh(r, 30) + one + _fresh(r, 1) + two + _fresh(r, 30) for _ in range(n)])
    monkeypatch.setattr(passages, "cut", cut)
    return pairs[1], found


def test_pairs_of_a_common_line_grow_with_its_holders(spark, monkeypatch):
    monkeypatch.setattr(passages, "RARE", 4)
    (few, none), (many, nor_here) = (_met(spark, monkeypatch, n) for n in (30, 120))
    assert not none and not nor_here
    assert 30 <= few and many <= 5 * few


def test_edited_passages_behind_a_common_line(spark, monkeypatch):
    """Each of many texts with a common line has a partner with which it shares more, in words of which no six stand together."""
    monkeypatch.setattr(passages, "RARE", 4)
    r = random.Random(19)
    one, two = _fresh(r, 21), _fresh(r, 21)
    texts = []
    for _ in range(10):
        tail = _fresh(r, 36)
        for _ in range(2):
            own = [w if i % 6 else _fresh(r, 1)[0] for i, w in enumerate(tail)]
            texts.append(_fresh(r, 30) + one + _fresh(r, 1) + two + own + _fresh(r, 10))
    found = _found(spark, texts)
    pairs = {frozenset((f.doc_id, f.other_id)) for f in found}
    assert {frozenset((i, i + 1)) for i in range(0, len(texts), 2)} <= pairs


def test_seeds_of_many_texts(monkeypatch):
    """Seeds of texts at a time are those of each by itself, with the first and the last of a hash marked; also short, empty and periodic texts."""
    r = random.Random(23)
    texts = [np.array([r.randrange(kinds) for _ in range(n)], np.uint64) for n in (0, 3, 5, 6, 7, 14, 15, 16, 40, 300) for kinds in (1, 2, 9, 1 << 60) for _ in range(3)]
    r.shuffle(texts)
    for some in (texts, texts[:1], [], [t for t in texts if len(t) < 15]):
        n, value, at, sides = passages.seeds_of(some)
        found = [passages.seeds(t) for t in some]
        assert n.tolist() == [len(v) for v, _ in found]
        assert value.tolist() == [x for v, _ in found for x in v.tolist()] and at.tolist() == [x for _, a in found for x in a.tolist()]
        assert sides.tolist() == [(x not in v[:i]) + 2 * (x not in v[i + 1 :]) for v in (v.tolist() for v, _ in found) for i, x in enumerate(v)]


def test_extension_and_chains_in_short():
    """extend() against its definition, word by word."""
    r = np.random.default_rng(29)
    for _ in range(400):
        n = int(r.integers(0, 400))
        a = r.integers(0, 9, n)
        b = np.where(r.random(n) < r.choice([0, 0.01, 0.1, 0.4]), -1, a)
        best = length = score = 0
        for i in range(n):
            score += 1 if a[i] == b[i] else -2
            if score < best - passages.DROP:
                break
            if score > best:
                best, length = score, i + 1
        assert passages.extend(a, b) == length
