"""Substring dedup by collinear chaining of shared word k-mers.

1. Seeds: of every window of WINDOW successive K-word hashes of a whole text the smallest is a seed, so any exact run of
   K + WINDOW - 1 words holds the same seed wherever it stands.
2. Matches: each shared seed links all texts that hold it to two of them, the smallest and the largest text key: at most two
   matches for an occurrence, however common a seed is; a grouped minimum and maximum and a join, no pairs within a group.
   The matches of a passage whose parts stand in other texts too may all go to those. So every run of min_words words of
   which all inner seeds are shared is hashed as a whole, and linked to the smallest text key that holds the whole run:
   no verbatim passage of min_words words is lost, whatever else holds its parts. Those that no chain covers are
   passages by themselves, extended like chains.
   An edited passage whose seeds all have their ends elsewhere is sought in a second turn: stretches of shared seeds that
   no passage covers yet and that are long enough for one meet among themselves: up to RARE holders of a seed all with all. Of a seed that
   more hold, as fragments of a common line and runs of one word are, those meet that have more in common: a sign is three words at one distance from the seed, up to REACH words away. A passage is longer than
   what is common to so many, so its two texts share signs beyond that: up to RARE holders of a sign meet all with all, more meet some of their number, two for each of SALTS orders. So pairs grow with the rows.
3. Chains: the matches of a pair of texts, in order of the one text, go through a Fenwick tree over the other; it holds for each prefix
   the best chain, where a chain earns K for a match and pays GAP for each word between matches.
4. Alignment: chains are extended word by word at both ends while the score stays within DROP of its best; gaps inside
   are aligned; a chain that bridges too much is parted at its widest gap. Passages of min_words words or more of which min_identity match are the result.
   Verbatim passages are all found. Of edited ones those are whose unedited runs hold seeds in both texts, so runs of fewer than K words find nothing: of
   20 passages of 70 words with every 12th, 9th, 7th, 6th word replaced, 20, 15, 7 and 0 were found.

Texts that are equal as a whole are one text from the start; copies are reported as one whole passage with their first
document.

Edge cases: null, blank and short texts have no passages; a passage that repeats only inside one document is
none; repeated rows (same doc_id and text) are one document; a null doc_id takes part; ties go to the smaller text key or id; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphweave.llm._shingles import mix, word_hashes
from glyphweave.session import cut, release

K, WINDOW, GAP, DROP = 6, 10, 0.08, 12
#: The second turn: holders of a seed or sign that meet as a list; widest gap between seeds of one stretch, and least words that its seeds span.
RARE, APART, SPAN = 64, 30, 24
#: Words of a sign, its greatest distance from the seed, and orders of the holders of a sign.
SIGN, REACH, SALTS = 3, 64, 4
MIN_WORDS, MIN_IDENTITY = 45, 0.8


def seeds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the minimizers of a text's word hashes, in order. Of a run of equal ones, as periodic text has them, the first and the last."""
    m = len(h) - K + 1
    if m < 1:
        return h[:0], np.zeros(0, np.int32)
    s = h[:m]
    for j in range(1, K):
        s = mix(s) + h[j : m + j]
    s = mix(s)
    w = min(WINDOW, m)
    at = np.lib.stride_tricks.sliding_window_view(s, w).argmin(axis=1) + np.arange(m - w + 1)
    at = np.unique(at)
    value = s[at]
    inner = np.zeros(len(at), bool)
    inner[1:-1] = (value[1:-1] == value[:-2]) & (value[1:-1] == value[2:])
    return value[~inner], at[~inner].astype(np.int32)


def seeds_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of seeds of each text, hashes, positions, 1 for the first of a hash in its text plus 2 for the last) of some texts at a time, as seeds() finds them."""
    m = np.array([len(h) - K + 1 for h in texts], np.int64)
    whole = np.flatnonzero(m >= WINDOW)
    owner, value, place = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    if len(whole):
        h = np.concatenate([texts[i] for i in whole])
        top = len(h) - K + 1
        s = h[:top]
        for j in range(1, K):
            s = mix(s) + h[j : top + j]
        s = mix(s)
        begin = np.cumsum(m[whole] + K - 1) - (m[whole] + K - 1)
        # the smallest and its first place in windows of 2, 4, 8 and all words; those that reach into the next text are left out
        best, at = s, np.arange(top)
        for size in (1, 2, 4, WINDOW - 8):
            right = best[size:] < best[:-size]
            best, at = np.where(right, best[size:], best[:-size]), np.where(right, at[size:], at[:-size])
        count = m[whole] - WINDOW + 1
        mine = np.repeat(whole, count)
        at = at[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        new = np.concatenate(([True], at[1:] != at[:-1]))
        mine, at = mine[new], at[new]
        v, inner = s[at], np.zeros(len(at), bool)
        inner[1:-1] = (v[1:-1] == v[:-2]) & (v[1:-1] == v[2:]) & (mine[1:-1] == mine[:-2]) & (mine[1:-1] == mine[2:])
        first = np.zeros(len(texts), np.int64)
        first[whole] = begin
        owner, value, place = [mine[~inner]], [v[~inner]], [(at - first[mine])[~inner].astype(np.int32)]
    for i in np.flatnonzero((m > 0) & (m < WINDOW)).tolist():
        v, at = seeds(texts[i])
        owner.append(np.full(len(v), i))
        value.append(v)
        place.append(at)
    mine, v, at = np.concatenate(owner), np.concatenate(value), np.concatenate(place)
    order = np.argsort(mine, kind="stable")
    mine, v, at = mine[order], v[order], at[order]
    order = np.lexsort((v, mine))
    edge = np.concatenate(([True], (v[order][1:] != v[order][:-1]) | (mine[order][1:] != mine[order][:-1]), [True]))[: len(v) + 1]
    sides = np.zeros(len(v), np.int8)
    sides[order] = edge[:-1] + 2 * edge[1:] if len(v) else 0
    return np.bincount(mine, minlength=len(texts)), v, at, sides


def signs(w: np.ndarray, values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Distinct hashes of SIGN words with their distance from each place, and its seed: the seed's own first words, and all others up to REACH words away."""
    far = np.concatenate((np.arange(-REACH, 1), np.arange(K - SIGN + 1, REACH + 1)))
    grams, out = run_hashes(w, SIGN), [np.zeros(0, np.uint64)]
    for part in range(0, len(places), 4096):
        at = places[part : part + 4096, None].astype(np.int64) + far
        own = mix(values[part : part + 4096].view(np.uint64))[:, None] + mix((far + REACH).astype(np.uint64))
        good = (at >= 0) & (at < len(grams))
        out.append(np.unique(mix(own[good] + grams[at[good]])))
    return np.unique(np.concatenate(out))


def stretches(at: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which of the places of shared seeds, in order, lie outside of spans (start, end) and in a stretch that may be part of a passage."""
    free = np.ones(len(at), bool)
    for start, end in spans:
        free[np.searchsorted(at, start) : np.searchsorted(at, end)] = False
    pick = np.flatnonzero(free)
    if not len(pick):
        return pick
    part = np.cumsum(np.concatenate(([0], np.diff(at[pick]) > APART)))
    low, high = (f.reduceat(at[pick], np.flatnonzero(np.diff(part, prepend=-1))) for f in (np.minimum, np.maximum))
    return pick[(high - low >= SPAN)[part]]


def chains(x: np.ndarray, y: np.ndarray) -> list[list[int]]:
    """Chains of matches (x, y), as indices in order. A Fenwick tree over y holds the best of f + GAP * (x + y) up to each y.

    The best predecessor is chosen by that; where it overlaps a match, the words in common are taken off afterwards.
    """
    order = np.lexsort((-y, x))
    if (np.diff(x[order]) > 0).all() and (np.diff(y[order]) > 0).all():
        return _parted(order.tolist(), x.tolist(), y.tolist())
    rank = {v: i + 1 for i, v in enumerate(sorted(set(y.tolist())))}
    size = len(rank)
    best, who = [-1e18] * (size + 1), [-1] * (size + 1)
    score, back = [0.0] * len(x), [-1] * len(x)
    xs, ys = x.tolist(), y.tolist()
    wait: list[int] = []  # same x: entered only when x grows

    def enter(i: int) -> None:
        v, r = score[i] + GAP * (xs[i] + ys[i]), rank[ys[i]]
        while r <= size:
            if v > best[r]:
                best[r], who[r] = v, i
            r += r & -r

    for i in order.tolist():
        if wait and xs[wait[0]] != xs[i]:
            for j in wait:
                enter(j)
            wait = []
        r, top, prev = rank[ys[i]] - 1, -1e18, -1
        while r > 0:
            if best[r] > top:
                top, prev = best[r], who[r]
            r -= r & -r
        # overlapping matches earn only the words they add
        gain = K if prev < 0 else min(K, xs[i] - xs[prev], ys[i] - ys[prev])
        cost = 0.0 if prev < 0 else GAP * max(0, xs[i] + ys[i] - xs[prev] - ys[prev] - 2 * K)
        if prev >= 0 and score[prev] + gain - cost > K:
            score[i], back[i] = score[prev] + gain - cost, prev
        else:
            score[i] = float(K)
        wait.append(i)
    return _by_score(score, back)


def _parted(order: list[int], xs: list[int], ys: list[int]) -> list[list[int]]:
    """chains() of matches that grow in both texts: the best predecessor of each is the one before it."""
    score, back = [float(K)] * len(order), [-1] * len(order)
    for p, i in zip(order, order[1:], strict=False):
        dx, dy = xs[i] - xs[p], ys[i] - ys[p]
        grown = score[p] + min(K, dx, dy) - GAP * max(0, dx + dy - 2 * K)
        if grown > K:
            score[i], back[i] = grown, p
    return _by_score(score, back)


def _by_score(score: list[float], back: list[int]) -> list[list[int]]:
    out, used = [], [False] * len(score)
    for i in sorted(range(len(score)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def extend(a: np.ndarray, b: np.ndarray) -> int:
    """How far a and b go on together from their start: +1 for equal words, -2 for others, until DROP below the best."""
    best, length, done, score = 0, 0, 0, 0
    n = min(len(a), len(b))
    while done < n:
        part = slice(done, min(n, done + 128))
        equal = a[part] == b[part]
        lost = len(equal) - int(np.count_nonzero(equal))
        if not lost:
            score, done = score + len(equal), part.stop
            if score > best:
                best, length = score, done
            continue
        run = score + np.cumsum(np.where(equal, 1, -2))
        stop = ()
        if best - score + 2 * lost > DROP:
            top = np.maximum.accumulate(np.maximum(run, best))
            stop = np.flatnonzero(run < top - DROP)
            run = run[: stop[0]] if len(stop) else run
        if len(run) and run.max() > best:
            best, length = int(run.max()), done + int(run.argmax()) + 1
        if len(stop):
            break
        score, done = int(run[-1]), part.stop
    return length


def _equal(a: list, b: list) -> int:
    """Length of the longest common subsequence, for gaps between matches: bit-parallel, one addition over len(b) bits for each word of a."""
    if len(a) == len(b) and (same := sum(p == q for p, q in zip(a, b, strict=True))) >= len(a) - 1:
        return same
    at: dict[int, int] = {}
    for j, q in enumerate(b):
        at[q] = at.get(q, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for p in a:
        hit = row & at.get(p, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def align(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, chain: list[int]) -> tuple[int, int, int, int, int]:
    """(start, end, start, end, equal words) of a chain in a (x) and b (y), extended at both ends."""
    i, j = int(x[chain[0]]), int(y[chain[0]])
    before = extend(a[:i][::-1], b[:j][::-1])
    start_a, start_b = i - before, j - before
    same = int((a[start_a:i] == b[start_b:j]).sum())
    for c in chain:
        p, q = int(x[c]), int(y[c])
        if p < i or q < j:  # overlaps what is covered: take what it adds
            skip = max(i - p, j - q)
            p, q = p + skip, q + skip
            if skip >= K:
                continue
            same += _equal(a[i:p].tolist(), b[j:q].tolist()) + K - skip
            i, j = p + K - skip, q + K - skip
        else:
            same += _equal(a[i:p].tolist(), b[j:q].tolist()) + K
            i, j = p + K, q + K
    after = extend(a[i:], b[j:])
    same += int((a[i : i + after] == b[j : j + after]).sum())
    return start_a, i + after, start_b, j + after, same


def first_of(values: np.ndarray) -> np.ndarray:
    """1 where a value is the first of its kind, else 0."""
    out = np.zeros(len(values), np.int8)
    out[np.unique(values, return_index=True)[1]] = 1
    return out


def whole_runs(size: int, unshared: np.ndarray, n: int) -> np.ndarray:
    """Starts of the n-word runs that may stand in another text: all but those with an unshared seed where it depends on the run's words alone."""
    may = np.ones(max(0, size - n + 1), bool)
    for u in unshared.tolist():
        may[max(0, u - n + K + WINDOW - 1) : max(0, u - WINDOW + 2)] = False
    return np.flatnonzero(may)


def run_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word runs."""
    h = mix(w.view(np.uint32).astype(np.uint64))
    s = h[: len(h) - n + 1]
    for j in range(1, n):
        s = mix(s) + h[j : len(h) - n + 1 + j]
    return mix(s)


def joined_runs(x: np.ndarray, y: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(x, y, words) of the verbatim passages that the equal n-word runs at (x, y) make up."""
    if not len(x):
        return []
    order = np.lexsort((x, x - y))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(x) != 1) | (np.diff(y) != 1))))
    last = np.append(first[1:] - 1, len(x) - 1)
    return list(zip(x[first].tolist(), y[first].tolist(), (x[last] - x[first] + n).tolist(), strict=True))


def _passages(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, min_words: int, min_identity: float, verbatim: list[tuple[int, int, int]] = ()) -> list[tuple]:
    found: list[tuple] = []
    todo = chains(x, y)[::-1]
    while todo:
        chain = todo.pop()
        s, e, s2, e2, same = align(a, b, x, y, chain)
        n, most = min(e - s, e2 - s2), max(e - s, e2 - s2)
        if n >= min_words and same >= min_identity * most:
            if not any(f[0] <= s and e <= f[1] and f[2] <= s2 and e2 <= f[3] for f in found):
                found.append((s, e, s2, e2, n, same / most))
        elif most >= min_words and len(chain) > 1:  # too much lies between: its parts stand for themselves
            gaps = [x[q] - x[p] + y[q] - y[p] for p, q in zip(chain, chain[1:], strict=False)]
            at = int(np.argmax(gaps)) + 1
            todo += [chain[at:], chain[:at]]
    for i, j, n in verbatim:
        if not any(f[0] <= i and i + n <= f[1] and f[2] <= j and j + n <= f[3] for f in found):
            before, after = extend(a[:i][::-1], b[:j][::-1]), extend(a[i + n :], b[j + n :])
            size = before + n + after
            same = int((a[i - before : i + n + after] == b[j - before : j + n + after]).sum())
            found.append((i - before, i + n + after, j - before, j + n + after, size, same / size) if same >= min_identity * size else (i, i + n, j, j + n, n, 1.0))
    return found


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> DataFrame:
    """(doc_id, other_id, start, end, other_start, other_end, n_words, identity): a passage of doc_id, in words, and where it stands in other_id."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            size, found, some, words = [], [], [], 0
            for key, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                h = word_hashes(text.as_py() or b"")
                size.append(len(h))
                some.append(h if key not in seen else h[:0])
                seen.add(key)
                words += len(some[-1])
                if words > 200_000:  # some texts at a time, so that memory is bounded by a batch's or a text's words
                    found.append(seeds_of(some))
                    some, words = [], 0
            number, *lists = (np.concatenate(x) for x in zip(*found, seeds_of(some), strict=True))
            offsets = pa.array(np.concatenate(([0], np.cumsum(number))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (lists[0].view(np.int64), *lists[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int32()), *lists], names=["doc_id", "t", "size", "seeds", "places", "sides"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("text"))
    rows = cut(named.mapInArrow(plant, f"doc_id {kind}, t long, size int, seeds array<long>, places array<int>, sides array<tinyint>"))
    holds = rows.where(F.size("seeds") > 0).select("t", F.explode(F.arrays_zip("seeds", "places", "sides")).alias("s")).select("t", F.col("s.seeds").alias("seed"), F.col("s.places").alias("at"), F.col("s.sides").alias("side"))
    # the first place in the smallest text and the last one in the largest: of plain numbers, which are grouped by hash; a struct would be sorted
    low, high = (f("at", F.when(F.col("side").bitwiseAND(F.lit(bit)) != 0, F.col("t"))).alias(name) for f, bit, name in ((F.min_by, 1, "low_at"), (F.max_by, 2, "high_at")))
    shared = holds.groupBy("seed").agg(F.min("t").alias("low"), low, F.max("t").alias("high"), high).where("low < high")
    ends = F.filter(F.array(F.struct(F.col("low").alias("t"), F.col("low_at").alias("at")), F.struct(F.col("high").alias("t"), F.col("high_at").alias("at"))), lambda o: o["t"] != F.col("t"))
    met = holds.join(shared, "seed").where("t != low").select("t", "at", F.explode(ends).alias("o")).select("t", F.col("o.t").alias("o"), "at", F.col("o.at").alias("o_at"))
    met = cut(met.groupBy("t", "o").agg(F.collect_set(F.struct("at", "o_at")).alias("m")))  # at most a text's own seeds
    spread = F.array_max(F.transform("m", lambda m: m["at"])) - F.array_min(F.transform("m", lambda m: m["at"]))
    pairs = met.where((F.size("m") >= 2) & (spread >= K))
    run = max(min_words, K)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts = [], []
            for key, size, places, common in zip(*(batch.column(i) for i in range(4)), strict=True):
                unshared = np.setdiff1d(places.values.to_numpy(), common.values.to_numpy())
                found = whole_runs(size.as_py(), unshared, run)
                if len(found):
                    edge = np.flatnonzero(np.diff(found) != 1)
                    keys.append(key.as_py())
                    starts.append(np.array([found[[0, *(edge + 1)]], found[[*edge, -1]]], np.int32).T.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.list_(pa.int32()))], names=["t", "starts"])

    sides = [met.select(F.col(k).alias("t"), F.explode(F.array_distinct(F.transform("m", lambda m: m[at]))).alias("at")) for k, at in (("t", "at"), ("o", "o_at"))]
    common = cut(sides[0].union(sides[1]).groupBy("t").agg(F.collect_set("at").alias("common")))  # the smallest holder is linked to none itself
    placed = rows.where((F.size("seeds") > 0) & (F.col("size") >= run)).select("t", "size", "places").dropDuplicates(["t"])
    runs = cut(placed.join(common, "t").select("t", "size", "places", "common").mapInArrow(candidates, "t long, starts array<int>"))
    first = rows.where(F.col("size") >= min_words).groupBy("t", "size").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("f")).select("t", "size", F.col("f.doc_id").alias("first_id"))
    first = cut(first)

    def to_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [(word_hashes(x.as_py() or b"") >> np.uint64(32)).astype(np.uint32).view(np.int32) for x in batch.column(1)]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(v) for v in h]))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(h) if h else np.zeros(0, np.int32)))], names=["t", "w"])

    def spell(keys: DataFrame) -> DataFrame:
        needed = keys.distinct().join(first, "t").select(F.col("t").alias("__t"), F.col("first_id").alias("__id"))
        texts = docs.select("doc_id", "text").join(needed, F.col("doc_id").eqNullSafe(F.col("__id"))).where(F.xxhash64("text") == F.col("__t"))
        return cut(texts.dropDuplicates(["__t"]).select(F.col("__t").alias("t"), F.col("text").cast("binary")).mapInArrow(to_words, "t long, w array<int>"))

    ends_of = lambda p: p.select("t").union(p.select(F.col("o").alias("t")))
    spelled = spell(ends_of(pairs).union(runs.select("t")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*wait, strict=True)]
            wait.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["t", "h", "at", "first"])

        for batch in batches:
            for key, starts, w in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                at = np.concatenate([np.arange(i, j + 1) for i, j in starts.values.to_numpy().reshape(-1, 2)])
                h = run_hashes(w.values.to_numpy(), run)[at]
                wait.append((np.full(len(at), key.as_py()), h.view(np.int64), at.astype(np.int32), first_of(h)))
                if sum(len(x[0]) for x in wait) > 20_000:
                    yield out()
        if wait:
            yield out()

    whole_run = runs.join(spelled, "t").select("t", "starts", "w").mapInArrow(hashed, "t long, h long, at int, first tinyint")
    low_at = F.min_by("at", F.when(F.col("first") == 1, F.col("t")))
    first_run = whole_run.groupBy("h").agg(F.min("t").alias("o"), low_at.alias("o_at"), F.max("t").alias("high")).where("o < high").select("h", "o", "o_at")
    linked = whole_run.join(first_run, "h").where("t != o")
    linked = linked.groupBy("t", "o").agg(F.collect_set(F.struct("at", "o_at")).alias("e"))  # at most a text's own words
    none_run = F.array().cast(met.schema["m"].dataType)
    pairs = cut(pairs.join(linked, ["t", "o"], "full").select("t", "o", F.coalesce("m", none_run).alias("m"), F.coalesce("e", none_run).alias("e")))

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(batch.schema.get_field_index(n)) for n in ("t", "o", "m", "e", "a", "b")}
            out = []
            for r in range(batch.num_rows):
                m, e = ([v.field(i).to_numpy().astype(np.int64) for i in (0, 1)] for v in (col["m"][r].values, col["e"][r].values))
                a, b = (col[k][r].values.to_numpy() for k in "ab")
                out += [(col["t"][r].as_py(), col["o"][r].as_py(), *p) for p in _passages(a, b, *m, min_words, min_identity, joined_runs(*e, run))]
            types = (*[pa.int64()] * 2, *[pa.int32()] * 5, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [()] * 8, types, strict=True)], names=["t", "o", "start", "end", "other_start", "other_end", "n_words", "identity"])

    def passages_of(pairs: DataFrame, spelled: DataFrame) -> DataFrame:
        both = pairs.join(spelled, "t").withColumnRenamed("w", "a").join(spelled.select(F.col("t").alias("o"), F.col("w").alias("b")), "o")
        return cut(both.select("t", "o", "m", "e", "a", "b").mapInArrow(chained, "t long, o long, start int, end int, other_start int, other_end int, n_words int, identity double"))

    found = passages_of(pairs, spelled)
    release(spelled, pairs, runs)

    def uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for key, values, places, shared_at, starts, stops in zip(*(batch.column(i) for i in range(6)), strict=True):
                at, seed = places.values.to_numpy(), values.values.to_numpy()
                mine = np.isin(at, shared_at.values.to_numpy())
                at, seed = at[mine], seed[mine]
                spans = np.stack([starts.values.to_numpy(), stops.values.to_numpy()], 1) if starts.is_valid else np.zeros((0, 2), np.int32)
                pick = stretches(at, spans)
                for o, v in zip(out, (np.full(len(pick), key.as_py(), np.int64), seed[pick], at[pick]), strict=True):
                    o.append(v)
            types = (pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o) if o else np.zeros(0, np.int64), t) for o, t in zip(out, types, strict=True)], names=["t", "seed", "at"])

    spans = found.select("t", "start", "end").union(found.select(F.col("o").alias("t"), F.col("other_start").alias("start"), F.col("other_end").alias("end")))
    spans = spans.groupBy("t", "start").agg(F.max("end").alias("end")).groupBy("t").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))  # at most a text's own words
    full = rows.where((F.size("seeds") > 0) & (F.col("size") >= min_words)).select("t", "seeds", "places").dropDuplicates(["t"])
    loose = cut(full.join(common, "t").join(spans, "t", "left").select("t", "seeds", "places", "common", "starts", "ends").mapInArrow(uncovered, "t long, seed long, at int"))
    held = cut(loose.groupBy("seed").agg(F.count("*").alias("n"), F.min(F.struct("t", "at")).alias("low"), F.max(F.struct("t", "at")).alias("high")).where("low.t < high.t"))
    few = loose.join(held.where(F.col("n") <= RARE).select("seed"), "seed").groupBy("seed").agg(F.collect_list(F.struct("t", "at")).alias("h"))  # RARE at most
    few = few.select("h", F.explode("h").alias("x")).select("x", F.explode("h").alias("y")).where("x.t > y.t").select(F.col("x.t").alias("t"), F.col("y.t").alias("o"), F.col("x.at").alias("at"), F.col("y.at").alias("o_at"))
    few = cut(few)
    often = cut(loose.join(held.where(F.col("n") > RARE).select("seed"), "seed"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, values, places, w in zip(*(batch.column(i) for i in range(4)), strict=True):
                found = signs(w.values.to_numpy(), values.values.to_numpy(), places.values.to_numpy()).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key.as_py())), pa.array(found)], names=["t", "sign"])

    held_often = often.groupBy("t").agg(F.collect_list(F.struct("seed", "at")).alias("s"))  # at most a text's own seeds
    signed_ = cut(held_often.join(spell(often.select("t")), "t").select("t", F.col("s.seed").alias("seeds"), F.col("s.at").alias("places"), "w").mapInArrow(signed, "t long, sign long"))
    order = F.xxhash64("t", F.pmod("sign", F.lit(SALTS)))
    met_by = signed_.groupBy("sign").agg(F.count("*").alias("n"), F.min_by("t", order).alias("low"), F.max_by("t", order).alias("high")).where("n > 1")
    listed = signed_.join(met_by.where(F.col("n") <= RARE).select("sign"), "sign").groupBy("sign").agg(F.collect_list("t").alias("h"))  # RARE at most
    listed = listed.select("h", F.explode("h").alias("t")).select("t", F.explode("h").alias("o"))
    ended = signed_.join(met_by.where(F.col("n") > RARE).select("sign", "low", "high"), "sign").select("t", F.explode(F.array("low", "high")).alias("o"))
    ended = ended.where("t != o").select(F.greatest("t", "o").alias("t"), F.least("t", "o").alias("o"))
    meet = few.select("t", "o").union(listed.where("t > o")).union(ended).distinct()
    many = meet.join(often, "t").join(often.select(F.col("t").alias("o"), "seed", F.col("at").alias("o_at")), ["o", "seed"]).select("t", "o", "at", "o_at")
    again = few.union(many).groupBy("t", "o").agg(F.collect_set(F.struct("at", "o_at")).alias("m")).where((F.size("m") >= 2) & (spread >= SPAN))
    again = cut(again.select("t", "o", "m", none_run.alias("e")))
    found = found.unionByName(passages_of(again, spell(ends_of(again))))
    ids = first.select("t", F.col("first_id").alias("doc_id"))
    found = found.join(ids, "t").join(ids.select(F.col("t").alias("o"), F.col("doc_id").alias("other_id")), "o")
    whole = rows.select("doc_id", "t").distinct().join(first, "t").where(~F.col("doc_id").eqNullSafe(F.col("first_id")))
    whole = whole.select("doc_id", F.col("first_id").alias("other_id"), F.lit(0).alias("start"), F.col("size").alias("end"), F.lit(0).alias("other_start"), F.col("size").alias("other_end"), F.col("size").alias("n_words"), F.lit(1.0).alias("identity"))
    return found.select(*whole.columns).unionByName(whole)
