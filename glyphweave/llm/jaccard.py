"""N-gram Jaccard join in the metric space of shingle sets.

1. Pivots and Voronoi regions. Whole documents make poor first pivots: unlike texts lie at distance near 1 from each, so
   no window could exclude them. The pivots are therefore small sets. The universe of shingles is dealt to cells by
   hash; within one cell, every fragment (what some document has of that cell) is a pivot, and its Voronoi region is
   the documents nearest to it, those at restricted distance 0.
2. Windows. Distances restricted to the cells add up to the symmetric difference, so by the triangle inequality two
   linked documents part in at most D cells, D by the sizes. A document is replicated to the regions of its first
   D + 1 fragments: linked documents meet in one at least, as an argument by counting shows (see fragments()).
   Documents meet by their size class and, near its upper end, in the next.
   Within a region, parity sketches part what is provably apart: bit h of a set's sketch is the parity of its elements with hash h, so
   the bits in which two sketches differ are never more than the elements in which the sets differ.
3. Recursion. Regions that share documents are joined into one region (their components), which is joined exactly: a
   document becomes pivot, all others' distances to it are taken, those within the radius are linked, and windows around
   earlier pivots (|d(x, p) - d(y, p)| > r excludes x, y) keep pairs apart. Only documents outside the
   region's largest component become pivots: a group of copies is settled by one. A region too large for a task is
   first parted by pivots in Spark: the pivot's ball is settled by one join, open documents go on by themselves, and the
   ball's boundary window meets them in blocks.

Equal sets are one node from the start. Links are exact integer tests on 64-bit shingle hashes. Every stage holds a bounded
part of a region; no pairs within a group are listed, a group leaves as a star.

Edge cases: null, empty or blank text has no shingles and links with nothing (n_shingles 0, its own component);
repeated rows are equal sets; a null doc_id takes part, and sorts before all others only where all ids of its component are null;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from glyphweave.llm._shingles import mix, shingles
from glyphweave.operators.components import connected_components
from glyphweave.session import cut, release

#: Shingles that one task may hold of a region.
REGION = 4_000_000
ROUNDS = 12
WIDER = 1.2
#: Most documents of a region whose sketches one task compares; larger regions are not thinned before they are joined.
SKETCHED = 20_000
LEAST_BITS = 256


def _differ(n: int, m: int, num: int, den: int) -> int:
    """Most elements in which linked sets of n and m elements can differ."""
    return (den - num) * (n + m) // (den + num)


def _in_class(keys: np.ndarray, c: int) -> np.ndarray:
    """The low six bits of a region's key are its size class (0: single elements)."""
    return (keys & ~np.uint64(63)) | np.uint64(c)


def parity(u: np.ndarray, num: int, den: int) -> bytes:
    """The parity sketch of a set: a power of two bits, enough for the largest class in which it has regions."""
    bits = max(LEAST_BITS, 1 << (len(u) * den // num).bit_length())
    odd = np.bincount((u >> np.uint64(9)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(sketch: bytes, bits: int) -> np.ndarray:
    """A sketch of fewer bits from one of more: halves are laid over each other."""
    x = np.frombuffer(sketch, np.uint64)
    while len(x) * 64 > bits:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _stars(c: int, ids: np.ndarray, n: np.ndarray, sketches: list[bytes], num: int, den: int) -> np.ndarray:
    """For each set of a region (of class c): the smallest id of those with which it may be linked, directly or through others."""
    bits = max(LEAST_BITS, 1 << c) if c else LEAST_BITS
    x = np.stack([fold(p, bits) for p in sketches])
    root, done = np.arange(len(n)), np.zeros(len(n), bool)
    while True:
        todo = np.flatnonzero(~done & (root != np.bincount(root).argmax()))
        if not len(todo):
            break
        p = todo[0]
        done[p] = True
        at = np.flatnonzero((root != root[p]) & (den * np.minimum(n, n[p]) >= num * np.maximum(n, n[p])))
        apart = np.bitwise_count(x[at] ^ x[p]).sum(1, dtype=np.int64)
        near = at[apart <= (den - num) * (n[at] + n[p]) // (den + num)]
        root[np.isin(root, root[near])] = root[p]
    low = np.full(len(n), np.iinfo(np.int64).max)
    np.minimum.at(low, root, ids)
    return low[root]


def _thin(num: int, den: int):
    """Over rows (place, set_id, n_shingles, parity) in order of place: the stars of each region. Regions that hold the same sets are settled once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        rest: pa.Table | None = None

        def settle(table: pa.Table) -> pa.RecordBatch:
            place, ids, n = (table.column(i).to_numpy() for i in range(3))
            sketches = table.column(3).combine_chunks()
            starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            src, dst = [], []
            for a, b in zip(starts, np.append(starts[1:], len(place)), strict=True):
                c = int(place[a]) & 63
                key = xxhash.xxh3_64_intdigest(ids[a:b].tobytes(), c)
                if key in seen or b - a < 2:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(key)
                if b - a == 2:  # two sets: one comparison
                    p, q = (np.frombuffer(sketches[i].as_py(), np.uint64) for i in (a, b - 1))
                    size = min(len(p), len(q)) * 64
                    apart = int(np.bitwise_count(fold(p.tobytes(), size) ^ fold(q.tobytes(), size)).sum())
                    if den * min(n[a], n[b - 1]) >= num * max(n[a], n[b - 1]) and apart <= (den - num) * (n[a] + n[b - 1]) // (den + num):
                        src.append(ids[a : a + 1])
                        dst.append(ids[b - 1 : b])
                    continue
                low = _stars(c, ids[a:b], n[a:b], [sketches[i].as_py() for i in range(a, b)], num, den)
                other = low != ids[a:b]
                src.append(ids[a:b][other])
                dst.append(low[other])
            none = [np.zeros(0, np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(src or none)), pa.array(np.concatenate(dst or none))], names=["src", "dst"])

        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            place = table.column(0).to_numpy()
            last = int(np.searchsorted(place, place[-1])) if len(place) else 0  # the last region may go on in the next batch
            rest = table.slice(last)
            if last:
                yield settle(table.slice(0, last))
        if rest is not None and rest.num_rows:
            yield settle(rest)

    return run


def fragments(u: np.ndarray, num: int, den: int) -> np.ndarray:
    """The regions of a set of hashes.

    Of two linked sets, call a cell spoilt if they differ there: at most D are. Take the first cell that is not empty
    and not spoilt. The non-empty cells before it are spoilt, so it is among the first D + 1 of either set. If there is
    none, all non-empty cells of both are spoilt and both have at most D of them: such sets also go to the regions
    of single elements, their smallest ones, where sets that linked always share one.
    """
    n = len(u)
    if not n:
        return u
    most = n * den // num
    spoilt = _differ(n, most, num, den)
    size_class = n.bit_length()
    out = []
    few = False
    for c in (size_class, size_class + 1) if most >= 1 << size_class else (size_class,):
        cells = int(WIDER * _differ(1 << c, 1 << c, num, den)) + 1
        cell = (u >> np.uint64(11)) % np.uint64(cells)
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        few |= len(starts) <= spoilt
        taken = starts[: spoilt + 1]
        sums = np.add.reduceat(mix(u[order]), starts)[: len(taken)]
        out.append(_in_class(mix(sums + mix(cell[taken] * np.uint64(64) + np.uint64(c))), c))
    if few:
        out.append(_in_class(mix(u[: n - -(-num * n // den) + 1] ^ np.uint64(0x5851F42D4C957F2D)), 0))
    return np.unique(np.concatenate(out))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([_signed(x) for x in rows] or [np.zeros(0, np.int64)])))


def sketch(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_id, regions, parity); a partition gives a set's regions and sketch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            size, ids, regions, parities = [], [], [], []
            for text in batch.column(2):
                u = shingles(text.as_py(), n)
                set_id = xxhash.xxh3_64_intdigest(u.tobytes()) - (1 << 63)
                size.append(len(u))
                ids.append(set_id)
                known = set_id in seen or not len(u)
                regions.append(u[:0] if known else fragments(u, num, den))
                parities.append(None if known else parity(u, num, den))
                seen.add(set_id)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(ids, pa.int64()), _lists(regions), pa.array(parities, pa.binary())], names=["doc_id", "text_key", "n_shingles", "set_id", "regions", "parity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, text_key long, n_shingles long, set_id long, regions array<long>, parity binary")


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(region, set_id, own, shingles) of the documents in wanted (doc_id, text_key, set_id, region)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.sort(_signed(shingles(x.as_py(), n))) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(1), _lists(sets)], names=["region", "set_id", "own", "shingles"])

    w = wanted.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "set_id", "region")
    text = docs.select("doc_id", "text").join(w, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key")))
    return text.select("region", "set_id", F.col("text").cast("binary")).mapInArrow(run, "region string, set_id long, own long, shingles array<long>")


def join_region(ids: np.ndarray, own: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """The smallest id of each set's component. own: what is known already, equal values are linked."""
    n = np.array([len(x) for x in sets], np.int64)  # sets are in ascending order, as signed numbers
    flat, ends = np.concatenate(sets), np.cumsum(n)
    _, root = np.unique(own, return_inverse=True)
    done, near, radius = np.zeros(len(n), bool), [], 1 - num / den + 1e-9
    while True:
        counts = np.bincount(root)
        todo = np.flatnonzero(~done & (root != counts.argmax()))
        if not len(todo):
            break
        p = todo[0]
        done[p] = True
        may = (root != root[p]) & (den * np.minimum(n, n[p]) >= num * np.maximum(n, n[p]))
        for d in near:
            may &= ~(np.abs(d - d[p]) > radius)  # an unknown distance is nan and excludes nothing
        at = np.flatnonzero(may)
        if not len(at):
            continue
        pick = np.concatenate([np.arange(ends[i] - n[i], ends[i]) for i in at])
        where = np.minimum(np.searchsorted(sets[p], flat[pick]), n[p] - 1)
        both = np.add.reduceat((sets[p][where] == flat[pick]).astype(np.int64), np.concatenate(([0], np.cumsum(n[at])[:-1])))
        union = n[at] + n[p] - both
        linked = at[den * both >= num * union]
        if len(near) < 16:
            d = np.full(len(n), np.nan)
            d[at], d[p] = 1 - both / union, 0
            near.append(d)
        root[np.isin(root, root[linked])] = root[p]
    low = np.full(root.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, root, ids)
    return low[root]


def _leaf(num: int, den: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("set_id")
        ids = pdf["set_id"].to_numpy(np.int64)
        low = join_region(ids, pdf["own"].to_numpy(np.int64), [np.asarray(x, np.int64) for x in pdf["shingles"]], num, den)
        own = pdf["own"].to_numpy(np.int64)
        return pd.DataFrame({"src": np.concatenate((ids, ids)), "dst": np.concatenate((low, own))}).query("src != dst")

    return run


def _links(sets: DataFrame, num: int, den: int, limit: int) -> DataFrame:
    """(src, dst) that connect the linked sets of each region."""
    leaves, links = [], []
    radius = 1 - num / den
    for _ in range(ROUNDS):
        size = sets.groupBy("region").agg(F.sum(F.size("shingles")).alias("size"), F.count("*").alias("n"))
        big = cut(size.where((F.col("size") > limit) & (F.col("n") > 2)))
        if not big.take(1):
            break
        leaves.append(sets.join(big, "region", "left_anti"))
        big_sets = sets.join(big.select("region"), "region")
        pivots = big_sets.groupBy("region").agg(F.min_by(F.struct("set_id", "shingles"), F.xxhash64("set_id")).alias("pivot"))
        both = F.size(F.array_intersect("shingles", F.col("pivot.shingles")))
        union = F.size("shingles") + F.size("pivot.shingles") - both
        seen = cut(big_sets.join(pivots, "region").select("region", "set_id", "shingles", F.col("pivot.set_id").alias("own"), (den * both >= num * union).alias("inside"), (1 - both / union).alias("d")))
        links.append(seen.where("inside").select(F.col("set_id").alias("src"), F.col("own").alias("dst")))
        rest = seen.where("not inside")
        # Around the ball, open sets within 2 r of the pivot meet the ball's own window in blocks of bounded size.
        ball = seen.where(F.col("inside") | (F.col("d") <= 2 * radius + 1e-9))
        blocks = ball.groupBy("region").agg(*[(F.floor(F.sum(F.when(c, F.size("shingles")).otherwise(0)) / (limit / 2)) + 1).cast("int").alias(k) for k, c in (("n_in", F.col("inside")), ("n_out", ~F.col("inside")))])
        blocks = blocks.join(ball.where("not inside").select("region").distinct(), "region", "left_semi")
        ball = ball.join(blocks, "region").withColumn("mine", F.pmod(F.xxhash64("set_id"), F.when(F.col("inside"), F.col("n_in")).otherwise(F.col("n_out"))))
        dealt = ball.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("inside"), F.col("n_out")).otherwise(F.col("n_in")) - 1)))
        name = F.concat_ws("/", "region", F.lit("b"), F.when(F.col("inside"), F.concat_ws("-", "mine", "other")).otherwise(F.concat_ws("-", "other", "mine")))
        leaves.append(dealt.select(name.alias("region"), "set_id", F.when(F.col("inside"), F.col("own")).otherwise(F.col("set_id")).alias("own"), "shingles"))
        sets = rest.select(F.concat_ws("/", "region", F.lit("o")).alias("region"), "set_id", F.col("set_id").alias("own"), "shingles")
    else:  # what no pivot has thinned out: all pairs of its blocks
        part = sets.join(sets.groupBy("region").agg((F.floor(F.sum(F.size("shingles")) / (limit / 2)) + 1).cast("int").alias("k")), "region").withColumn("mine", F.pmod(F.xxhash64("set_id"), F.col("k")))
        dealt = part.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        sets = dealt.select(F.concat_ws("/", "region", F.concat_ws("-", F.least("mine", "other"), F.greatest("mine", "other"))).alias("region"), "set_id", "own", "shingles")
    for x in leaves:
        sets = sets.unionByName(x)
    out = sets.groupBy("region").applyInPandas(_leaf(num, den), "src long, dst long")
    for x in links:
        out = out.unionByName(x)
    return out


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, limit: int = REGION) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, first_key), one row per document; first_key: text_key of the component's first document."""
    rows = cut(sketch(docs, n, num, den))
    at = rows.where(F.size("regions") > 0).select("set_id", F.explode("regions").alias("place"))
    shared = at.groupBy("place").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high"), F.count("*").alias("held")).where("low < high").select("place", "low", "held")
    met = cut(at.join(shared, "place"))
    small = met.where(F.col("held") <= SKETCHED).select("place", "set_id").distinct()
    # a set's sketch stands once in each partition that holds it; only sets that meet another need theirs
    sketches = rows.where("parity is not null").select("set_id", "n_shingles", "parity").join(small.select("set_id").distinct(), "set_id", "left_semi").dropDuplicates(["set_id"])
    small = small.join(sketches, "set_id")
    thin = small.repartition("place").sortWithinPartitions("place", "set_id").select("place", "set_id", "n_shingles", "parity").mapInArrow(_thin(num, den), "src long, dst long")
    whole = met.where((F.col("held") > SKETCHED) & (F.col("set_id") != F.col("low"))).select(F.col("set_id").alias("src"), F.col("low").alias("dst"))
    regions = cut(connected_components(thin.unionByName(whole)).select(F.col("node").alias("set_id"), F.col("component").cast("string").alias("region")))
    release(met)
    wanted = rows.join(regions, "set_id").groupBy("set_id", "region").agg(F.min(F.struct("doc_id", "text_key")).alias("x")).select("set_id", "region", "x.doc_id", "x.text_key")
    sets = cut(_sets(docs, wanted, n))
    groups = cut(connected_components(_links(sets, num, den, limit)).select(F.col("node").alias("set_id"), "component"))
    release(sets)
    first = rows.where("n_shingles > 0").groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first"))
    first = first.join(groups, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    first = cut(first)
    named = first.join(first.groupBy("component").agg(F.min("first").alias("least")), "component").select("set_id", F.col("least.doc_id").alias("component_id"), F.col("least.text_key").alias("first_key"))
    full = rows.where("n_shingles > 0").select("doc_id", "text_key", "n_shingles", "set_id").join(named, "set_id").drop("set_id")
    empty = rows.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), F.col("text_key").alias("first_key"))
    return full.unionByName(empty)


def keep_first(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The first document of each component, all columns as they are; repeated rows of it are one document and stay together."""
    found = jaccard_components(docs, n, num, den)
    gone = found.where(~(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("first_key")))).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__key"]), "left_anti")
