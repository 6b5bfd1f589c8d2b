"""Embedding near-dedup by an epsilon grid order join.

Vectors of one label and length are scaled to length 1, where cosine >= c is a Euclidean distance <= e = sqrt(2 - 2 c). On
the leading principal axes of all vectors a grid of cells of side e is laid; vectors are sorted by label and then by their cells,
axis by axis (the epsilon grid order), and the sorted sequence is cut into blocks. Intervals of the sequence are joined recursively: each
interval has a box on the leading BOX axes; a pair of intervals whose boxes lie more than e apart holds no link and is skipped, any other is
replaced by the pairs of its parts, sixteen to an interval, down to single blocks. That goes over boxes alone, by equi-joins on the
interval; vectors are shipped only for the pairs of blocks that are left, and once for each pair of groups of sixteen blocks. A pair of blocks is
joined by the same recursion in all dimensions: halved along the sequence, skipped where provably distant, and settled without further look where all its vectors are provably
near; what is left is one matrix product in double precision.

Equal vectors are one node with a weight from the start, so copies cost nothing. A link count is a sum over block pairs; links
leave as stars (one edge per vector and block pair at most), never as all pairs of a group.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors with a null label,
link with nothing; vectors of unlike lengths are not compared; repeated vec_ids are rows of their own, counted as others; a null vec_id links like
any other and is never the smallest id unless all are null; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from glyphweave.operators.components import connected_components
from glyphweave.session import cut

AXES, BOX, BLOCK, LEAF = 6, 16, 1024, 64
#: Bits of a block's number by which intervals grow from level to level.
FAN = 4


def _unit(vectors: np.ndarray) -> np.ndarray:
    # scaled by the largest component first, so that very long and very short vectors keep their direction
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _moments(nodes: DataFrame) -> DataFrame:
    """(dim, i, j, s): sums of products of components, and of components where j is -1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                u = _unit(np.stack(part["v"].to_numpy()))
                u = np.hstack((u, np.ones((len(u), 1))))
                sums[dim] = sums.get(dim, 0) + u.T @ u
        for dim, m in sums.items():
            i, j = np.triu_indices(dim + 1)
            yield pd.DataFrame({"dim": np.int32(dim), "i": i.astype(np.int32), "j": j.astype(np.int32), "s": m[i, j]})

    return nodes.select("dim", "v").mapInPandas(run, "dim int, i int, j int, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s"))


def axes(nodes: DataFrame, most_dims: int = 64) -> dict[int, np.ndarray]:
    """Leading principal axes for each vector length; the driver holds one matrix per length (at most most_dims lengths, the
    others use their first components, which are axes as good for correctness)."""
    common = nodes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(most_dims).select("dim")
    out = {}
    for dim, part in _moments(nodes.join(F.broadcast(common), "dim")).toPandas().groupby("dim"):
        m = np.zeros((dim + 1, dim + 1))
        m[part["i"], part["j"]] = part["s"]
        m = m + np.triu(m, 1).T
        n = m[-1, -1]
        cov = m[:-1, :-1] / n - np.outer(m[:-1, -1], m[:-1, -1]) / n**2
        out[int(dim)] = np.linalg.eigh(np.round(cov, 9))[1][:, ::-1][:, :BOX].copy()
    return out


def _cells(nodes: DataFrame, found: dict[int, np.ndarray], eps: float) -> DataFrame:
    """nodes with their cells on the sorting axes and their place on the box axes (at)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for dim, part in pdf.groupby("dim"):
                at = _unit(np.stack(part["v"].to_numpy())) @ found.get(dim, np.eye(dim, min(dim, BOX)))
                at = np.pad(at, ((0, 0), (0, BOX - at.shape[1])))
                c = np.floor(at[:, :AXES] / eps).astype(np.int32)
                parts.append(part.assign(**{f"c{k}": c[:, k] for k in range(AXES)}, at=list(at)))
            if parts:
                yield pd.concat(parts)

    return nodes.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema) + "".join(f", c{k} int" for k in range(AXES)) + ", at array<double>")


def _blocks(cells: DataFrame) -> DataFrame:
    """The sorted sequence in blocks of one label and length: (block: its number, in order, lo and hi: its box, ids, weights, vectors)."""
    kind, vector = cells.schema["label"].dataType.simpleString(), cells.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        rest = None

        def block(p: pd.DataFrame) -> dict:
            at = np.stack(p["at"].to_numpy())
            return {"block": (part << 32) + made, "label": p["label"].iloc[0], "dim": p["dim"].iloc[0], "lo": at.min(0), "hi": at.max(0), "ids": p["node"].to_numpy(), "weights": p["weight"].to_numpy(), "vectors": np.concatenate(p["v"].to_numpy())}

        for pdf in batches:
            pdf = pdf if rest is None else pd.concat((rest, pdf))
            out = []
            while len(pdf):
                same = (pdf["label"] == pdf["label"].iloc[0]) & (pdf["dim"] == pdf["dim"].iloc[0])
                cell = (same & (pdf["c0"] == pdf["c0"].iloc[0])).to_numpy()
                end = int((~same).to_numpy().argmax()) or len(pdf)
                inside = int((~cell).argmax()) or len(pdf)
                if inside >= BLOCK // 4:  # a block ends with its cell on the first axis if it is not too small
                    end = inside
                end = min(BLOCK, end)
                if end == len(pdf) and end < BLOCK:
                    break
                out.append(block(pdf.iloc[:end]))
                made += 1
                pdf = pdf.iloc[end:]
            rest = pdf if len(pdf) else None
            if out:
                yield pd.DataFrame(out)
        if rest is not None:
            yield pd.DataFrame([block(rest)])

    order = ["label", "dim", *[f"c{k}" for k in range(AXES)], "node"]
    return cells.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(run, f"block long, label {kind}, dim int, lo array<double>, hi array<double>, ids array<long>, weights array<long>, vectors {vector}")


def _block_pairs(boxes: DataFrame, eps: float) -> DataFrame:
    """(a, b) with a <= b: blocks (block, label, dim, lo, hi) whose boxes are no more than eps apart; intervals of the sequence are parted level by level."""
    part, made = F.shiftright("block", 32), F.col("block").bitwiseAND((1 << 32) - 1)
    wide = boxes.agg(F.max(part).alias("part"), F.max(made).alias("made")).first()
    levels = [F.lit(0).cast("long")]
    levels += [F.shiftright(part, k) for k in range(-(-int(wide.part or 0).bit_length() // FAN) * FAN - FAN, 0, -FAN)]
    levels += [F.shiftleft(part, 32).bitwiseOR(F.shiftright(made, k)) for k in range(-(-int(wide.made or 0).bit_length() // FAN) * FAN, -1, -FAN)]
    own = ["label", "dim"]
    edges = [f(F.get(side, F.lit(k))).alias(f"{side}{k}") for side, f in (("lo", F.min), ("hi", F.max)) for k in range(BOX)]
    pairs = boxes.select(*own, F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).distinct()
    for up, down in zip(levels, levels[1:], strict=False):
        nodes = boxes.groupBy(*own, up.alias("up"), down.alias("key")).agg(*edges)
        side = lambda x: nodes.select(*own, F.col("up").alias(x), F.col("key").alias(f"{x}_key"), *[F.col(f"{e}{k}").alias(f"{x}_{e}{k}") for e in ("lo", "hi") for k in range(BOX)])  # noqa: B023, E731
        gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"a_lo{k}") - F.col(f"b_hi{k}"), F.col(f"b_lo{k}") - F.col(f"a_hi{k}")), 2) for k in range(BOX)), F.lit(0.0))
        met = pairs.join(side("a"), [*own, "a"]).join(side("b"), [*own, "b"]).where((F.col("a_key") <= F.col("b_key")) & (gap <= eps * eps + 1e-9))
        pairs = cut(met.select(*own, F.col("a_key").alias("a"), F.col("b_key").alias("b")))
    return pairs.select("a", "b")


def _join(a: np.ndarray, b: np.ndarray, cos: float, same: bool) -> Iterator[tuple[slice, slice, np.ndarray | None]]:
    """Parts of a and b and which of their pairs link; None: all of them."""

    def go(i: int, j: int, k: int, m: int) -> Iterator:
        x, y = a[i:j], b[k:m]
        ends = (x.min(0), x.max(0), y.min(0), y.max(0))
        apart = np.maximum(0, np.maximum(ends[0] - ends[3], ends[2] - ends[1]))
        if apart @ apart > 2 - 2 * cos + 1e-9:
            return
        across = np.maximum(ends[1] - ends[2], ends[3] - ends[0])
        if across @ across < 2 - 2 * cos - 1e-9:
            yield slice(i, j), slice(k, m), None
        elif max(j - i, m - k) <= LEAF:
            yield slice(i, j), slice(k, m), x @ y.T >= cos
        elif j - i >= m - k:
            h = (i + j) // 2
            yield from go(i, h, k, m)
            yield from go(h, j, k, m)
        else:
            h = (k + m) // 2
            yield from go(i, j, k, h)
            yield from go(i, j, h, m)

    return go(0, len(a), 0, len(b))


def join_blocks(ids_a, w_a, va, ids_b, w_b, vb, cos: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, linked weight, a node it is linked with), for two blocks or, if same, one with itself (a node with itself left out)."""
    n_a, n_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    a, b = _unit(va), _unit(vb)
    edges = []
    for i, k, hit in _join(a, b, cos, same):
        if hit is None:
            hit = np.ones((i.stop - i.start, k.stop - k.start), bool)
        if same:
            hit = hit & (ids_a[i][:, None] != ids_b[k][None, :])
        if not hit.any():
            continue
        n_a[i] += hit @ w_b[k]
        n_b[k] += w_a[i] @ hit
        edges.append((i, k, hit))
    # union-find over the nodes of both blocks keeps one edge for each that is needed
    nodes = np.unique(np.concatenate((ids_a, ids_b)))
    root = np.arange(len(nodes))
    pa_, pb_ = np.searchsorted(nodes, ids_a), np.searchsorted(nodes, ids_b)
    for i, k, hit in edges:
        for r in np.flatnonzero(hit.any(1)):
            cols = pb_[k][hit[r]]
            got = np.unique(np.append(root[cols], root[pa_[i][r]]))
            if len(got) > 1:
                root[np.isin(root, got)] = got[0]
    count_ids, counts = (ids_a, n_a) if same else (np.concatenate((ids_a, ids_b)), np.concatenate((n_a, n_b)))
    low = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(low, root, nodes)
    used = counts > 0
    return count_ids[used], counts[used], low[root[np.searchsorted(nodes, count_ids[used])]]


def near_duplicates(table: DataFrame, cos: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of table."""
    eps = math.sqrt(2 - 2 * cos) * (1 + 1e-9)
    ok = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = table.select("vec_id", "label", F.col("embedding").alias("v"), F.coalesce(ok, F.lit(False)).alias("ok"))
    # -0.0 and 0.0 group together; equal vectors are one node, named by a hash of what is equal
    good = rows.where("ok").select("vec_id", "label", F.transform("v", lambda x: x + F.lit(0).cast("float")).alias("v"))
    nodes = good.groupBy("label", "v").agg(F.count("*").alias("weight"), F.min(F.struct(F.col("vec_id").isNull(), "vec_id")).alias("least"))
    nodes = cut(nodes.select(F.xxhash64("label", "v").alias("node"), "label", F.size("v").alias("dim"), "v", "weight", F.col("least.vec_id").alias("least")))
    found = axes(nodes)
    blocks = cut(_blocks(_cells(nodes.drop("least"), found, eps)))
    pairs = _block_pairs(blocks.select("block", "label", "dim", "lo", "hi"), eps)
    group = lambda c: F.shiftright(c, FAN)
    pairs = pairs.select(group(F.col("a")).alias("ga"), group(F.col("b")).alias("gb"), "a", "b")
    lists = pairs.groupBy("ga", "gb").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("pairs"))  # at most 4 ** FAN of a pair of groups
    needed = pairs.select("ga", "gb", F.col("a").alias("block")).union(pairs.select("ga", "gb", "b")).distinct().join(lists, ["ga", "gb"])
    shipped = needed.join(blocks.select("block", "dim", "ids", "weights", "vectors"), "block")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held = {r.block: (r.ids, r.weights, r.vectors.reshape(-1, r.dim)) for r in pdf.itertuples()}
        out = [join_blocks(*held[x["a"]], *held[x["b"]], cos, x["a"] == x["b"]) for x in pdf["pairs"].iloc[0]]
        return pd.DataFrame({name: np.concatenate([o[k] for o in out]) for k, name in enumerate(("node", "n", "low"))})

    links = cut(shipped.groupBy("ga", "gb").applyInPandas(run, "node long, n long, low long"))
    count = links.groupBy("node").agg(F.sum("n").alias("n"))
    groups = connected_components(links.select(F.col("node").alias("src"), F.col("low").alias("dst"))).withColumnRenamed("component", "grp")
    full = nodes.select("node", "least", F.col("weight")).join(groups, "node", "left").withColumn("grp", F.coalesce("grp", "node")).join(count, "node", "left")
    full = cut(full)
    low = full.groupBy("grp").agg(F.min(F.struct(F.col("least").isNull(), "least")).alias("low")).select("grp", F.col("low.least").alias("component_id"))
    full = full.join(low, "grp").select("node", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    keyed = rows.withColumn("node", F.when(F.col("ok"), F.xxhash64("label", F.transform("v", lambda x: x + F.lit(0).cast("float")))))
    done = keyed.select("vec_id", "node").join(full, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
