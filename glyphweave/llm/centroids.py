"""Centroid clustering in whole numbers: Lloyd rounds whose nearest centroids are found by partial-distance search.

A component x becomes floor(256 * x), so that every distance, sum and centroid is exact and no result depends on how rows are dealt
to tasks. In a task the squared differences of a batch of vectors add up over the dimensions of highest variance first: after the
first of them each vector has a likely centroid, whose whole distance is its best so far; a centroid goes once its sum is strictly above
that, and those that are left finish all dimensions. Ties stay to the end and go to the smaller number.

Each task sums its own vectors by centroid, and Spark adds those sums, at most `clusters * dims` rows a task; only the centroids
themselves are on the driver. The quantised table is written once and read in each round, so a lost executor costs its tasks only.

Edge cases: vectors that are null, of another length, or hold a null, NaN, infinite component, or one of 2**54 or more in size,
are in no result; repeated rows count as often as they are there; a null vec_id hashes as an empty one; of equal hashes the smaller
vector comes first; with fewer vectors than clusters each vector starts one; an empty table gives an empty result; a distance or inertia that
no long holds is null (the assignment stays exact); other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphweave.session import cut, release

SCALE, STEP = 256, 8
#: Differences of components up to SAFE, squared and summed over 64 dimensions, fit a long; larger ones are worked out as Python's integers.
SAFE, LONGEST, OUTSIDE = 2**27, 2**63 - 1, 2.0**54


def quantised(table: DataFrame, dims: int = 64) -> DataFrame:
    """(vec_id, v: array<bigint>) of the vectors that are kept."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) >= OUTSIDE))
    ok = F.col("embedding").isNotNull() & (F.size("embedding") == dims) & ~odd
    return table.where(F.coalesce(ok, F.lit(False))).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def first_centroids(rows: DataFrame, clusters: int, salt: str) -> list[list[int]]:
    """The vectors of lowest hash, in the order of their hashes."""
    hashed = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [r.v for r in rows.select(hashed.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()]


def by_variance(rows: DataFrame, dims: int) -> list[int]:
    """Dimensions, the one of highest variance first. The order decides how early centroids are abandoned, and no result."""
    found = rows.agg(*[F.var_pop(F.get("v", F.lit(i))).alias(f"d{i}") for i in range(dims)]).first()
    return sorted(range(dims), key=lambda i: -(found[i] or 0.0))


def nearest(x: np.ndarray, c: np.ndarray, order: list[int], step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of each row of x, exactly; ties to the smaller centroid. Both come with the dtype of the distances."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) > SAFE:
        x, c = x.astype(object), c.astype(object)
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    apart = lambda a, b: ((a - b) * (a - b)).sum(-1)
    x, c = x[:, order], c[:, order]
    lead = apart(x[:, None, :step], c[None, :, :step])
    guess = lead.argmin(1)
    best = lead[np.arange(len(x)), guess] + apart(x[:, step:], c[guess, step:])
    rows, cents = np.nonzero(lead <= best[:, None])
    part = lead[rows, cents]
    for k in range(step, x.shape[1], step):
        part = part + apart(x[rows, k : k + step], c[cents, k : k + step])
        left = (part <= best[rows]).astype(bool)
        rows, cents, part = rows[left], cents[left], part[left]
    # the guess of each row is left, so all rows are; pairs are in order of row and centroid
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    low = np.minimum.reduceat(part, starts)
    hit = np.flatnonzero((part == low[rows]).astype(bool))
    return cents[hit[np.unique(rows[hit], return_index=True)[1]]], low


def _vectors(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _totals(centroids: np.ndarray, order: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), object)
        for batch in batches:
            x = _vectors(batch, dims)
            mine, _ = nearest(x, centroids, order)
            if np.abs(x).max(initial=0) > SAFE:
                x = x.astype(object)
            for j in np.unique(mine):
                n[j] += (mine == j).sum()
                total[j] += x[mine == j].sum(0).astype(object)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, dims), pa.int32()), pa.array(np.tile(np.arange(dims), len(used)), pa.int32()), pa.array([Decimal(int(v)) for v in total[used].ravel()], pa.decimal128(38, 0)), pa.array(np.repeat(n[used], dims), pa.int64())], names=["cluster", "pos", "total", "n"])

    return run


def _assigned(centroids: np.ndarray, order: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, apart = nearest(_vectors(batch, centroids.shape[1]), centroids, order)
            apart = pa.array([int(d) if d <= LONGEST else None for d in apart] if apart.dtype == object else apart, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(mine, pa.int32()), apart], names=["vec_id", "cluster", "distance"])

    return run


def lloyd_round(rows: DataFrame, centroids: np.ndarray, order: list[int]) -> np.ndarray:
    """Centroids after one round: componentwise floor(sum / count) of the vectors that are nearest; empty ones stay."""
    sums = rows.mapInArrow(_totals(centroids, order), "cluster int, pos int, total decimal(38,0), n long")
    moved = centroids.copy()
    for r in sums.groupBy("cluster", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        moved[r.cluster, r.pos] = int(r.total) // r.n
    return moved


def cluster(table: DataFrame, clusters: int = 40, rounds: int = 5, dims: int = 64, salt: str = "2") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per kept vector."""
    spark = table.sparkSession
    rows = cut(quantised(table, dims))
    centroids = np.array(first_centroids(rows, clusters, salt), np.int64).reshape(-1, dims)
    order = by_variance(rows, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = lloyd_round(rows, centroids, order)
    kind = rows.schema["vec_id"].dataType.simpleString()
    done = cut(rows.mapInArrow(_assigned(centroids, order), f"vec_id {kind}, cluster int, distance long"))
    release(rows)
    sums = {r.cluster: None if r.lost else int(r.total) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()}
    fits = lambda v: v if v is not None and v <= LONGEST else None
    whole = fits(None if None in sums.values() else sum(sums.values()))
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame([(j, fits(v), whole, digest[j]) for j, v in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # one row a cluster
