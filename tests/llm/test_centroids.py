"""Exact clustering against plain integers."""

import hashlib
import random

import numpy as np
import pytest

from glyphweave.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, v string, cluster string"


def rows(seed, n, dims, spread=1.0):
    r = random.Random(seed)
    good = [[float(np.float32(r.gauss(0, spread))) for _ in range(dims)] for _ in range(n)]
    out = [(i, x, 0, "clash", "clash") for i, x in enumerate(good)]
    out += [out[3], out[3], (3, good[4], 0, "", ""), (None, good[5], None, None, None), (None, good[5], None, None, None)]
    bad = [None, [], good[0][:-1], good[0] + [0.0], [None, *good[0][1:]], [float("nan"), *good[0][1:]], [float("inf"), *good[0][1:]], [-3e38, *good[0][1:]]]
    return out + [(1000 + i, x, 0, "", "") for i, x in enumerate(bad)]


def plain(data, clusters, rounds, dims):
    ok = lambda x: x is not None and len(x) == dims and all(c is not None and abs(c) < 2**54 for c in x)
    kept = [(i, [int(np.floor(float(c) * 256)) for c in x]) for i, x, *_ in data if ok(x)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda t: (name(t[0]), t[1]))[:clusters]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((apart(v, c), j) for j, c in enumerate(cents)) for _, v in kept]
    for _ in range(rounds):
        mine = assign()
        for j in range(len(cents)):
            inside = [v for (_, v), (_, k) in zip(kept, mine, strict=True) if k == j]
            if inside:
                cents[j] = [sum(c) // len(inside) for c in zip(*inside, strict=True)]
    mine = assign()
    fits = lambda n: n if n < 2**63 else None
    whole = fits(sum(d for d, _ in mine))
    return sorted((-1 if i is None else i, j, d, fits(sum(a for a, b in mine if b == j)), whole, hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, mine, strict=True))


@pytest.mark.parametrize(("clusters", "rounds", "dims", "spread"), [(7, 5, 20, 1.0), (60, 2, 11, 0.02), (500, 1, 8, 1.0), (5, 3, 9, 9e5), (1, 1, 3, 1.0)])
def test_clusters_are_those_of_plain_integers(spark, clusters, rounds, dims, spread):
    data = rows(clusters, 150, dims, spread)
    table = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = centroids.cluster(table, clusters=clusters, rounds=rounds, dims=dims).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == plain(data, clusters, rounds, dims)


def test_distances_that_no_long_holds_are_null(spark):
    far = [(0, [2.0**50] * 64), (1, [-(2.0**50)] * 64), (2, [0.0] * 64)]
    table = spark.createDataFrame([(i, x, 0, "", "") for i, x in far], SCHEMA)
    got = {r.vec_id: r for r in centroids.cluster(table, clusters=1, rounds=1).collect()}
    assert len(got) == 3 and all(r.cluster == 0 for r in got.values())
    assert got[2].distance == 0 and got[0].distance is None and got[0].inertia is None and got[2].cluster_inertia is None


def test_an_empty_table(spark):
    for data in ([], [(1, [1.0], 0, "", "")]):
        got = centroids.cluster(spark.createDataFrame(data, SCHEMA))
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got.count() == 0


def test_partial_distances_keep_ties_for_the_smaller_number():
    r = np.random.default_rng(0)
    x, c = r.integers(-3, 4, (400, 24)), r.integers(-3, 4, (30, 24))
    c[20:] = c[:10]
    order = list(r.permutation(24))
    whole = ((x[:, None] - c[None]) ** 2).sum(2)
    mine, apart = centroids.nearest(x, c, order)
    assert (mine == whole.argmin(1)).all() and (apart == whole.min(1)).all()
    big, _ = centroids.nearest(x * 2**40, c * 2**40, order)
    assert (big == mine).all()
