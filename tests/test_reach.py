"""Closures by powers of two: deep chains, cycles of all sizes, random graphs against a plain search."""

import random

from pyspark.sql import functions as F

from glyphweave.operators import graph as g, reach


def plain(pairs, seeds):
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    out = set()
    for s in seeds:
        todo, seen = [s], {s}
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out |= {(s, x) for x in seen}
    return out


def got(spark, pairs, seeds):
    steps = spark.createDataFrame(pairs, "a long, b long")
    start = spark.createDataFrame([(s, s) for s in seeds], "seed long, node long")
    rows = [tuple(r) for r in reach.closure(reach.index(steps), start).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_a_chain_ten_thousand_deep(spark):
    n = 10_000
    made = reach.index(spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert len(made.levels) == 14  # by the logarithm of the depth
    start = spark.createDataFrame([(0, 0), (1, n - 5), (2, n + 7)], "seed long, node long")
    found = reach.closure(made, start).groupBy("seed").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"))
    assert sorted(tuple(r) for r in found.collect()) == [(0, n + 1, 0, n), (1, 6, n - 5, n), (2, 1, n + 7, n + 7)]


def test_rings_ways_in_and_out_and_random_graphs(spark):
    """Parts that don't touch, in one index: rings of several lengths, one that no first choice finds, random graphs, nulls and loops."""
    pairs, seeds = [(None, 1), (1, None), (2, 2)], [999, 2]
    for base, n in zip(range(1000, 10_000, 1000), (2, 3, 7, 9, 64)):
        pairs += [(base + k, base + (k + 1) % n) for k in range(n)] + [(base + 100, base), (base + 101, base + 100), (base + 1, base + 200), (base + 200, base + 201), (base + 300, base + 301)]
        seeds += [base, base + 101, base + 200, base + 300]
    n, base = 7, 20_000  # each node of the ring has an end as its smallest and another as its largest successor
    pairs += [(base + k + 10, base + (k + 1) % n + 10) for k in range(n)] + [(base + k + 10, base + 1) for k in range(n)] + [(base + k + 10, base + 99) for k in range(n)] + [(base + 5, base + 10), (base + 12, base + 20), (base + 20, base + 21)]
    seeds += [base + 5, base + 10, base + 20]
    for base, nodes, edges, seed in ((30_000, 12, 30, 1), (40_000, 30, 45, 2), (50_000, 60, 70, 3), (60_000, 40, 41, 4)):
        r = random.Random(seed)
        pairs += [(base + r.randrange(nodes), base + r.randrange(nodes)) for _ in range(edges)]
        seeds += range(base, base + nodes)
    assert got(spark, pairs, seeds) == plain([p for p in pairs if None not in p], seeds)


def test_no_steps(spark):
    assert got(spark, [], [4]) == {(4, 4)}


def test_ancestry_of_all_roots_with_siblings_and_cycles(spark):
    r = random.Random(5)
    kinds = ["DESCENDS", "EVOLVES", "COMPONENT", "VARIANT", "DERIVED", "BORROWED", "INHERITED"]
    edges = [(f"net{k % 4}", k, f"n{r.randrange(40)}", f"n{r.randrange(40)}", r.choice(kinds)) for k in range(60)]
    nodes = [(f"net{k % 4}", f"n{k}", k) for k in range(40)]
    df = spark.createDataFrame(edges, "network_id string, edge_ord long, from string, to string, type string")
    made = spark.createDataFrame(nodes, "network_id string, id string, node_ord long")
    up = [(b, a) for _, _, a, b, t in edges if t in g.ANCESTRY]
    ties = [p for _, _, a, b, t in edges if t in g.SIBLINGS for p in ((a, b), (b, a))]
    roots = ["n0", "n1", "n2", "n3"]
    assert {tuple(x) for x in g.root_ancestries(made, df).collect()} == plain(up + ties, roots)
    down = plain([(a, b) for b, a in up], ["n5"])
    seeds = spark.createDataFrame([("n5",)], "id string")
    assert {tuple(x) for x in g.ancestry(df, seeds, False, True).collect()} == plain(up, ["n5"]) | down


def test_one_way_where_nodes_have_one_successor(spark):
    """A chain with side branches that end at once is walked one way, not three."""
    steps = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(k, 100 + k) for k in range(20)], "a long, b long")
    assert {r["way"] for r in reach._picked(steps).collect()} == {0}
    forked = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1)], "a long, b long")
    assert {r["way"] for r in reach._picked(forked).collect()} == {0, 1, 2}
