"""Reachability in directed graphs, in rounds that grow with the logarithm of the depth: G2, G3.

An index has one table for each power of two: level k holds the pairs (a, b) that a walk of exactly 2**k steps joins, which is the join of
the level before with itself. A walk of any length is one of each power in its binary form at most, so a closure goes through the
levels once, from the highest down, and adds what each leads to. On a chain each level has as many rows as the chain, never the square.

Walks of exact lengths end only where there are no cycles, so nodes on cycles become one node first: those of up to four steps by the pairs that reach
each other in two, all at once, however they interlace. For longer ones every node picks one successor; jumps along these double until nodes that run into an end have dropped out, and what the others land on is on rings, which are condensed (connected
components). Where no ring is found this way though walks don't end, nodes without an end ahead are the ones that pick, and each of them finds a ring.
Graphs of many interlaced cycles take several turns of this; each turn makes one node of every ring that is found.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from glyphweave.operators.components import connected_components
from glyphweave.session import cut, release


class Reach(NamedTuple):
    """groups: (node, head) of nodes on cycles; levels: (a, b) by powers of two."""

    groups: DataFrame
    levels: list[DataFrame]


def _empty(df: DataFrame) -> bool:
    return not df.take(1)


def _joined(level: DataFrame) -> DataFrame:
    """level after level."""
    x, y = level.select("a", F.col("b").alias("mid")), level.select(F.col("a").alias("mid"), "b")
    return x.join(y, "mid").select("a", "b").distinct()


def _jumped(jump: DataFrame) -> DataFrame:
    """jump after jump, where each node of a way has one successor: one row for a row at most, so none repeats."""
    x, y = jump.select("way", "a", F.col("b").alias("mid")), jump.select("way", F.col("a").alias("mid"), "b")
    return x.join(y, ["way", "mid"]).select("way", "a", "b")


def _picked(steps: DataFrame) -> DataFrame:
    """(way, a, b): each node's smallest successor, its largest, and the one of smallest hash, of those that lead on; one way alone where no node has two of them."""
    leads = steps.join(steps.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
    after = F.col("b")
    picks = cut(leads.groupBy("a").agg(F.array(F.min(after), F.max(after), F.min_by(after, F.xxhash64("b", "a"))).alias("b")))
    if _empty(picks.where("b[0] <> b[1]")):
        return picks.select("a", F.lit(0).alias("way"), F.col("b")[0].alias("b"))
    return picks.select("a", F.posexplode("b").alias("way", "b"))


def _rings(steps: DataFrame, rounds: int) -> DataFrame | None:
    """(node, component) of rings, where each node picks its smallest successor, or its largest, or the one of smallest hash; None without rings."""
    picks = jump = cut(_picked(steps))
    for _ in range(0, rounds, 2):
        further = cut(_jumped(_jumped(jump)))
        if jump is not picks:
            release(jump)
        jump = further
        if _empty(jump):
            return None
    on = cut(jump.select("way", F.col("b").alias("a")).distinct())
    return connected_components(picks.join(on, ["way", "a"], "left_semi"), "a", "b")


def _condensed(steps: DataFrame, groups: DataFrame, rings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, groups) with each ring as one node."""
    rings = cut(rings.select(F.col("node").alias("was"), F.col("component").alias("now")))
    into = lambda df, c: df.join(rings.withColumnRenamed("was", c), c, "left").withColumn(c, F.coalesce("now", c)).drop("now")
    moved = cut(into(into(steps, "a"), "b").where("a <> b").select("a", "b").distinct())
    known = groups.join(rings.withColumnRenamed("was", "head"), "head", "left").select("node", F.coalesce("now", "head").alias("head"))
    new = rings.select(F.col("was").alias("node"), F.col("now").alias("head")).join(groups.select("node"), "node", "left_anti")
    return moved, cut(known.unionByName(new))


def index(steps: DataFrame, ties: DataFrame | None = None) -> Reach:
    """The index of steps (a, b), and of ties (a, b) that lead both ways. Nulls and loops are ignored, repeated steps count once."""
    steps = steps.select("a", "b").where("a is not null and b is not null and a <> b").distinct()
    groups = steps.select(F.col("a").alias("node"), F.col("a").alias("head")).limit(0)
    if ties is not None:
        steps, groups = _condensed(steps, groups, connected_components(ties, "a", "b"))
    else:
        steps, groups = cut(steps), cut(groups)
    while True:
        rounds = max(1, steps.select("a").distinct().count().bit_length())  # 2**rounds exceeds any walk without a repeated node
        second = cut(_joined(steps))
        near = steps.unionByName(second).where("a <> b").distinct()
        mutual = cut(near.join(near.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"]))
        if not _empty(mutual):
            steps, groups = _condensed(steps, groups, connected_components(mutual, "a", "b"))
            release(second, mutual)
            continue
        rings = None if _empty(second) else _rings(steps, rounds)
        if rings is None:
            levels = [steps, second]
            while not _empty(levels[-1]) and len(levels) <= rounds:
                levels.append(cut(_joined(levels[-1])))
            if _empty(levels[-1]):
                release(levels.pop())
                return Reach(groups, levels)
            # walks of more steps than there are nodes: those who take them never meet an end, so each picks a successor that takes one too
            endless = cut(levels[-1].select("a").distinct())
            within = steps.join(endless, "a", "left_semi").join(endless.select(F.col("a").alias("b")), "b", "left_semi")
            rings = _rings(cut(within), rounds)
            release(*levels[1:])
        steps, groups = _condensed(steps, groups, rings)


def closure(reach: Reach, start: DataFrame) -> DataFrame:
    """(seed, node): what start (seed, node) leads to, itself included."""
    heads = start.select("seed", "node").join(reach.groups, "node", "left").select("seed", F.coalesce("head", "node").alias("a")).distinct()
    seen = cut(heads)
    for level in reversed(reach.levels):
        step = seen.join(level, "a").select("seed", F.col("b").alias("a"))
        more = cut(seen.unionByName(step).distinct())
        release(seen)
        seen = more
    return seen.join(reach.groups.withColumnRenamed("head", "a"), "a", "left").select("seed", F.coalesce("node", "a").alias("node"))
