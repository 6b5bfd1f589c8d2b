"""Connected components by min-label hooking and pointer jumping, with lineage cut in every round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glyphweave.session import cut, release


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node of its component.

    Nulls and self loops are ignored, repeated edges count once, and an empty edge table gives an empty result.
    Each round alternates large-star and small-star: neighbours above a node, and then those below it, are linked to
    the smallest node around it. Both steps are a grouped minimum and a join, so a hub of any degree is reduced
    map-side and its rows are spread by AQE's skew join; no neighbour list is ever collected.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a and b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new = cut(small)
        # Converged once every node has one parent and no parent is a child: then the edges are stars.
        child, parents = new.groupBy("a").agg(F.count("*").alias("n")), new.select(F.col("b").alias("a")).distinct()
        busy = child.where("n > 1").select("a").limit(1).unionAll(child.select("a").join(parents, "a", "left_semi").limit(1))
        settled = not busy.take(1)
        release(e)
        e = new
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
