"""Graph queries over edges (network_id, from, to, type) and nodes (network_id, id, ...): G1-G4, G12-G15, G17, G18, A3, K5, R1, R10, J9, J10, J12, J14.

Closures go through an index by powers of two (operators.reach).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphweave.functions.tables import EDGE_TYPES, OTHER_DATE
from glyphweave.operators import reach
from glyphweave.operators.components import connected_components
from glyphweave.session import cut

ANCESTRY, SIBLINGS = ("DESCENDS", "EVOLVES", "COMPONENT"), ("VARIANT", "DERIVED")


def both_ways(edges: DataFrame) -> DataFrame:
    a, b = F.col("from"), F.col("to")
    return edges.select(a.alias("a"), b.alias("b")).union(edges.select(b.alias("a"), a.alias("b"))).distinct()


def ego(edges: DataFrame, seeds: DataFrame, degrees: int = 2) -> DataFrame:
    """(seed, node, depth) of all nodes within degrees of each seed (id), whatever the edges' direction."""
    links = both_ways(edges)
    seen = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("depth"))
    for _ in range(degrees):
        step = seen.join(links, seen["node"] == links["a"]).select("seed", F.col("b").alias("node"), (F.col("depth") + 1).alias("depth"))
        seen = cut(seen.unionByName(step).groupBy("seed", "node").agg(F.min("depth").alias("depth")))
    return seen


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among each seed's members (seed, node)."""
    a = members.select("seed", F.col("node").alias("from"))
    b = members.select("seed", F.col("node").alias("to"))
    return edges.join(a, "from").join(b, ["seed", "to"]).select("seed", *[c for c in edges.columns if c != "seed"])


def closure(steps: DataFrame, start: DataFrame) -> DataFrame:
    """(seed, node) reachable from start (seed, node) by steps (a, b), in rounds by the logarithm of the depth. Many starts share one index: see reach.index()."""
    return reach.closure(reach.index(steps), start)


def ancestry_index(edges: DataFrame, siblings: bool = True) -> reach.Reach:
    """Ancestors by DESCENDS, EVOLVES and COMPONENT; with siblings, nodes that VARIANT or DERIVED edges join stand for each other. One index serves any number of seeds."""
    up = edges.where(F.col("type").isin(*ANCESTRY)).select(F.col("to").alias("a"), F.col("from").alias("b"))
    ties = edges.where(F.col("type").isin(*SIBLINGS)).select(F.col("from").alias("a"), F.col("to").alias("b")) if siblings else None
    return reach.index(up, ties)


def ancestry(edges: DataFrame, seeds: DataFrame, siblings: bool = True, descendants: bool = False) -> DataFrame:
    """(seed, node): ancestors by DESCENDS, EVOLVES and COMPONENT; siblings by VARIANT and DERIVED and their ancestors; descendants of the seed alone."""
    start = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"))
    out = reach.closure(ancestry_index(edges, siblings), start)
    if descendants:
        down = edges.where(F.col("type").isin(*ANCESTRY)).select(F.col("from").alias("a"), F.col("to").alias("b"))
        out = out.union(closure(down, start)).distinct()
    return out


def root_ancestries(nodes: DataFrame, edges: DataFrame, siblings: bool = True) -> DataFrame:
    """(seed, node) for the root of every network at once."""
    return ancestry(edges, network_roots(nodes).select("id").distinct(), siblings)


def network_roots(nodes: DataFrame) -> DataFrame:
    """The first node of each network."""
    return nodes.groupBy("network_id").agg(F.min_by("id", "node_ord").alias("id"))


def find_node(nodes: DataFrame, language: str, form: str) -> DataFrame:
    """The first node of a form."""
    return nodes.where((F.col("language") == language) & (F.col("form") == form)).agg(F.min_by("id", F.struct("network_id", "node_ord")).alias("id")).where("id is not null")


def ego_query(nodes: DataFrame, edges: DataFrame, node: str | None = None, mode: str = "ego", degrees: int = 2) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of an ego or ancestry graph; without a node, the ego graphs of all networks' roots."""
    if mode not in ("ego", "ancestry"):
        raise ValueError(f"unknown mode {mode}")
    seeds = nodes.where(F.col("id") == node).select("id") if node else network_roots(nodes).select("id")
    members = ego(edges, seeds, degrees) if mode == "ego" or not node else ancestry(edges, seeds, True, True)
    found = members.join(nodes, members["node"] == nodes["id"]).select("seed", *nodes.columns)
    return found, induced(edges, members)


def parents(edges: DataFrame, node: str) -> DataFrame:
    """G17."""
    return edges.where(F.col("to") == node).select(F.col("from").alias("id"), "type")


def children(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("from") == node).select(F.col("to").alias("id"), "type")


def first_parent(edges: DataFrame) -> DataFrame:
    """The source of the first edge into each node."""
    return edges.groupBy(F.col("to").alias("id")).agg(F.min_by("from", "edge_ord").alias("parent"))


def distinct_edges(edges: DataFrame, *key: str) -> DataFrame:
    """The first edge of each key (network_id, from, to by default), whatever its type."""
    key = key or ("network_id", "from", "to")
    w = Window.partitionBy(*key).orderBy("edge_ord")
    return edges.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def canonical_nodes(nodes: DataFrame, *key: str) -> DataFrame:
    """The first node of each key, with the id each other one turns into (canonical)."""
    w = Window.partitionBy(*(key or ("network_id", "language", "form"))).orderBy("node_ord")
    return nodes.withColumn("canonical", F.first("id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("is_first", F.row_number().over(w) == 1)


def with_ends(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Edges with columns of both ends as from_x and to_x."""
    out = edges
    for end in ("from", "to"):
        side = nodes.select(F.col("network_id"), F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns])
        out = out.join(side.hint("merge"), ["network_id", end])  # sides grow with the input, however small their files make them look: never broadcast
    return out


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A3, K5: (what, key, n): totals, edges by type, nodes by language, averages by network."""
    n = nodes.select(F.lit("nodes").alias("what"), F.col("language").alias("key"), "network_id").union(edges.select(F.lit("edges"), "type", "network_id"))
    cube = n.groupingSets([["what", "key"], ["what"]], "what", "key").agg(F.count("*").cast("double").alias("n"), F.count_distinct("network_id").alias("networks"), F.grouping("key").alias("g"))
    total = cube.where("g = 1")
    return cube.where("g = 0").select("what", "key", "n").union(total.select("what", F.lit("total"), "n")).union(total.select("what", F.lit("per network"), F.round(F.col("n") / F.col("networks"), 6)))


def languages_of(nodes: DataFrame) -> DataFrame:
    """A9."""
    return nodes.groupBy("network_id").agg(F.count_distinct("language").alias("n_languages"))


def cleanup_descent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Egyptian to Demotic or Coptic descent starts at the latest Egyptian form; Egyptian to Coptic goes where a Demotic word lies between.

    Latest: the last form of the highest dated rank, else the last of the lowest rank. Networks with one Egyptian node only lose the
    second kind.
    """
    return cleaned_descent(nodes, cut(with_ends(edges, nodes, "language"))).select(*edges.columns)


def cleaned_descent(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """cleanup_descent() of edges that bear from_language and to_language, and are cut. Only descent between the three languages is dealt anew; all other edges pass."""
    egy = nodes.where("language = 'egy'")
    dated = F.col("rank") < OTHER_DATE
    latest = egy.groupBy("network_id").agg(
        F.count("*").alias("n"),
        F.coalesce(F.max_by(F.when(dated, F.col("id")), F.when(dated, F.struct("rank", "node_ord"))), F.min_by("id", F.struct("rank", "node_ord"))).alias("latest"),
    )
    a, b = F.col("from_language"), F.col("to_language")
    kind = F.coalesce((F.col("type") == "DESCENDS") & ((a == "egy") & b.isin("dem", "cop") | (a == "dem") & (b == "cop")), F.lit(False))
    descent = ends.where(kind)
    down = (F.col("from_language") == "egy") & (F.col("n") > 1)
    moved = descent.join(latest.hint("merge"), "network_id", "left").withColumn("down", F.coalesce(down, F.lit(False)))
    moved = moved.withColumn("from", F.when(F.col("down"), F.col("latest")).otherwise(F.col("from"))).drop("n", "latest")
    moved = moved.withColumn("__n", F.row_number().over(Window.partitionBy("network_id", "from", "to", "type").orderBy("edge_ord")))
    moved = cut(moved.where((F.col("__n") == 1) | ~F.col("down")).drop("__n", "down"))
    hop = lambda a, b: moved.where((F.col("from_language") == a) & (F.col("to_language") == b))
    over = hop("egy", "dem").select("network_id", "from", F.col("to").alias("mid")).join(hop("dem", "cop").select("network_id", F.col("from").alias("mid"), "to").hint("merge"), ["network_id", "mid"]).select("network_id", "from", "to").distinct()
    jumps = hop("egy", "cop").join(over.hint("merge"), ["network_id", "from", "to"], "left_anti")
    return ends.where(~kind).unionByName(moved.where("not (from_language = 'egy' and to_language = 'cop')")).unionByName(jumps.select(*moved.columns))


def reroute_descent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """An Egyptian to Coptic edge moves to the network's first Demotic child with meanings, or goes if one leads there already."""
    ends = with_ends(edges, nodes, "language", "meanings", "node_ord")
    dem = ends.where("from_language = 'egy' and to_language = 'dem' and size(to_meanings) > 0").groupBy("network_id", "from").agg(F.min_by("to", "to_node_ord").alias("child"))
    led = ends.where("from_language = 'dem' and to_language = 'cop'").select("network_id", "to").distinct().withColumn("led", F.lit(True))
    out = ends.join(dem.hint("merge"), ["network_id", "from"], "left").join(led.hint("merge"), ["network_id", "to"], "left")
    jump = (F.col("from_language") == "egy") & (F.col("to_language") == "cop")
    out = out.where(~(jump & F.coalesce("led", F.lit(False)))).withColumn("from", F.when(jump & F.col("child").isNotNull(), F.col("child")).otherwise(F.col("from")))
    return out.select(*edges.columns)


def merge_into(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Networks move into the ones they are alternatives of (source, target), through chains of any length; the first network of a chain's component takes all."""
    to = connected_components(targets, "source", "target").select(F.col("node").alias("network_id"), F.col("component").alias("into"))
    move = lambda df: df.join(to, "network_id", "left").withColumn("network_id", F.coalesce("into", "network_id")).drop("into")
    return move(nodes), distinct_edges(move(edges), "network_id", "from", "to", "type")


IDENTITY = ("language", "form", "period", "dialect", "hieroglyphs", "etymology_index")


def merge_networks(nodes: DataFrame, edges: DataFrame, roots: DataFrame, stop: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Networks that share a node identity become one, unless it is in stop (language, form) or their roots' etymology indices differ.

    Returns (network_id, merged), the merged nodes (first of each identity, meanings united) and the remapped edges.
    roots: (network_id, root_etymology_index). An identity links its networks as a star, so a common one costs a row for each.
    """
    ident = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("0" if c == "etymology_index" else "\u0000")) for c in IDENTITY])
    held = nodes.withColumn("identity", ident)
    usable = held.join(stop, ["language", "form"], "left_anti").join(roots, "network_id")
    agreed = usable.groupBy("identity").agg(F.min("network_id").alias("low"), F.max("network_id").alias("high"), F.min("root_etymology_index").alias("a"), F.max("root_etymology_index").alias("b")).where("low < high and (a is null or a = b)").select("identity", "low")
    links = usable.select("identity", "network_id").distinct().join(agreed, "identity").select(F.col("network_id").alias("src"), F.col("low").alias("dst"))
    groups = connected_components(links).select(F.col("node").alias("network_id"), F.col("component").alias("merged"))
    all_ = nodes.select("network_id").distinct().join(groups, "network_id", "left").select("network_id", F.coalesce("merged", "network_id").alias("merged"))
    moved = held.join(all_, "network_id")
    order = F.struct(F.col("etymology_index").isNull(), "network_id", "node_ord")
    kept = moved.groupBy("merged", "identity").agg(F.min_by(F.struct(*[c for c in nodes.columns if c not in ("network_id", "meanings")]), order).alias("x"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("network_id", "node_ord", "meanings"))), lambda m: m["meanings"]))).alias("meanings"))
    out_nodes = kept.select(F.col("merged").alias("network_id"), "x.*", "meanings").select(*nodes.columns)
    ids = moved.join(kept.select("merged", "identity", F.col("x.id").alias("new")), ["merged", "identity"]).select("network_id", "merged", "id", "new")
    ends = edges.join(ids.select("network_id", "merged", F.col("id").alias("from"), F.col("new").alias("new_from")), ["network_id", "from"]).join(ids.select("network_id", F.col("id").alias("to"), F.col("new").alias("new_to")), ["network_id", "to"])
    out = ends.where("new_from <> new_to").withColumns({"network_id": F.col("merged"), "from": F.col("new_from"), "to": F.col("new_to")}).select(*edges.columns)
    return all_, out_nodes, distinct_edges(out, "network_id", "from", "to", "type")


def keyword_search(nodes: DataFrame, query: str, most: int = 50) -> DataFrame:
    """The first matching node of each of the first `most` networks, exact forms first, then larger networks. nodes needs network_ord."""
    if len(query) < 2:
        return nodes.limit(0).select("network_id", "network_ord", "id", "form", F.lit(0).cast("long").alias("n_nodes"), F.lit(False).alias("exact"))
    q = query.lower()
    hit = F.lower("form").contains(q) | F.lower(F.array_join("meanings", " ")).contains(q)
    found = nodes.groupBy("network_id", "network_ord").agg(F.min_by(F.when(hit, F.struct("id", "form")), F.when(hit, F.col("node_ord"))).alias("x"), F.count("*").alias("n_nodes")).where("x is not null")
    first = found.orderBy("network_ord").limit(most)
    return first.select("network_id", "network_ord", "x.id", "x.form", "n_nodes", (F.lower("x.form") == q).alias("exact")).orderBy(F.desc("exact"), F.desc("n_nodes"), "network_ord")


def networks_with(nodes: DataFrame, form: str) -> DataFrame:
    """R10."""
    return nodes.where(F.col("form") == form).select("network_id").distinct()


def random_network(networks: DataFrame, seed: int) -> DataFrame:
    """The network of smallest hash under a seed; ties by id."""
    return networks.orderBy(F.md5(F.concat(F.col("network_id").cast("string"), F.lit(f"/{seed}"))), "network_id").limit(1)


def missing_attribute(nodes: DataFrame, column: str, *by: str) -> DataFrame:
    """how many rows lack an attribute, in total or by group."""
    return nodes.groupBy(*by).agg(F.count_if(F.col(column).isNull()).alias("missing"), F.count("*").alias("n"))


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(check, n): ends that don't exist, unknown types, self loops, repeated ids."""
    lost = lambda end: edges.join(nodes.select("network_id", F.col("id").alias(end)), ["network_id", end], "left_anti").agg(F.count("*").alias("n")).select(F.lit(f"{end} exists").alias("check"), "n")
    rows = [
        lost("from"), lost("to"),
        edges.agg(F.count_if(~F.col("type").isin(*EDGE_TYPES)).alias("n")).select(F.lit("type known").alias("check"), "n"),
        edges.agg(F.count_if(F.col("from") == F.col("to")).alias("n")).select(F.lit("no self loop").alias("check"), "n"),
        nodes.groupBy("network_id", "id").count().agg(F.count_if(F.col("count") > 1).alias("n")).select(F.lit("ids differ").alias("check"), "n"),
    ]
    return reduce(DataFrame.unionByName, rows)


def sequential_ids(df: DataFrame, prefix: str, *order: str | Column, column: str = "id", start: int = 1) -> DataFrame:
    """Prefix and a number of five digits or more in order; numbered within ranges of the order, so that no task sorts all rows."""
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    w = Window.partitionBy("__part").orderBy(*order)
    base = ranged.groupBy("__part").count()
    base = base.select("__part", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    return ranged.withColumn("__n", F.row_number().over(w)).join(F.broadcast(base), "__part").withColumn(column, F.format_string(prefix + "%05d", F.col("__base") + F.col("__n") + (start - 1))).drop("__part", "__n", "__base")
