"""Shards by fixed virtual slots: records hash into thousands of slots that never change, and a versioned map says which shard has a slot.

A record's slot is decided by its id alone. Bytes are added up per slot, map-side first, so that what reaches the driver is one number a slot.
The first map deals slots by size, largest first, to the lightest shard. Later maps are edits: as few slots as needed move until
the shards are even again (`rebalanced`), or a new shard takes its part from the others (`grown`). Every version stays readable, and a
writer whose version was written by another meanwhile starts again from that one (`ShardMaps`).

A slot that alone weighs much (one id repeated, or ids missing, in a large share of the rows) is a hot slot: its records are spread
over parts by a hash of the record and its place, and each part has a shard of its own in the map.

Edge cases: a null text has size 1; a null id hashes as an empty text; repeated rows are records of their own; an empty table gives an empty
result and a map of empty slots; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from glyphweave.session import cut, release
from glyphweave.sources import shared_files

#: A slot is hot if it has MANY records and more than 1 / HOT of an even shard; it has PARTS parts.
SLOTS, HOT, MANY, PARTS = 4096, 16, 1024, 64
#: An even map has no shard more than EVEN above the mean, if its slots allow it.
EVEN = 0.01

Key = tuple[int, int]


def _hash(value: Column, modulus: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(value), 1, 12), 16, 10).cast("long"), F.lit(modulus))


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, slot, hash, tag): tag is the row's place in what is written, and parts rows that are alike."""
    text, name = F.coalesce("text", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), _hash(name.cast("binary"), slots).cast("int").alias("slot"), F.md5(name.cast("binary")).alias("hash"))
    return cut(rows.withColumn("tag", F.monotonically_increasing_id()))


def loads_of(rows: DataFrame, shards: int, known: frozenset[int] = frozenset()) -> tuple[dict[Key, int], set[int]]:
    """(bytes by (slot, part), hot slots). No more slots turn hot than HOT * shards at a time; those known as hot stay so, and their records where they are."""
    by_slot = {r.slot: r for r in rows.groupBy("slot").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    whole = sum(r.size for r in by_slot.values())
    hot = {s for s, r in by_slot.items() if s in known or r.n >= MANY and r.size * HOT * shards > whole}
    loads = {(s, 0): r.size for s, r in by_slot.items() if s not in hot}
    if hot:
        parts = rows.where(F.col("slot").isin(*hot)).groupBy("slot", _part(hot).alias("part")).agg(F.sum("size").alias("size"))
        loads |= {(r.slot, r.part): r.size for r in parts.collect()}
    return loads, hot


def _part(hot: set[int]) -> Column:
    spread = _hash(F.concat_ws(":", "hash", "text_crc32", "tag").cast("binary"), PARTS).cast("int")
    return F.when(F.col("slot").isin(*hot), spread).otherwise(F.lit(0)) if hot else F.lit(0)


def first_map(loads: dict[Key, int], shards: int, slots: int = SLOTS) -> dict[Key, int]:
    """Slots with records go to the lightest shard, largest first; empty ones in turn."""
    heap = [(0, j) for j in range(shards)]
    out = {(s, 0): s % shards for s in range(slots)}
    for key, size in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
        weight, j = heapq.heappop(heap)
        out[key] = j
        heapq.heappush(heap, (weight + size, j))
    return out


def rebalanced(held: dict[Key, int], loads: dict[Key, int], shards: int, even: float = EVEN) -> dict[Key, int]:
    """held with slots moved from the heaviest to the lightest shard, the one first that best closes the gap, until no shard is more than even above the mean.

    A slot that held doesn't know (a part of a slot that turned hot) goes to the lightest shard. No record of an unmoved slot moves.
    """
    out, weight = dict(held), [0] * shards
    inside: list[list[tuple[int, Key]]] = [[] for _ in range(shards)]
    new = []
    for key, size in loads.items():
        if key in out and out[key] < shards:
            weight[out[key]] += size
            inside[out[key]].append((size, key))
        else:
            new.append((size, key))
    for size, key in sorted(new, key=lambda x: (-x[0], x[1])):
        j = weight.index(min(weight))
        out[key] = j
        weight[j] += size
        inside[j].append((size, key))
    out |= {k: k[0] % shards for k, j in out.items() if j >= shards}
    limit = sum(weight) / shards * (1 + even)
    while (top := max(weight)) > limit:
        a, b = weight.index(top), weight.index(min(weight))
        gap = top - weight[b]
        best = min(((abs(gap - 2 * s), k, s) for s, k in inside[a] if 0 < s < gap), default=None)
        if best is None:
            break
        _, key, size = best
        inside[a].remove((size, key))
        inside[b].append((size, key))
        weight[a], weight[b], out[key] = top - size, weight[b] + size, b
    return out


def grown(held: dict[Key, int], loads: dict[Key, int], shards: int) -> dict[Key, int]:
    """held with one more shard, number shards: it takes slots from the heaviest shards, and no slot moves elsewhere."""
    out, weight = dict(held), [0] * shards
    inside: dict[int, list[tuple[int, Key]]] = defaultdict(list)
    for key, j in held.items():
        weight[j] += loads.get(key, 0)
        inside[j].append((loads.get(key, 0), key))
    for j in inside:
        inside[j].sort()
    fair, got, slots = sum(weight) / (shards + 1), 0, 0
    while got < fair or slots < len(held) // (shards + 1):
        a = max(range(shards), key=lambda j: (weight[j], len(inside[j]))) if got < fair else max(range(shards), key=lambda j: len(inside[j]))
        at = next((i for i in range(len(inside[a]) - 1, -1, -1) if got + inside[a][i][0] <= fair), None)
        if at is None:
            break
        size, key = inside[a].pop(at)
        weight[a], got, slots, out[key] = weight[a] - size, got + size, slots + 1, shards
    return out


class ShardMaps:
    """Versions 1, 2, ... of a map in a folder that all executors share; a version is never changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> list[int]:
        return sorted(int(n.removeprefix("map-").removesuffix(".json")) for n in shared_files.names(self.spark, self.path) if n.startswith("map-"))

    def load(self, version: int) -> tuple[int, dict[Key, int]]:
        """(number of shards, shard by (slot, part))."""
        found = shared_files.load(self.spark, f"{self.path}/map-{version}.json")
        return found["shards"], {(s, p): j for s, p, j in found["map"]}

    def save(self, version: int, shards: int, held: dict[Key, int]) -> bool:
        """False if another writer has made this version."""
        return shared_files.put_new(self.spark, f"{self.path}/map-{version}.json", {"shards": shards, "map": [[*k, j] for k, j in sorted(held.items())]})

    def hot(self) -> frozenset[int]:
        known = self.versions()
        return frozenset(s for s, p in self.load(known[-1])[1] if p) if known else frozenset()

    def settle(self, loads: dict[Key, int], shards: int, slots: int = SLOTS) -> tuple[int, dict[Key, int]]:
        """The version that serves these loads: the newest if it is even enough, else an edit of it, written as the next."""
        while True:
            known = self.versions()
            if not known:
                version, held, new = 0, {}, first_map(loads, shards, slots)
            else:
                version = known[-1]
                was, held = self.load(version)
                new = grown(held, loads, was) if shards == was + 1 else rebalanced(held, loads, shards)
                if new == held and was == shards:
                    return version, held
            if self.save(version + 1, shards, new):
                return version + 1, new


def places(rows: DataFrame) -> DataFrame:
    """rows (with shard) and slot: their place in the shard, gapless from 0. Ranges of a sorted table are numbered, not shards."""
    order = ("shard", "hash", "size", "text_crc32", "tag")
    sorted_ = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    runs = sorted_.groupBy("shard", part.alias("run")).agg(F.min("at").alias("first"), F.count("*").alias("n"))  # one for each shard of a partition
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = cut(runs.select("shard", "run", (before - F.col("first")).alias("shift")))
    return sorted_.withColumn("run", part).join(runs, ["shard", "run"]).withColumn("slot", F.col("at") + F.col("shift"))


def shard(docs: DataFrame, maps: ShardMaps, shards: int = 8, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version), one row per document; law is bytes."""
    rows = slotted(docs, slots)
    loads, hot = loads_of(rows, shards, maps.hot())
    version, held = maps.settle(loads, shards, slots)
    entries = docs.sparkSession.createDataFrame([(s, p, j) for (s, p), j in held.items()], "slot int, part int, shard int")
    placed = rows.withColumn("part", _part(hot)).join(F.broadcast(entries), ["slot", "part"])  # at most slots + HOT * shards * PARTS entries
    done = places(placed.withColumnRenamed("slot", "virtual_slot"))
    release(rows)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version"))
