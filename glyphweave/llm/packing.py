"""Best-fit packing by minimum bin slack.

The plan needs lengths alone, and a length is at most the capacity: so the driver sees a histogram of at most 4096
counts, however many documents there are. Bin by bin, a subset-sum over the lengths left (a bitset in one Python
integer, from the longest length that must go first) finds the fullest feasible combination; the combination is
then used as often as the counts allow, which uses up at least one length, so the plan has no more patterns than
there are lengths. Pieces are numbered within their length by counts per input partition, and each finds its
pattern, bin and offset by its number: no sort, and no task holds more than its own pieces.

Edge cases: null text counts as empty and gives one piece that holds the end id alone; only documents longer than
the capacity are cut, into whole-capacity pieces and a rest; repeated rows are packed each; an empty table gives an
empty result. Other columns are not read, except those named in keep.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from glyphweave.llm._tokens import WordIds
from glyphweave.session import cut

CAPACITY, END = 4096, 1


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> Iterator[tuple[dict[int, int], int]]:
    """(combination: how often each length, bins that are filled so), until no piece is left."""
    left = {n: c for n, c in counts.items() if c}
    order = sorted(left, reverse=True)
    mask = (1 << capacity + 1) - 1
    while left:
        order = [n for n in order if n in left]
        longest = order[0]
        room = capacity - longest
        usable = [(n, min(left[n] - (n == longest), room // n)) for n in order if n <= room]
        reach, steps = 1, []  # reach: bit s is set if lengths so far can sum to s
        for n, most in usable:
            k = 1
            while most > 0 and not reach >> room & 1:  # multiples in powers of two
                k = min(k, most)
                steps.append((reach, n, k))
                reach |= reach << n * k & mask
                most -= k
                k *= 2
            if reach >> room & 1:
                break
        total = (reach & (1 << room + 1) - 1).bit_length() - 1
        found = {longest: 1}
        for before, n, k in reversed(steps):
            if not before >> total & 1:
                found[n] = found.get(n, 0) + k
                total -= n * k
        times = min(left[n] // k for n, k in found.items())
        yield found, times
        for n, k in found.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, number after the last, first bin, how often in a bin, offset) for each length of each combination."""
    used, bins, slots = dict.fromkeys(counts, 0), 0, []
    for found, times in plan_bins(counts, capacity):
        at = 0
        for n, k in found.items():
            slots.append((n, used[n], used[n] + k * times, bins, k, at))
            used[n] += k * times
            at += n * k
        bins += times
    return slots


def pieces(docs: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece; number: its place among the pieces of its length and input partition."""
    fields = [docs.schema[c] for c in keep]
    out = T.StructType([*fields, T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("number", T.LongType())])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, ids = TaskContext.get().partitionId(), {}, WordIds.at(tokenizer)
        end = END.to_bytes(4, "little")
        for batch in batches:
            row, rest, texts = [], [], [t or b"" for t in batch.column(len(keep)).to_pylist()]
            some = (got for at in range(0, len(texts), 256) for got in ids.of_all(texts[at : at + 256]))
            for k, got in enumerate(some):
                got += end
                for piece, start in enumerate(range(0, len(got), 4 * capacity)):
                    one = got[start : start + 4 * capacity]
                    n = len(one) // 4
                    number = seen.get(n, 0)
                    seen[n] = number + 1
                    row.append(k)
                    rest.append((piece, start // 4, n, zlib.crc32(one), part, number))
            kept = batch.select(list(keep)).take(pa.array(row, pa.int32()))
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(list(c), t) for c, t in zip(zip(*rest, strict=True) if rest else [()] * 6, types, strict=True))], names=out.names)

    return docs.select(*keep, F.col("text").cast("binary").alias("text")).mapInArrow(cut_up, out)


def pack(docs: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY) -> DataFrame:
    """keep, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    rows = cut(pieces(docs, tokenizer, keep, capacity))
    tally = cut(rows.groupBy("length", "part").agg(F.count("*").alias("n")))
    counts = {r.length: r.n for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = tally.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # base grows with the input's partitions, so it is never broadcast; a key holds at most one partition's pieces
    numbered = rows.join(base.hint("merge"), ["length", "part"]).withColumn("number", F.col("base") + F.col("number"))
    slots = pd.DataFrame(plan_slots(counts, capacity), columns=["length", "from", "to", "bin", "times", "at"]).astype("int64")
    slots = spark.createDataFrame(slots, "length long, from long, to long, bin long, times long, at long")
    # A length has few slots, so they travel as one array per length; all slots together are at most a small multiple of capacity rows.
    by_length = slots.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("from", "to", "bin", "times", "at"))).alias("slots"))
    placed = numbered.join(F.broadcast(by_length), "length").withColumn("slot", F.element_at(F.filter("slots", lambda x: (x["from"] <= F.col("number")) & (F.col("number") < x["to"])), 1))
    nth = F.col("number") - F.col("slot.from")
    return placed.select(
        *keep, "piece", "start", "length", "ids_crc32",
        (F.col("slot.bin") + F.floor(nth / F.col("slot.times"))).alias("sequence_id"),
        (F.col("slot.at") + (nth % F.col("slot.times")) * F.col("length")).alias("offset"),
    )
