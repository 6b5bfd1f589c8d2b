"""Files that are one object of objects, read and written by many tasks.

A file is read as byte ranges that end at a closing brace, in splits of Spark's own text reader, whatever its line breaks. Where a range lies, inside a
string or not and how deep, depends on all that comes before it: a first pass has each split say what it does to either state, a scan over those
few rows gives each split its start, and a second pass cuts the text at the commas of depth one. The pieces of a member meet by its number, so
what one task holds is one member.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from glyphweave.session import cut

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(")?|[{}\[\],]', re.DOTALL)
_REST = re.compile(r'(?:[^"\\]|\\.)*(")?', re.DOTALL)


def walk(text: str, inside: bool, depth: int) -> tuple[bool, int, list[tuple[int, str]]]:
    """(inside a string at the end, depth at the end, marks): marks are the outer brackets and the commas between members, with their places."""
    marks, at = [], 0
    if inside:
        rest = _REST.match(text)
        if not rest[1]:
            return True, depth, marks
        at = rest.end()
    for token in _TOKEN.finditer(text, at):
        c = text[token.start()]
        if c == '"':
            if not token[1]:
                return True, depth, marks
        elif c in "{[":
            depth += 1
            if depth == 1:
                marks.append((token.start(), "open"))
        elif c in "}]":
            depth -= 1
            if depth == 0:
                marks.append((token.start(), "close"))
        elif depth == 1:
            marks.append((token.start(), "comma"))
    return False, depth, marks


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, text): the text up to each closing brace, in order of at within a block. What follows a file's last brace gets one too many, which changes nothing before it."""
    text = spark.read.option("lineSep", "}").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    return text.select(F.col("file_path").alias("file"), F.col("file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.concat("value", F.lit("}")).alias("text"))


def _effects(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per block, what it does to a start outside and inside of a string."""
    held: dict[tuple[str, int], list] = {}
    for pdf in parts:
        for file, block, text in zip(pdf["file"], pdf["block"], pdf["text"], strict=True):
            state = held.setdefault((file, block), [False, 0, True, 0])
            for k in (0, 2):
                inside, change, _ = walk(text, state[k], 0)
                state[k], state[k + 1] = inside, state[k + 1] + change
    yield pd.DataFrame([(*key, *state) for key, state in held.items()], columns=["file", "block", "out_end", "out_change", "in_end", "in_change"])


def _starts(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state in which each block of a file starts."""
    inside, depth, out = False, 0, []
    for r in pdf.sort_values("block").itertuples():
        out.append((r.file, r.block, inside, depth))
        inside, depth = (r.in_end, depth + r.in_change) if inside else (r.out_end, depth + r.out_change)
    return pd.DataFrame(out, columns=["file", "block", "inside", "depth"])


def _pieces(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(file, block, member, at, k, piece): member counts within the block; what a block starts with belongs to member 0, which may have begun before it."""
    held: dict[tuple[str, int], list] = {}
    for pdf in parts:
        out = []
        for file, block, at, text, inside, depth in zip(*(pdf[c] for c in ("file", "block", "at", "text", "inside", "depth")), strict=True):
            state = held.setdefault((file, block), [bool(inside), int(depth), 0])
            start = 0 if state[1] > 0 else None
            state[0], state[1], marks = walk(text, state[0], state[1])
            for k, (place, what) in enumerate(marks):
                if start is not None and place > start:
                    out.append((file, block, state[2], at, k, text[start:place]))
                state[2] += what != "open"
                start = None if what == "close" else place + 1
            if start is not None and start < len(text):
                out.append((file, block, state[2], at, len(marks), text[start:]))
        yield pd.DataFrame(out, columns=["file", "block", "member", "at", "k", "piece"])


def members(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, text): the members of the objects in each file, as they are written ("key": value); ord counts within the file."""
    ranges = _ranges(spark, path)
    effects = cut(ranges.select("file", "block", "text").mapInPandas(_effects, "file string, block long, out_end boolean, out_change long, in_end boolean, in_change long"))
    starts = effects.groupBy("file").applyInPandas(_starts, "file string, block long, inside boolean, depth long")  # a row for each split of the input
    pieces = cut(ranges.join(F.broadcast(starts), ["file", "block"]).select("file", "block", "at", "text", "inside", "depth").mapInPandas(_pieces, "file string, block long, member long, at long, k int, piece string"))
    # a block's last member goes on as the next block's first
    last = pieces.groupBy("file", "block").agg(F.max("member").alias("n"))
    known = effects.select("file", "block").join(last, ["file", "block"], "left")
    before = F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = known.select("file", "block", before.alias("base"))
    numbered = pieces.join(F.broadcast(base), ["file", "block"]).withColumn("ord", F.col("base") + F.col("member"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "k", "piece"))), lambda x: x["piece"]), "")
    return numbered.groupBy("file", "ord").agg(text.alias("text")).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")


def read_objects(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """(key, value, file, ord) of objects of objects, in files of any size; a key that repeats within a file keeps its first place and last value. A member that is no JSON is left out."""
    rows = members(spark, path).select("file", "ord", F.explode(F.from_json(F.concat(F.lit("{"), F.col("text"), F.lit("}")), f"map<string,{value_schema}>")).alias("key", "value"))
    return rows.groupBy("file", "key").agg(F.max_by("value", "ord").alias("value"), F.min("ord").alias("ord")).select("key", "value", "file", "ord")


def write_objects(df: DataFrame, path: str, key: str = "key", value: str = "value") -> None:
    """K3: one object a partition, with a member for each row of its; keys are text."""
    member = df.select(F.concat(F.to_json(F.array(F.col(key).cast("string"))), F.lit(":"), F.to_json(F.array(value))).alias("value"))
    member = member.select(F.regexp_replace("value", r'^\[(.*?)\]:\[(.*)\]$', "$1:$2").alias("value"))

    def wrapped(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []  # the last member so far, which may have to close the object
        opened = False
        for pdf in parts:
            rows = held + pdf["value"].tolist()
            if rows and not opened:
                rows[0], opened = "{" + rows[0], True
            yield pd.DataFrame({"value": rows[:-1]}, dtype=object)
            held = rows[-1:]
        yield pd.DataFrame({"value": [x + "}" for x in held]}, dtype=object)  # none for a partition without rows

    member.mapInPandas(wrapped, "value string").write.mode("overwrite").option("lineSep", ",").text(path)
