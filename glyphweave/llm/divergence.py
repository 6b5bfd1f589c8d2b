"""How the sources of a language differ in their words: exact divergences from dense term-block tiles.

Tasks count terms by (lang, source) in dictionaries that are emptied when full; Spark adds those counts. The terms of a language that
are in enough of its documents are dealt by hash into blocks. A block becomes one tile, a dense int64 matrix of every source of the
language by the block's terms, zeros included; all pairs of its rows are compared at once by broadcasting, a bounded number of cells at a
time. A block gives its partial matrix of pairs, which Spark sums over the blocks, and per source a heap of its best terms, which a
ranked window merges (Spark prunes it to the limit before the shuffle).

A share is 1 + floor(10**9 * (count + 1) / (N + V)), a divergence the sum of floor((p - q)**2 / q). Shares of one group sum to at most
10**9 + V, so each sum fits a long; the quotients are taken by long division in steps of 1000, exact up to N + V of 9 * 10**15.

Edge cases: null text, lang and source are empty strings, and an empty string is a group like any other; texts without terms
leave their group with a count of zero for each kept term; a language without kept terms has pairs of value 0 and no terms; repeated rows
are documents of their own; ties are in order of the item's UTF-8 bytes; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from glyphweave.session import cut, release

#: Terms of a block at most, cells of a tile and of a broadcast at most, entries of a task's dictionaries before they are passed on.
TERMS, CELLS, HELD = 1024, 2**21, 200_000
#: ASCII letters in lower case and all bytes of other characters stay; the rest parts terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split(b" ")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial (lang, source, term, n, docs); an empty term stands for the group itself."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            del n[b""], docs[b""]
            found = [b"", *n]
            many = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * many, pa.string()), pa.array([source] * many, pa.string()), pa.array(found, pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            found = terms(text)
            n.update(found)
            docs.update(set(found))
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from passed_on()
    yield from passed_on()


def share(count: np.ndarray, whole: np.ndarray | int, kinds: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / (whole + kinds)), exactly: long division, three digits at a time."""
    by = np.asarray(whole, np.int64) + kinds
    quotient, rest = np.divmod(count + 1, by)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, by)
        quotient = quotient * 1000 + digit
    return quotient + 1


def _tile(most: int, cells: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, counts: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        lang, block = key
        sources = groups["source"].tolist()
        whole, kinds = groups["total"].to_numpy(np.int64), int(groups["kinds"].iloc[0])
        named, column = np.unique(counts["term"].to_numpy(object), return_inverse=True)  # in order of their bytes
        tile = np.zeros((len(sources), len(named)), np.int64)
        tile[counts["source"].map({s: i for i, s in enumerate(sources)}).to_numpy(np.int64), column] = counts["n"].to_numpy(np.int64)
        out: list[tuple] = []
        if len(named) or not block:  # the first block speaks for languages without terms
            p = share(tile, whole[:, None], kinds) if len(named) else tile
            pairs = np.zeros((len(sources), len(sources)), np.int64)
            step = max(1, cells // max(1, p.size))
            for i in range(0, len(sources), step):
                apart = p[i : i + step, None, :] - p[None]
                pairs[i : i + step] = (apart * apart // p[None]).sum(2)
            items = [s.encode() for s in sources]
            out += [(lang, s, "pair", items[j], int(pairs[i, j])) for i, s in enumerate(sources) for j in range(len(sources)) if i != j]
        if len(named):
            q = share(tile.sum(0), int(whole.sum()), kinds)
            for i, s in enumerate(sources):
                at = np.flatnonzero((tile[i] > 0) & (p[i] > q))
                value = (p[i, at] - q[at]) ** 2 // q[at]
                out += [(lang, s, "term", named[at[k]], int(value[k])) for k in np.argsort(-value, kind="stable")[:most]]
        return pd.DataFrame(out, columns=["lang", "source", "part", "item", "value"])

    return run


def divergence(docs: DataFrame, least_docs: int = 3, most_terms: int = 200, block_terms: int = TERMS, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): part pair has every other source of the lang, part term the source's leading terms."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    texts = docs.select(empty("lang"), empty("source"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    partial = texts.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    counts = cut(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    of_term = Window.partitionBy("lang", "term")
    kept = counts.where("length(term) > 0").withColumn("all", F.sum("docs").over(of_term)).withColumn("first", F.min("source").over(of_term) == F.col("source"))
    kept = cut(kept.where(F.col("all") >= least_docs).select("lang", "source", "term", "n", "first"))
    size = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("kinds"))
    groups = counts.where("length(term) = 0").select("lang", "source").join(size, ["lang", "source"], "left").select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "kinds")])
    groups = cut(groups)
    per_block = F.greatest(F.least(F.lit(block_terms), F.floor(F.lit(cells) / F.col("sources"))), F.lit(1))
    langs = groups.groupBy("lang").agg(F.sum("kinds").alias("kinds"), F.count("*").alias("sources"))
    langs = cut(langs.select("lang", "kinds", F.greatest(F.ceil(F.col("kinds") / per_block), F.lit(1)).alias("blocks")))
    dealt = kept.join(langs.select("lang", "blocks"), "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "source", "term", "n")
    beside = groups.drop("kinds").join(langs, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "total", "kinds")
    tiles = dealt.groupBy("lang", "block").cogroup(beside.groupBy("lang", "block")).applyInPandas(_tile(most_terms, cells), "lang string, source string, part string, item binary, value long")
    tiles = cut(tiles)
    release(counts, kept, groups, langs)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = tiles.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(by_value))
    best = tiles.where("part = 'term'").withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= most_terms)
    return pairs.unionByName(best).withColumn("item", F.col("item").cast("string"))
