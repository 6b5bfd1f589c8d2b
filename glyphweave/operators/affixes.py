"""Words and the variants that start or end them, by sorted runs.

In sorted order the variants that start a word stand before it, each a beginning of the next: a chain, which a stack holds while one scan
goes over words and variants together. Ranges of the order are scanned by themselves; what starts a range's first string in earlier ranges starts the chain of that
range, and is found by a join on that one string's beginnings. For ends the same is done with all strings reversed. So each distinct word is
shuffled as one row for each side, however long it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from glyphweave.session import cut, release

FOUND = "word string, lemma_ord long, variant_ord long, lemma_id string, translit string"


def _order(x: object) -> tuple:
    """Nulls first, as Spark compares."""
    return (x is not None and x == x, x if x is not None and x == x else 0)


def _scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of part, s and kind (variants first): each word with the first variant of its chain."""
    part, stack = None, []
    for pdf in parts:
        out = []
        for at, s, kind, lemma_ord, variant_ord, lemma_id in zip(*(pdf[c] for c in ("part", "s", "kind", "lemma_ord", "variant_ord", "lemma_id")), strict=True):
            if at != part:
                part, stack = at, []
            while stack and not s.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                rank = (_order(lemma_ord), _order(variant_ord), _order(lemma_id))
                best = (rank, s, lemma_ord, variant_ord, lemma_id)
                if stack and (stack[-1][1][0], stack[-1][1][1]) < (rank, s):
                    best = stack[-1][1]
                stack.append((s, best))
            elif stack:
                _, translit, *found = stack[-1][1]
                out.append((s, *found, translit))
        yield pd.DataFrame(out, columns=["word", "lemma_ord", "variant_ord", "lemma_id", "translit"]).astype({"lemma_ord": "Int64", "variant_ord": "Int64"})


def _side(words: DataFrame, firsts: DataFrame, turn: Callable[[Column], Column]) -> DataFrame:
    """(word, ..., translit): the first variant of each word that starts it, after turn."""
    variants = firsts.select(turn(F.col("translit")).alias("s"), F.lit(0).alias("kind"), "lemma_ord", "variant_ord", "lemma_id")
    none = [F.lit(None).cast(variants.schema[c].dataType).alias(c) for c in ("lemma_ord", "variant_ord", "lemma_id")]
    rows = variants.unionByName(words.select(turn(F.col("word")).alias("s"), F.lit(1).alias("kind"), *none))
    placed = cut(rows.repartitionByRange("s").withColumn("part", F.spark_partition_id()))
    heads = placed.groupBy("part").agg(F.min("s").alias("head"))  # a row for each range
    begins = heads.select("part", F.explode(F.transform(F.sequence(F.lit(1), F.length("head")), lambda k: F.substring(F.col("head"), F.lit(1), k))).alias("s"))
    carried = placed.where("kind = 0").withColumnRenamed("part", "own").join(begins, "s").where("own < part").drop("own")
    ordered = placed.unionByName(carried).repartition("part").sortWithinPartitions("part", "s", "kind")
    found = cut(ordered.mapInPandas(_scan, FOUND))
    release(placed)
    return found.select(turn(F.col("word")).alias("word"), "lemma_ord", "variant_ord", "lemma_id", turn(F.col("translit")).alias("translit"))


def affix_match(words: DataFrame, variants: DataFrame) -> DataFrame:
    """words (word, ...) with match (lemma_id, translit): the first variant (translit, lemma_ord, variant_ord, lemma_id) that equals, starts or ends the word; null without one.

    Empty translits match nothing; of variants with equal ordinals the lower lemma id and then the lower translit wins.
    """
    firsts = cut(variants.where("translit <> ''").groupBy("translit").agg(F.min(F.struct("lemma_ord", "variant_ord", "lemma_id")).alias("m")).select("translit", F.col("m.lemma_ord").cast("long").alias("lemma_ord"), F.col("m.variant_ord").cast("long").alias("variant_ord"), F.col("m.lemma_id").cast("string").alias("lemma_id")))
    distinct = cut(words.where(F.length("word") > 0).select("word").distinct())
    both = _side(distinct, firsts, lambda c: c).unionByName(_side(distinct, firsts, F.reverse))
    best = both.groupBy("word").agg(F.min_by(F.struct("lemma_id", "translit"), F.struct("lemma_ord", "variant_ord", "lemma_id", "translit")).alias("match"))
    return words.join(best, "word", "left")
