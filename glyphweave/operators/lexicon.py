"""Lexicon, tokens and training sets from an annotated sentence corpus: M1-M5, J1-J5, F1, F2, A1, A2, A6, A7, P10, W9, R2, R6.

A corpus row has parallel strings (hieroglyphs, transliteration, UPOS, lemmatization, glossing, translation, dates), zipped
by token place; every row carries an ordinal, sent_ord.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphweave.functions import text as tx
from glyphweave.operators import trie
from glyphweave.operators.affixes import affix_match  # noqa: F401  J4 is one of the lexicon's joins
from glyphweave.session import cut

MOST_SIGNS = 100_000

FIELDS = ("hieroglyphs", "transliteration", "UPOS", "lemmatization", "glossing", "translation", "dateNotBefore", "dateNotAfter")


def parallel_tokens(corpus: DataFrame) -> DataFrame:
    """(sent_ord, s: the sentence's columns, pos, lemma_id, lemma_form, glyph, translit, upos, gloss), lemmas in the lead, missing parts empty; lemma tokens without | are left out."""
    part = lambda c: F.split(F.trim(F.coalesce(F.col(c), F.lit(""))), tx.ROOM)
    lists = corpus.select("sent_ord", F.struct(*[c for c in corpus.columns if c != "sent_ord"]).alias("s"), part("lemmatization").alias("l"), part("hieroglyphs").alias("g"), part("transliteration").alias("t"), part("UPOS").alias("u"), part("glossing").alias("x"))
    each = lists.select("*", F.posexplode("l").alias("pos", "lemma")).where(F.col("lemma").contains("|"))
    at = lambda c: F.coalesce(F.get(F.col(c), F.col("pos")), F.lit(""))
    return each.select("sent_ord", "s", "pos", F.substring_index("lemma", "|", 1).alias("lemma_id"), F.expr("substring(lemma, instr(lemma, '|') + 1)").alias("lemma_form"), at("g").alias("glyph"), at("t").alias("translit"), at("u").alias("upos"), at("x").alias("gloss"))


def lexicon_tables(corpus: DataFrame, compat: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A1 as three flat tables: lemmas (lemma_ord, lemma_id, lemma, upos, gloss: of the last occurrence), variants (lemma_id, ord, variant: each once) and
    examples (lemma_id, ord, example: one an occurrence). No row grows with a lemma's frequency: for corpora in which some lemma is in a large share of the sentences."""
    a = tx.affixes(F.col("translit"))
    rows = parallel_tokens(corpus).withColumn("a", a).withColumn("ord", F.struct("sent_ord", "pos"))
    variant = F.struct("glyph", "translit", F.col("a.prefixes").alias("prefixes"), F.col("a.suffixes").alias("suffixes"), tx.mixed_codes(F.col("glyph"), compat).alias("gardiner"), "gloss")
    have = {c.lower() for c in corpus.columns}
    extra = lambda c: F.col(f"s.{c}") if c.lower() in have else F.lit(None).cast("string")
    example = F.struct(F.col("s.hieroglyphs").alias("sentence_hiero"), F.col("s.transliteration").alias("sentence_translit"), F.col("s.UPOS").alias("sentence_upos"), extra("glossing").alias("sentence_gloss"), tx.sentence_codes(F.col("s.hieroglyphs"), compat).alias("sentence_gardiner"), extra("translation").alias("translation"), extra("dateNotBefore").alias("dateNotBefore"), extra("dateNotAfter").alias("dateNotAfter"))
    lemmas = rows.groupBy("lemma_id").agg(F.min("ord").alias("lemma_ord"), *[F.max_by(c, "ord").alias(n) for c, n in (("translit", "lemma"), ("upos", "upos"), ("gloss", "gloss"))])
    variants = rows.withColumn("variant", variant).groupBy("lemma_id", "variant").agg(F.min("ord").alias("ord"))
    return lemmas, variants.select("lemma_id", "ord", "variant"), rows.select("lemma_id", "ord", example.alias("example"))


def build_lexicon(corpus: DataFrame, compat: bool = False) -> DataFrame:
    """A1, nested for export: per lemma id the last form, part of speech and gloss, the distinct variants in order, and an example for each occurrence.

    A lemma's examples are one row here; lexicon_tables() keeps them apart.
    """
    lemmas, variants, examples = lexicon_tables(corpus, compat)
    nest = lambda df, c, name: df.groupBy("lemma_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda x: x[c]).alias(name))
    full = lemmas.join(nest(variants, "variant", "glyph_variants"), "lemma_id").join(nest(examples, "example", "examples"), "lemma_id")
    return full.select("lemma_ord", "lemma_id", "lemma", "upos", "gloss", "glyph_variants", "examples")


def lexicon_counts(tokens: DataFrame) -> DataFrame:
    """The lexicon's summary without its lists: (lemma_id, lemma, n_variants, n_examples). Occurrences become a count and a last place per variant first, which combine map-side."""
    each = tokens.groupBy("lemma_id", "translit").agg(F.count("*").alias("n"), F.max(F.struct("sent_ord", "pos")).alias("last"))
    return each.groupBy("lemma_id").agg(F.max_by("translit", "last").alias("lemma"), F.count("translit").alias("n_variants"), F.sum("n").alias("n_examples"))


def numbered(values: DataFrame, column: str, start: int = 1) -> DataFrame:
    """P10, A2: sorted distinct values with ids from start. Vocabularies are numbered by ranges, not in one task."""
    rows = cut(values.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).sortWithinPartitions(column).withColumn("__part", F.spark_partition_id()))
    size = rows.groupBy("__part").count()
    base = size.select("__part", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    w = Window.partitionBy("__part").orderBy(column)
    return rows.withColumn("__n", F.row_number().over(w)).join(F.broadcast(base), "__part").select(column, (F.col("__base") + F.col("__n") + (start - 1)).cast("long").alias("id"))


def first_match(words: DataFrame, variants: DataFrame) -> DataFrame:
    """Each word (key columns and glyph) with its first variant (glyph, lemma_ord, variant_ord, ...) in lexicon order; null without one."""
    order = F.struct("lemma_ord", "variant_ord")
    first = variants.groupBy("glyph").agg(F.min_by(F.struct(*[c for c in variants.columns if c != "glyph"]), order).alias("match"))
    return words.join(first, "glyph", "left")


def fallback_text(words: DataFrame, singles: DataFrame, key: str = "word_id") -> DataFrame:
    """Words code point by code point, each as the transliteration of the first variant with that glyph alone, else ?."""
    each = words.select(key, F.posexplode(F.filter(F.split("glyph", ""), lambda c: c != "")).alias("at", "glyph"))
    found = first_match(each, singles)
    return found.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce(F.col("match.translit"), F.lit("?")).alias("t")))), lambda x: x["t"]), "").alias("text"))


def segment(words: DataFrame, signs: list[str] | DataFrame, most: int = MOST_SIGNS) -> DataFrame:
    """Greedy longest-prefix segmentation against a sign list; unknown code points stand alone. words needs a column glyph.

    A list of signs is bounded by the script: a table (one column) with more than `most` of them is an error. It goes to the tasks as a trie,
    which all places of a batch walk at once.
    """
    if isinstance(signs, DataFrame):
        signs = [r[0] for r in signs.distinct().limit(most + 1).collect() if r[0]]
    if len(signs) > most:
        raise ValueError(f"more than {most} signs")
    made = trie.build(signs)

    @F.pandas_udf("array<struct<glyph:string,known:boolean>>")
    def cut_up(words: pd.Series) -> pd.Series:
        return pd.Series(trie.segments(made, [w if isinstance(w, str) else None for w in words]))

    return words.withColumn("segments", cut_up("glyph"))


def tokens(matched: DataFrame) -> DataFrame:
    """The tokens of matched words (sent_ord, pos, word, lemma, upos, upos_id, gloss, gardiner): prefixes, root and suffixes in order."""
    a = tx.lemma_affixes(F.col("word"), F.coalesce(F.col("lemma"), F.lit("")))
    token = lambda x, kind: F.struct(x.alias("token"), tx.token_type(F.lit(kind), F.col("upos")).alias("type"), F.col("lemma").alias("lemma"), F.col("upos").alias("upos"), F.col("upos_id").alias("upos_id"), F.col("gloss").alias("gloss"), F.col("gardiner").alias("gardiner"))
    rows = matched.withColumn("a", a)
    root = F.when(F.col("lemma").isNull(), token(F.col("word"), "UNKNOWN")).otherwise(token(F.col("a.root"), "ROOT"))
    all_ = F.when(F.col("lemma").isNull(), F.array(root)).otherwise(F.concat(F.transform("a.prefixes", lambda x: token(x, "PREFIX")), F.array(root), F.transform("a.suffixes", lambda x: token(x, "SUFFIX"))))
    return rows.select("sent_ord", "pos", all_.alias("tokens"))


def model_text(token_rows: DataFrame) -> DataFrame:
    """One model string per sentence."""
    all_ = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tokens"))), lambda x: x["tokens"]))
    return token_rows.groupBy("sent_ord").agg(tx.model_string(all_).alias("text"))


def training_examples(corpus: DataFrame, texts: DataFrame, direction: str = "hg2de") -> DataFrame:
    """M5, F2, K4: (input_text, output_text, metadata); pairs with an empty side are left out."""
    if direction not in ("hg2de", "de2hg"):
        raise ValueError(f"unknown direction {direction}")
    full = corpus.join(texts, "sent_ord").where("trim(coalesce(text, '')) <> '' and trim(coalesce(translation, '')) <> ''")
    a, b = ("text", "translation") if direction == "hg2de" else ("translation", "text")
    meta = F.struct(F.col("hieroglyphs").alias("hieroglyph_sentence"), F.col("translation").alias("german_sentence"), F.col("UPOS").alias("upos"), F.col("glossing").alias("gloss"), F.col("lemmatization").alias("lemmatization"))
    return full.select(F.col(a).alias("input_text"), F.col(b).alias("output_text"), meta.alias("metadata"))


def split_by_place(rows: DataFrame, order: str, share: float = 0.9) -> DataFrame:
    """The first share of the rows in order is for training; order must be unique. Places come from counts of ranges, not from one sorted task."""
    placed = numbered(rows.select(order), order)
    n = placed.agg(F.floor(F.count("*") * F.lit(share)).alias("most"))
    return rows.join(placed, order).crossJoin(F.broadcast(n)).withColumn("is_train", F.col("id") <= F.col("most")).drop("id", "most")


def batches(rows: DataFrame, size: int = 8, seed: int = 0, key: str = "sent_ord") -> DataFrame:
    """A random order that repeats for a seed, and the batch of each row."""
    order = rows.select(F.xxhash64(key, F.lit(seed)).alias("shuffled"), "*")
    return order.join(numbered(order, "shuffled", 0), "shuffled").withColumn("batch", F.floor(F.col("id") / size)).drop("shuffled", "id")


def max_token_id(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """A6."""
    return rows.agg(F.max(F.array_max(ids)).alias("max_id"), F.count("*").alias("n"))


def offenders(rows: DataFrame, size: int, order: str, ids: str = "ids", most: int = 20) -> DataFrame:
    """The first rows with an id outside the vocabulary."""
    return rows.where(F.array_max(ids) >= size).orderBy(order).limit(most)


def keyed(column: str) -> Column:
    return F.nullif(F.trim(F.col(column)), F.lit(""))
