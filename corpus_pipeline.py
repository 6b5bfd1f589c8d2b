"""From raw documents to packed training sequences: five operators, one after the other.

Each stage works on all that the one before it kept and returns the columns of documents; the last returns the packed
pieces. Rejected documents go (quality rules), recurring lines go, and documents with nothing left (line dedup), one document of
each near-duplicate group stays (five-word shingles, Jaccard 0.8 or more), documents are repeated or dropped to meet their
source's target (mixing), and the result is cut and packed into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from glyphweave.llm import jaccard, lines, mixing, packing, quality
from glyphweave.session import cut, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_rejected(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.drop_recurring(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs, n=5, num=80, den=100)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram jaccard join", jaccard_stage),
    ("mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Shingles, scatter estimates and subword ids have no SQL form; tests hold the pipeline against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
