"""Chronological operators on forms (entity, type, rank, ord, node): W1-W6, A4, A5.

Rows are the dated and undated forms of an entity (a network's definition). rank is as period_rank() gives it: below 500
a period, 500 an unknown date, 999 none. ord is the order of the source. Everything groups or windows by entity and type,
so one shuffle on the entity serves all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphweave.functions.tables import NO_DATE, OTHER_DATE


def _edge(source, target, kind, notes) -> list[Column]:
    return [source.alias("from"), target.alias("to"), kind.alias("type"), notes.alias("notes")]


def _periods(forms: DataFrame, *by: str) -> DataFrame:
    dated = forms.where(F.col("rank") < OTHER_DATE)
    return dated.groupBy(*by, "rank").agg(F.min_by("node", "ord").alias("first"), F.max_by("node", "ord").alias("last"))


def forms_by_period(forms: DataFrame, *by: str) -> DataFrame:
    """A4: forms of each type and period in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "node"))), lambda x: x["node"])
    return forms.groupBy(*by, "type", "rank").agg(ordered.alias("nodes"))


def temporal_chain(forms: DataFrame, *by: str) -> DataFrame:
    """The last form of each period evolves into the first form of the next."""
    w = Window.partitionBy(*by, "type").orderBy("rank")
    steps = _periods(forms, *by, "type").withColumn("next", F.lead("first").over(w))
    return steps.where("next is not null").select(*by, *_edge(F.col("last"), F.col("next"), F.lit("EVOLVES"), F.col("type")))


def first_attestation(forms: DataFrame, *by: str) -> DataFrame:
    """From the main form to the first form of the earliest period; EVOLVES for base forms, DERIVED otherwise. forms needs a column main."""
    first = forms.where(F.col("rank") < OTHER_DATE).groupBy(*by, "type").agg(F.min_by(F.struct("main", "node"), F.struct("rank", "ord")).alias("x"))
    return first.select(*by, *_edge(F.col("x.main"), F.col("x.node"), F.when(F.col("type") == "base", "EVOLVES").otherwise("DERIVED"), F.col("type")))


def same_period_variants(forms: DataFrame, *by: str) -> DataFrame:
    """Pairs of forms of one type and period, in order.

    The pairs are the result; what bounds them is the number of attested forms of one definition in one period. They come from a join on the period, so that none is held in a list.
    """
    key = [*by, "type", "rank"]
    dated = forms.where(F.col("rank") < OTHER_DATE)
    later = dated.select(*key, F.col("ord").alias("__ord"), F.col("node").alias("__node"))
    return dated.join(later, key).where(F.col("ord") < F.col("__ord")).select(*by, *_edge(F.col("node"), F.col("__node"), F.lit("VARIANT"), F.lit("same period")))


def undated_variants(forms: DataFrame, *by: str) -> DataFrame:
    """Where a type has no dated form, from the main form to each undated one."""
    dated = F.max(F.when(F.col("rank") != NO_DATE, 1).otherwise(0)).over(Window.partitionBy(*by, "type"))
    rows = forms.withColumn("dated", dated).where("dated = 0")
    return rows.select(*by, *_edge(F.col("main"), F.col("node"), F.when(F.col("type") == "base", "VARIANT").otherwise("DERIVED"), F.lit("undated")))


def latest_base(forms: DataFrame, *by: str) -> DataFrame:
    """The last base form of the highest dated period, else the main form."""
    best = F.max_by(F.when((F.col("type") == "base") & (F.col("rank") < OTHER_DATE), F.col("node")), F.when((F.col("type") == "base") & (F.col("rank") < OTHER_DATE), F.struct("rank", "ord")))
    return forms.groupBy(*by).agg(F.coalesce(best, F.min("main")).alias("latest"))


def in_period_order(forms: DataFrame, *by: str) -> DataFrame:
    """Forms with their place by period rank, in source order within a rank."""
    return forms.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("rank", "ord")))


def adjacent_variants(mains: DataFrame, *by: str) -> DataFrame:
    """Neighbouring parts of speech of one entry."""
    rows = mains.withColumn("next", F.lead("node").over(Window.partitionBy(*by).orderBy("ord")))
    return rows.where("next is not null").select(*by, *_edge(F.col("node"), F.col("next"), F.lit("VARIANT"), F.lit("part of speech")))


def canonical_spelling(forms: DataFrame, spelling: str, *by: str) -> DataFrame:
    """A5: the most frequent spelling of each period; the first on ties."""
    n = forms.groupBy(*by, spelling).agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    return n.groupBy(*by).agg(F.max_by(spelling, F.struct("n", -F.col("ord"))).alias("canonical"), F.max("n").alias("n"))


def evolution_edges(forms: DataFrame, *by: str) -> DataFrame:
    """W1-W4 together."""
    out = temporal_chain(forms, *by)
    for f in (first_attestation, same_period_variants, undated_variants):
        out = out.unionByName(f(forms, *by))
    return out
