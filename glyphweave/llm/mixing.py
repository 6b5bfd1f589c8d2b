"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words: a share of RATE times all words by its weight, at most CAP times its own words, the
excess going to the others by weight. Every document of a source is taken a certain whole number of times (the whole
part of target / words). The rest is a Pareto sample of a fixed size, in words: documents have unequal inclusion probabilities, in
proportion to a weight (by default the logarithm of their size: a longer document tells more, but not by its length), scaled so
that the words that a source may expect are those it lacks; where a probability would exceed 1 the document is certain, and the others share
the rest. Each document has a uniform number U from its id, its rank is the odds of U over the odds of its inclusion probability,
and documents are taken by rank as far as they fit into the words that are left: one that doesn't fit is passed over. In the end one more
document closes the gap, if any comes nearer to the target than none.

Ranks meet in BUCKETS buckets: a grouped sum finds the bucket in which a source's target falls, and only that
bucket's documents (one in BUCKETS) are put in order. No source, however large, is sorted in one task. Each document that is passed
over ends a stretch of ranks; the next stretch goes through the same steps, until nothing fits (a few stretches, since the gap shrinks).

Edge cases: null text has no words and is taken the certain number of times; sources are put in order by code point, null last; a source
without words has target 0; ties in rank go by doc_id and text; repeated rows share their number U; an empty table
gives an empty result. All on DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphweave.llm._expr import words
from glyphweave.session import cut

#: Fixed by the contract: weights by rank of the source, share of all words, most times its words.
WEIGHTS, RATE, CAP = (3, 1, 2), 1.5, 2
BUCKETS = 16384


def targets(sizes: DataFrame) -> DataFrame:
    """(source, words, target) from (source, size): water-filling over the sources in order of the level at which each is full."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("words"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")))
    full = Window.orderBy((F.col("words") * F.lit(CAP) / F.col("weight")), F.col("source").asc_nulls_last())
    every = full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("words").over(every) * F.lit(RATE) - F.lit(CAP) * F.coalesce(F.sum("words").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    open_ = F.first(F.when(F.col("level") * F.col("weight") <= CAP * F.col("words"), F.col("level")), ignorenulls=True).over(every)
    s = s.withColumn("level", level).withColumn("open", open_)
    return s.select("source", "words", F.when(F.col("words") == 0, F.lit(0.0)).otherwise(F.least(F.lit(float(CAP)) * F.col("words"), F.coalesce("open", F.lit(float("inf"))) * F.col("weight"))).alias("target"))


def uniform(key: Column) -> Column:
    """A number in (0, 1) from a key's MD5: the same on every run and engine."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def _scale(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """(__k, scale): the factor from weight to inclusion probability in each source; water-filling from the heaviest documents on. Weights are whole
    numbers, so that a source has few of them and sums are exact."""
    w = rows.where("size > 0").groupBy("source", "weight").agg(F.sum("size").alias("words")).join(goal.where("rest > 0").select("__source", "need"), F.col("source").eqNullSafe(F.col("__source")))
    down = Window.partitionBy("source").orderBy(F.desc("weight"))
    every = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    onward = down.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    scale = (F.col("need") - F.coalesce(F.sum("words").over(before), F.lit(0))) / F.sum(F.col("weight") * F.col("words")).over(onward)
    w = w.withColumn("scale", scale).withColumn("scale", F.first(F.when(F.col("scale") * F.col("weight") <= 1, F.col("scale")), ignorenulls=True).over(every))
    return w.select(F.col("source").alias("__k"), "scale").distinct()


def _stretches(ranked: DataFrame, goal: DataFrame) -> DataFrame:
    """(__s, gap, stretches): what a source still lacks in the end, and the stretches of ranks (after, before, most) in which documents of at most `most` words are taken."""
    place = F.struct("rank", "doc_id", "text_key")
    kind = ranked.select(place.alias("p")).schema["p"].dataType.simpleString()
    none = F.lit(None).cast(kind)
    state = cut(goal.where("rest > 0").select(F.col("__source").alias("__s"), F.col("need").alias("gap"), none.alias("after"), F.array().cast(f"array<struct<after:{kind},before:{kind},most:double>>").alias("stretches"), F.lit(True).alias("open")))
    while state.where("open").take(1):
        seen = ranked.join(state.where("open").drop("stretches"), F.col("source").eqNullSafe(F.col("__s"))).where((F.col("size") <= F.col("gap")) & (F.col("after").isNull() | (place > F.col("after"))))
        sums = seen.groupBy("__s", "gap", "bucket").agg(F.sum("size").alias("size"))
        over = Window.partitionBy("__s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        edge = sums.withColumn("upto", F.sum("size").over(over)).where(F.col("upto") > F.col("gap")).groupBy("__s").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("size")).alias("sum")), "bucket").alias("edge"))
        edge = edge.select(F.col("__s").alias("__e"), F.col("edge.bucket").alias("__b"), F.col("edge.sum").alias("sum"))
        inside = Window.partitionBy("__s").orderBy("rank", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        close = seen.join(edge, F.col("__s").eqNullSafe(F.col("__e")) & (F.col("bucket") == F.col("__b"))).withColumn("upto", F.col("sum") + F.sum("size").over(inside))
        stop = close.where(F.col("upto") > F.col("gap")).groupBy("__s").agg(F.min_by(F.struct(place.alias("before"), (F.col("upto") - F.col("size")).alias("took")), place).alias("stop")).select(F.col("__s").alias("__t"), "stop")
        whole = sums.groupBy(F.col("__s").alias("__w")).agg(F.sum("size").alias("whole"))
        met = state.join(stop, F.col("__s").eqNullSafe(F.col("__t")), "left").join(whole, F.col("__s").eqNullSafe(F.col("__w")), "left")
        this = F.struct("after", F.col("stop.before").alias("before"), F.col("gap").alias("most"))
        took = F.coalesce("stop.took", "whole", F.lit(0))
        state = cut(met.select("__s", F.when(F.col("open"), F.col("gap") - took).otherwise(F.col("gap")).alias("gap"), F.col("stop.before").alias("after"), F.when(F.col("open"), F.array_append("stretches", this)).otherwise(F.col("stretches")).alias("stretches"), (F.col("open") & F.col("stop").isNotNull() & (F.col("gap") - took >= 1)).alias("open")))
    return state.select("__s", "gap", "stretches")


def mix(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """(doc_id, text_key, source, size, source_size, target, copies), one row for each row of docs. weight: relative chance of a document, to 1/64."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "source", F.size(words(F.col("text"))).cast("long").alias("size"), *([weight.cast("double").alias("weight")] if weight is not None else []))
    chance = F.col("weight") if weight is not None else F.ln(F.col("size") + 2)
    rows = cut(rows.withColumn("weight", F.greatest(F.round(chance * 64).cast("long"), F.lit(1).cast("long"))))
    goal = targets(rows)
    ratio = F.col("target") / F.greatest(F.col("words"), F.lit(1))
    goal = goal.select(F.col("source").alias("__source"), "words", "target", F.floor(ratio).alias("certain"), (ratio - F.floor(ratio)).alias("rest")).withColumn("need", F.col("target") - F.col("certain") * F.col("words"))
    goal = cut(goal)
    scale = cut(_scale(rows, goal))
    p, u = F.col("scale") * F.col("weight"), uniform(F.col("doc_id"))
    rank = F.when(p >= 1, 0.0).otherwise((u / (1 - u)) / (p / (1 - p)))
    ranked = rows.where("size > 0").join(scale, F.col("source").eqNullSafe(F.col("__k"))).select("doc_id", "text_key", "source", "size", rank.alias("rank"))
    ranked = cut(ranked.withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS).cast("int")))
    found = _stretches(ranked, goal)
    place = F.struct("rank", "doc_id", "text_key")
    in_stretch = lambda x: (F.col("size") <= x["most"]) & (x["after"].isNull() | (place > x["after"])) & (x["before"].isNull() | (place < x["before"]))
    marked = cut(ranked.join(found, F.col("source").eqNullSafe(F.col("__s"))).select("doc_id", "text_key", "source", "size", "rank", "gap", F.exists("stretches", in_stretch).alias("taken")))
    fit = marked.where(~F.col("taken") & (F.col("size") < 2 * F.col("gap"))).groupBy("source").agg(F.min_by(F.struct("doc_id", "text_key"), F.struct(F.abs(F.col("gap") - F.col("size")), "rank", "doc_id", "text_key")).alias("fit"))
    last = fit.select(F.col("source").alias("__source"), "fit.doc_id", "fit.text_key")
    more = marked.where("taken").select(F.col("source").alias("__source"), "doc_id", "text_key").unionByName(last).distinct()
    more = more.select(F.col("__source").alias("__m"), F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.lit(1).cast("long").alias("more"))
    done = rows.join(goal, F.col("source").eqNullSafe(F.col("__source"))).join(more, F.col("source").eqNullSafe(F.col("__m")) & F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("text_key").eqNullSafe(F.col("__key")), "left")
    return done.select("doc_id", "text_key", "source", "size", F.col("words").alias("source_size"), "target", (F.col("certain") + F.coalesce("more", F.lit(0).cast("long"))).alias("copies"))


def mix_report(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, all columns as they are."""
    plan = mix(docs).where("copies > 0").groupBy("doc_id", "text_key", "source").agg(F.max("copies").cast("int").alias("__copies"))
    plan = plan.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("source").alias("__s"), "__copies")
    marked = docs.join(plan, docs["doc_id"].eqNullSafe(plan["__id"]) & (F.xxhash64(docs["text"]) == plan["__key"]) & docs["source"].eqNullSafe(plan["__s"]))
    return marked.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(0), F.col("__copies"))).alias("__n")).drop("__n")
