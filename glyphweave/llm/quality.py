"""Quality rules: robust multivariate outliers by minimum covariance determinant, per language and source.

A document's counts are worked out inside its own row. A transformed statistic vector follows, in whole thousandths,
so that all sums are exact integers and reruns agree. Each (language, source) group gets the location and the scatter of
the SUBSET (three quarters: up to a quarter of a group may be junk) of its rows whose covariance determinant is least. The search goes by concentration steps
from three starts (medians with quartile ranges; mean and covariance of all rows; correlations of squashed values) until no start's
determinant falls any more; the best start counts. Its estimate is reweighted: mean and covariance of all rows within the
RETAINED quantile of distance from it. A document is rejected by its Mahalanobis distance from that. FLOOR is added to each variance, so that no determinant
is 0. One concentration step is one join with the groups' small table and
one grouped sum over (group, distance bucket): sums combine map-side, so a source with a third of all rows costs no
more per task than any other. A step keeps whole buckets of distance, 64 to a factor of e, up to the one that fills the subset.

Edge cases: null text counts as empty (no words: it fails the base rule); null language or source is a group of its
own; groups with fewer than MIN_GROUP rows use their language's estimate, and languages with fewer use the estimate of
all rows, each made from all rows of the language or the table; when all rows together are fewer than MIN_GROUP, only the base rule decides. Repeated rows are judged alike.
Windows and lines are compared by 64-bit hashes within one document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphweave.llm._expr import let, words
from glyphweave.session import cut

Z = ("z_words", "z_length", "z_symbols", "z_lines", "z_repeats")
#: Least standard deviation of each statistic: differences below it are never held against a document.
FLOOR = (0.5, 0.06, 0.06, 0.15, 0.15)
UNIT = 1000.0
MIN_GROUP = 100
SUBSET, RETAINED = 0.75, 0.975
TAIL = 1e-6
#: A step that lowers a determinant by less than this share is the last.
SETTLED = 1e-3
KEY = ("grp", "start")


def _chi2_cdf(x: float, dof: int) -> float:
    """Regularised lower incomplete gamma, by its series."""
    a, x = dof / 2, x / 2
    term = total = 1 / a
    k = a
    while term > 1e-15 * total:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _chi2_quantile(p: float, dof: int) -> float:
    low, high = 1e-9, 500.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, dof) < p else (low, mid)
    return low


def _repeats(hashes: Column) -> Column:
    """Words inside 8-word windows that occur twice or more."""

    def covered(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(ordered, lambda o: F.filter(o, lambda p, j: F.coalesce(p["h"] == F.get(o, j - 1)["h"], F.lit(False)) | F.coalesce(p["h"] == F.get(o, j + 1)["h"], F.lit(False))))
        starts = F.sort_array(F.transform(again, lambda p: p["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(starts, zero, lambda acc, i: F.struct((acc["n"] + i + 8 - F.greatest(acc["end"], i)).alias("n"), (i + 8).alias("end")), lambda acc: acc["n"])

    windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - 7), lambda i: F.xxhash64(F.slice(hashes, i, 8)))
    return F.when(F.size(hashes) < 9, 0).otherwise(let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w))))


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep, and the counts of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    first = docs.select(*keep, text.alias("__t"), F.transform(words(text), lambda w: F.xxhash64(w)).alias("__h"), F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"))
    lines = F.transform(F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.xxhash64(x))
    return first.select(
        *keep,
        F.size("__h").cast("long").alias("n_words"),
        "word_chars",
        (F.length("__t") - F.length(F.regexp_replace("__t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).alias("dup"), F.size(x).alias("n"))).alias("__l"),
        _repeats(F.col("__h")).cast("long").alias("n_repeat_words"),
    ).select(*keep, "n_words", "word_chars", "n_symbols", F.col("__l.dup").cast("long").alias("n_dup_lines"), "n_repeat_words", F.col("__l.n").cast("long").alias("n_lines"))


def _vector(stats: DataFrame) -> DataFrame:
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    z = (F.log1p("n_words"), F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)), share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"))
    return stats.withColumns({k: F.round(v * UNIT).cast("long") for k, v in zip(Z, z, strict=True)})


def _groups(rows: DataFrame) -> DataFrame:
    """For each (lang, source) the level that judges it (itself, its language or all: the finest of MIN_GROUP rows) and the levels its rows are part of, as far as they judge any."""
    n = rows.groupBy("g_lang", "g_source").count()
    by_lang = n.groupBy("g_lang").agg(F.sum("count").alias("in_lang"), F.max(F.col("count") < MIN_GROUP).alias("lends"))
    every = by_lang.agg(F.sum("in_lang").alias("in_all"), F.max(F.col("in_lang") < MIN_GROUP).alias("all_lends"))
    own, lang = F.to_json(F.struct("g_lang", "g_source")), F.to_json(F.struct("g_lang"))
    levels = F.array(F.when(F.col("count") >= MIN_GROUP, own), F.when(F.col("lends") & (F.col("in_lang") >= MIN_GROUP), lang), F.when(F.col("all_lends") & (F.col("in_all") >= MIN_GROUP), F.lit("{}")))
    return n.join(by_lang, "g_lang").crossJoin(F.broadcast(every)).select(
        "g_lang", "g_source",
        F.when(F.col("count") >= MIN_GROUP, own).when(F.col("in_lang") >= MIN_GROUP, lang).otherwise("{}").alias("grp"),
        F.array_compact(levels).alias("levels"),
    )


def _factor(params: DataFrame) -> DataFrame:
    """Cholesky factor l_ij of the scatter c_ij, and the log of its determinant."""
    for i in range(len(Z)):
        for j in range(i + 1):
            rest = F.col(f"c_{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            params = params.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}{j}"))
    log_det = sum((2 * F.ln(F.col(f"l_{i}{i}")) for i in range(len(Z))), F.lit(0.0))
    return params.select(*[k for k in KEY if k in params.columns], *[f"m_{i}" for i in range(len(Z))], *[f"l_{i}{j}" for i in range(len(Z)) for j in range(i + 1)], log_det.alias("log_det"))


def _distance() -> Column:
    """Squared Mahalanobis distance, by forward substitution inside one struct after another."""
    steps = []
    total = F.lit(0.0)
    for i, z in enumerate(Z):
        v = F.col(z) / UNIT - F.col(f"m_{i}")
        for j in range(i):
            v = v - F.col(f"l_{i}{j}") * steps[j]
        steps.append(v / F.col(f"l_{i}{i}"))
        total = total + steps[-1] * steps[-1]
    return total


PAIRS = [(i, j) for i in range(len(Z)) for j in range(i + 1)]


def _sums(values: list[Column]) -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(v).alias(f"s_{i}") for i, v in enumerate(values)], *[F.sum(values[i] * values[j]).alias(f"p_{i}{j}") for i, j in PAIRS]]


def _covariance(i: int, j: int) -> Column:
    return (F.col(f"p_{i}{j}") / F.col("n") - F.col(f"s_{i}") / F.col("n") * (F.col(f"s_{j}") / F.col("n"))) / UNIT**2


def _estimate(total: DataFrame, share: float) -> DataFrame:
    """Location and scatter from sums over the nearest share of the rows, made consistent for normal ones."""
    factor = share / _chi2_cdf(_chi2_quantile(share, len(Z)), len(Z) + 2) if share < 1 else 1.0
    return total.select(
        *[k for k in KEY if k in total.columns],
        *[(F.col(f"s_{i}") / F.col("n") / UNIT).alias(f"m_{i}") for i in range(len(Z))],
        *[(_covariance(i, j) * factor + (FLOOR[i] ** 2 if i == j else 0.0)).alias(f"c_{i}{j}") for i, j in PAIRS],
    )


def _starts(rows: DataFrame) -> DataFrame:
    """Three estimates of each group. The values are whole numbers in a narrow range, so that the exact percentiles' state is small."""
    quart = rows.groupBy("grp").agg(*[F.expr(f"percentile({z}, array(0.25, 0.5, 0.75))").alias(f"q_{i}") for i, z in enumerate(Z)])
    middle, spread = [F.col(f"q_{i}")[1] / UNIT for i in range(len(Z))], [F.greatest((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / (1.349 * UNIT), F.lit(FLOOR[i])) for i in range(len(Z))]
    quart = cut(quart.select("grp", *[m.alias(f"m_{i}") for i, m in enumerate(middle)], *[x.alias(f"d_{i}") for i, x in enumerate(spread)]))
    place = [f"m_{i}" for i in range(len(Z))]
    scaled = lambda i: F.col(f"d_{i}") ** 2
    plain = quart.select("grp", F.lit(0).alias("start"), *place, *[(scaled(i) if i == j else F.lit(0.0)).alias(f"c_{i}{j}") for i, j in PAIRS])
    every = _estimate(rows.groupBy("grp", F.lit(1).alias("start")).agg(*_sums([F.col(z) for z in Z])), 1.0)
    squashed = rows.join(quart, "grp").select("grp", *[F.round(F.tanh((F.col(z) / UNIT - F.col(f"m_{i}")) / F.col(f"d_{i}")) * UNIT).cast("long").alias(z) for i, z in enumerate(Z)])
    alike = squashed.groupBy("grp").agg(*_sums([F.col(z) for z in Z])).join(quart, "grp")
    correlation = lambda i, j: _covariance(i, j) / F.sqrt((_covariance(i, i) + 1e-6) * (_covariance(j, j) + 1e-6))
    bent = alike.select("grp", F.lit(2).alias("start"), *place, *[((scaled(i) + FLOOR[i] ** 2) if i == j else correlation(i, j) * F.col(f"d_{i}") * F.col(f"d_{j}")).alias(f"c_{i}{j}") for i, j in PAIRS])
    return plain.unionByName(every).unionByName(bent)


def _concentrate(rows: DataFrame, params: DataFrame) -> DataFrame:
    """New location and scatter from the SUBSET nearest rows of each group, whole distance buckets at a time."""
    near = rows.join(params, "grp").withColumn("bucket", F.floor(64 * F.log1p(_distance())))
    sums = near.groupBy(*KEY, "bucket").agg(*_sums([F.col(z) for z in Z]))
    before = Window.partitionBy(*KEY).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    kept = sums.withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0)), "all": F.sum("n").over(Window.partitionBy(*KEY))}).where(F.col("before") < SUBSET * F.col("all"))
    return _estimate(kept.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in kept.columns if c == "n" or c[:2] in ("s_", "p_")]), SUBSET)


def minimum_determinant(rows: DataFrame) -> DataFrame:
    """(grp, m_i, l_ij): reweighted location and Cholesky factor of each group of rows (grp and Z)."""
    state = cut(_factor(_starts(rows)).withColumn("open", F.lit(True)).withColumn("log_det", F.lit(float("inf"))))
    while state.where("open").take(1):  # each step lowers a determinant by a share, and FLOOR bounds it below
        new = _factor(_concentrate(rows, state.where("open").drop("open", "log_det")))
        new = new.select(*KEY, F.struct(*[c for c in new.columns if c not in KEY]).alias("new"))
        old = state.select(*KEY, "open", F.struct(*[c for c in state.columns if c not in (*KEY, "open")]).alias("old"))
        met = old.join(new, list(KEY), "left")
        better = F.coalesce(F.col("new.log_det") < F.col("old.log_det"), F.lit(False))
        state = cut(met.select(*KEY, F.when(better, F.col("new")).otherwise(F.col("old")).alias("x"), (better & (F.col("new.log_det") < F.col("old.log_det") + math.log1p(-SETTLED))).alias("open")).select(*KEY, "x.*", "open"))
    names = [c for c in state.columns if c[:2] in ("m_", "l_")]
    best = state.groupBy("grp").agg(F.min_by(F.struct(*names), F.struct("log_det", "start")).alias("x")).select("grp", "x.*")
    inside = rows.join(best, "grp").where(_distance() <= _chi2_quantile(RETAINED, len(Z)))
    return _factor(_estimate(inside.groupBy("grp").agg(*_sums([F.col(z) for z in Z])), RETAINED)).drop("log_det")


def quality(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the columns in keep, its counts, base_failed, distance (squared; null where only the base rule decides) and kept."""
    docs = docs.select(*keep, "text", F.coalesce(F.col("lang").cast("string"), F.lit("\u0000")).alias("g_lang"), F.coalesce(F.col("source").cast("string"), F.lit("\u0000")).alias("g_source"))
    rows = cut(_vector(statistics(docs, [*keep, "g_lang", "g_source"])))
    rows = cut(rows.join(cut(_groups(rows)), ["g_lang", "g_source"]))  # written first, so that Spark knows its size and need not deal the rows by group
    parts = rows.select(F.explode("levels").alias("grp"), *Z)
    params = cut(minimum_determinant(parts))
    judged = rows.join(params, "grp", "left").withColumn("distance", _distance())
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.coalesce(F.col("distance") <= _chi2_quantile(1 - TAIL, len(Z)), F.lit(True))).alias("kept"),
        "distance",
    )


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The documents that quality() keeps, all columns as they are."""
    marked = docs.select("doc_id", "text", "lang", "source", F.xxhash64("text").alias("__x"))
    gone = quality(marked, ("doc_id", "__x")).where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("__x").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__gone"]), "left_anti")
