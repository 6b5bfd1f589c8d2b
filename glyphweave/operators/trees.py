"""Trees from depth lists, and nested ones for export: X4e, W8, M7d."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def parents(rows: DataFrame, *by: str, levels: int | None = None) -> DataFrame:
    """rows (by, ord, depth) with parent: the ordinal of the nearest earlier row that is less deep.

    One window serves all depths. levels: how many there are, where known; a deeper row then stops the query. Without it they are counted first.
    """
    if levels is None:
        levels = (rows.agg(F.max("depth")).first()[0] or 0) + 1
    deep = F.when(F.col("depth") >= levels, F.raise_error(F.lit(f"depth beyond {levels} levels")).cast("int"))
    rows = rows.withColumn("depth", F.coalesce(deep, F.col("depth")))
    w = Window.partitionBy(*by).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("depth") == d, F.col("ord")), ignorenulls=True).over(w).alias(f"__d{d}") for d in range(levels)]
    seen = rows.select("*", *last)
    return seen.select(*rows.columns, F.array_max(F.array(*[F.when(F.lit(d) < F.col("depth"), F.col(f"__d{d}")) for d in range(levels)])).alias("parent"))


def parents_by_stack(rows: DataFrame, *by: str) -> DataFrame:
    """As parents(), by the older rule: the stack is cut to `depth` entries, so that after a gap in depth a row may hang below its neighbour.

    The fold goes over one list's rows, which are one page's.
    """
    begin = F.struct(F.array().cast("array<int>").alias("stack"), F.array().cast("array<struct<ord:int,depth:int,parent:int>>").alias("out"))

    def step(acc, x):
        kept = F.slice(acc["stack"], F.lit(1), x["depth"])
        parent = F.when(F.size(kept) > 0, F.element_at(kept, -1))
        return F.struct(F.array_append(kept, x["ord"]).alias("stack"), F.array_append(acc["out"], F.struct(x["ord"].alias("ord"), x["depth"].alias("depth"), parent.alias("parent"))).alias("out"))

    lists = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("ord").cast("int").alias("ord"), F.col("depth").cast("int").alias("depth")))).alias("x"))
    return lists.select(*by, F.inline(F.aggregate("x", begin, step, lambda acc: acc["out"])))


#: A tree as a flat list: parents come before their children.
FLAT = "array<struct<ord:int,parent_ord:int,level:int,language:string,word:string>>"


def nested(flat: Column) -> Column:
    """M7d: a flat list of descendants as a VARIANT array of trees {language, word, level, children}, in order; null stays null.

    One fold from the last entry to the first: an entry's children are whole when it is met, since parents come before them. It goes over one row's list, without a
    shuffle. An entry whose parent is not before it is a root.
    """
    at = lambda x: F.coalesce(F.when(x["parent_ord"] < x["ord"], x["parent_ord"]), F.lit(-1))
    head = lambda x: F.regexp_replace(F.to_json(F.struct(F.coalesce(x["language"], F.lit("")).alias("language"), F.coalesce(x["word"], F.lit("")).alias("word"), x["level"].alias("level"))), r"\}$", "")
    # below: the written children by parent, an entry of a map each
    begin = F.map_from_arrays(F.array(F.lit(-1)), F.array(F.lit("")))

    def step(below: Column, x: Column) -> Column:
        node = F.concat(head(x), F.lit(',"children":['), F.coalesce(F.try_element_at(below, x["ord"]), F.lit("")), F.lit("]}"))
        known = F.coalesce(F.try_element_at(below, at(x)), F.lit(""))
        joined = F.concat(node, F.when(known == "", "").otherwise(","), known)
        return F.map_concat(F.map_filter(below, lambda k, _: (k != at(x)) & (k != x["ord"])), F.create_map(at(x), joined))

    return F.parse_json(F.aggregate(F.reverse(flat), begin, step, lambda below: F.concat(F.lit("["), F.try_element_at(below, F.lit(-1)), F.lit("]"))))


def flat(tree: Column) -> Column:
    """A VARIANT array of trees as the flat list that nested() takes. For a column that is read from somewhere: Spark can't hand one that nested() makes in the same step to Python."""

    @F.pandas_udf(FLAT)
    def walk(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[dict] | None:
            if not isinstance(text, str):
                return None
            out: list[dict] = []
            todo = [(x, None) for x in reversed(json.loads(text))]
            while todo:
                x, parent = todo.pop()
                here = len(out)
                out.append({"ord": here, "parent_ord": parent, "level": x.get("level"), "language": x.get("language"), "word": x.get("word")})
                todo += [(child, here) for child in reversed(x.get("children") or [])]
            return out

        return texts.map(one)

    return walk(F.to_json(tree))
