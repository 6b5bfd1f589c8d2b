"""Sources and sinks: S1-S10, S12, K1-K6, F8."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from glyphweave.session import cut

CORPUS = "hieroglyphs string, transliteration string, UPOS string, lemmatization string, glossing string, translation string, dateNotBefore string, dateNotAfter string"
# Languages that can be fetched, and the headings of their sections.
SECTIONS = {"egyptian": "Egyptian", "demotic": "Demotic", "coptic": "Coptic"}


def ordered(df: DataFrame, name: str = "ord") -> DataFrame:
    """An ordinal that follows the order of files and of rows within them, without a sort."""
    return df.withColumn(name, F.monotonically_increasing_id())


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """S7, M1."""
    return ordered(spark.read.schema(CORPUS).json(path), "sent_ord")


def read_keyed_json(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """An object of objects as (key, value, ord); a repeated key keeps its first place and last value."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.from_json("value", f"map<string,{value_schema}>")).alias("ord", "key", "value"))
    return rows.groupBy("key").agg(F.max_by("value", "ord").alias("value"), F.min("ord").alias("ord"))


def read_titles(spark: SparkSession, path: str, language: str) -> DataFrame:
    """The cached title list (a JSON array, or an object that holds one), without category pages."""
    if language.lower() not in SECTIONS:
        raise ValueError(f"unknown language {language}")
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"(?s)^[^\[]*(\[.*\])[^\]]*$", "$1").alias("a"))
    rows = text.select(F.posexplode(F.from_json("a", "array<string>")).alias("lemma_ord", "title"))
    return rows.where(~F.col("title").startswith("Category:"))


class StatusError(RuntimeError):
    pass


def check_status(status: int, body: str) -> str:
    """S3."""
    if status >= 400:
        raise StatusError(f"{status}: {body[:1000]}")
    return body


def list_members(get: Callable[[dict], dict], category: str, limit: int = 500, retries: int = 5, wait: float = 5.0) -> Iterator[str]:
    """Titles of a category, page by page; each page is tried `retries` times at most."""
    more: dict = {}
    while True:
        for turn in range(retries):
            try:
                data = get({"action": "query", "list": "categorymembers", "cmtitle": category, "cmlimit": limit, "format": "json"} | more)
                break
            except Exception:
                if turn == retries - 1:
                    raise
                time.sleep(wait)
        yield from (m["title"] for m in data.get("query", {}).get("categorymembers", []) if not m["title"].startswith("Category:"))
        if "continue" not in data:
            return
        more = {"cmcontinue": data["continue"]["cmcontinue"]}


def page_text(data: dict) -> str | None:
    """The wikitext in an answer; None for a missing page, revision, slot or content."""
    for page in data.get("query", {}).get("pages", {}).values():
        for revision in page.get("revisions", [])[:1]:
            return revision.get("slots", {}).get("main", {}).get("*")
    return None


def fetch_pages(titles: DataFrame, get: Callable[[str], dict], retries: int = 3, pause: float = 1.5) -> DataFrame:
    """(title, full_wikitext) by get(title), with waits of 1, 2, 4 ... between tries. get must be picklable; tests stub it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for title in pdf["title"]:
                text = None
                for turn in range(retries):
                    try:
                        text = page_text(get(title))
                        break
                    except Exception:  # a page that can't be had is a null row, by contract
                        time.sleep(2**turn * bool(pause))
                out.append(text)
                time.sleep(pause)
            yield pd.DataFrame({"title": pdf["title"], "full_wikitext": out})

    return titles.select("title").mapInPandas(run, "title string, full_wikitext string")


def language_section(text, language: str):
    """The first level-two section of a language, else the whole text."""
    found = F.regexp_extract(text, rf"(?s)(?:^|\n)(==\s*{language}\s*==[^=].*?)(?=\n==[^=]|\z)", 1)
    return F.coalesce(F.nullif(found, F.lit("")), text)


def unseen(titles: DataFrame, done: DataFrame, key: str = "title") -> DataFrame:
    """S6, R9."""
    return titles.join(done.select(key).distinct(), key, "left_anti")


def column_text(words: DataFrame) -> DataFrame:
    """Words (page, ord, x0, word) as page text, left column first; the columns part at the mean x0 of the page."""
    mean = words.groupBy("page").agg(F.avg("x0").alias("middle"))
    side = words.join(mean, "page").withColumn("right", F.col("x0") >= F.col("middle"))
    return side.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("right", "ord", "word"))), lambda x: x["word"]), " ").alias("text"))


def accumulate_pages(pages: DataFrame, first: int = 5, end: str = "}") -> DataFrame:
    """Pages (page, text) from the first on as blocks that run up to a page that ends in `end`; (block, page: the last, text joined without a separator).

    Other columns tell books apart.
    """
    by = tuple(c for c in pages.columns if c not in ("page", "text"))
    closed = F.col("text").endswith(end).cast("int")
    rows = pages.where(F.col("page") >= first).withColumn("text", F.trim("text"))
    if by:
        w = Window.partitionBy(*by).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("block", F.coalesce(F.sum(closed).over(w), F.lit(0)))
    else:  # one book: blocks are counted within ranges of pages, and the ranges' counts are added up
        rows = cut(rows.repartitionByRange("page").withColumn("__part", F.spark_partition_id()))
        n = rows.groupBy("__part").agg(F.sum(closed).alias("__n"))
        base = n.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
        w = Window.partitionBy("__part").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("block", F.coalesce(F.sum(closed).over(w), F.lit(0))).join(F.broadcast(base), "__part")  # a row for each range
        rows = rows.withColumn("block", F.col("block") + F.col("__base"))
    return rows.groupBy(*by, "block").agg(F.max("page").alias("page"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "").alias("text"))


def read_if_there(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A table, or an empty one of its schema."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """K1: the newest row of each key, by version; new rows win ties."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    row = F.struct(*[c for c in old.columns if c not in key])
    return both.groupBy(*key).agg(F.max_by(row, F.struct(version, "__new")).alias("x")).select(*key, "x.*").select(*old.columns)


def upsert_path(spark: SparkSession, path: str, new: DataFrame, key: list[str], version: str) -> None:
    """K1 on a table: written beside the old one, which gives way when the new one is whole.

    At each moment one of path, path.next (whole, since it bears the success mark) and path.last holds a whole table; what a crash left is set right
    by the next call.
    """
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = {k: fs_path(path + k) for k in ("", ".next", ".last")}

    if not fs.exists(at[""]) and fs.exists(fs_path(path + ".next/_SUCCESS")):
        fs.rename(at[".next"], at[""])
    elif not fs.exists(at[""]) and fs.exists(at[".last"]):
        fs.rename(at[".last"], at[""])
    merged = upsert(read_if_there(spark, path, new.schema), new, key, version)
    merged.write.mode("overwrite").parquet(path + ".next")
    if fs.exists(at[""]):
        fs.delete(at[".last"], True)
        fs.rename(at[""], at[".last"])
    fs.rename(at[".next"], at[""])
    fs.delete(at[".last"], True)


def append(df: DataFrame, path: str) -> None:
    """K2."""
    df.write.mode("append").parquet(path)


def overwrite_json(df: DataFrame, path: str) -> None:
    """K3, K4: one object a line."""
    df.write.mode("overwrite").json(path)


def nested_networks(networks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K5, K6: one row per network with its nodes and edges in order, for exchange as JSON."""
    gather = lambda df, order, name: df.groupBy("network_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*[c for c in df.columns if c != "network_id"]).alias("x")))), lambda x: x["x"]).alias(name))
    return networks.join(gather(nodes, "node_ord", "nodes"), "network_id", "left").join(gather(edges, "edge_ord", "edges"), "network_id", "left")
