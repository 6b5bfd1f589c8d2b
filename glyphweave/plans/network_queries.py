"""Queries over networks and graphs made from the driver's parts: the older builder's passes, ancestry of all roots, keyword index, large objects; and SQL that states their rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphweave.operators import graph as g, keyword_index, lexicon as lex, networks as nw, passes, wikitext as wt
from glyphweave.session import deal, shared_dir, table
from glyphweave.sources import objects

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_NL = " || chr(10) || "
#: Pages of the older builder, for part k: an Egyptian word e<k>, each fourth of them an alternative form of the one before; a Demotic d<k>; a Coptic q<k> that
#: descends from Demotic (k % 3 = 0), is borrowed (1), or is an alternative form of the one before (2).
_OLD_EGYPTIAN = _NL.join([
    "'==Egyptian=='", "'===Etymology==='", "'{{compound|egy|w' || p_partkey || '}}{{suffix|egy|-t}}'", "'===Noun==='", "CASE WHEN p_partkey % 4 = 3 THEN '# [L] Alternative form of e' || (p_partkey - 1) || '.' ELSE '# m' || p_partkey END",
    "'====Alternative forms===='", "'{{egy-hieroforms|A1|read1=a' || p_partkey || '|date1=New Kingdom|B1|read2=b' || p_partkey || '|date2=Old Kingdom|B2|read3=b' || p_partkey || '|date3=6th Dynasty|C1|read4=p' || p_partkey || '|date4=Old Kingdom|note4=plural}}'",
    "'====Descendants===='", "'* {{desc|egx-dem|d' || p_partkey || '}}'", "'** {{desc|cop|deep}}'", "'* {{desc|cop|c' || p_partkey || '}}'",
])
_OLD_DEMOTIC = _NL.join(["'==Demotic=='", "'===Etymology==='", "'{{inh|egx-dem|egy|w' || p_partkey || '}}'", "'===Noun==='", "'# md' || p_partkey", "'====Descendants===='", "'* {{desc|cop|q' || p_partkey || '}}'"])
_OLD_COPTIC = _NL.join([
    "'==Coptic=='", "'===Etymology==='", "CASE p_partkey % 3 WHEN 0 THEN '{{der|cop|egx-dem|d' WHEN 1 THEN '{{bor|cop|grc|g' ELSE '{{der|cop|egx-dem|no' END || p_partkey || '}}{{alter|cop|v' || p_partkey || '|B}}{{affix|cop|x-|v' || p_partkey || '}}'",
    "'===Noun==='", "CASE WHEN p_partkey % 3 = 2 THEN '# Alternative form of q' || (p_partkey - 1) ELSE '# mq' || p_partkey END", "'====Derived terms===='", "'{{l|cop|t' || p_partkey || '}}'",
])


def _older(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The senses of the older builder's pages."""
    part = deal(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    page = lambda title, code, text: part.select(F.col("p_partkey").alias("lemma_ord"), F.concat(F.lit(title), F.col("p_partkey").cast("string")).alias("title"), F.lit(code).alias("language"), F.expr(text).alias("full_wikitext"))
    pages = page("e", "Egyptian", _OLD_EGYPTIAN).union(page("d", "Demotic", _OLD_DEMOTIC)).union(page("q", "Coptic", _OLD_COPTIC))
    codes = F.create_map(*[F.lit(x) for x in ("Egyptian", "egy", "Demotic", "dem", "Coptic", "cop")])
    return wt.senses(wt.parse_pages(pages)).withColumn("language", codes[F.col("language")])


# A word's own Egyptian network (e), that of its plural (p), the Demotic (d) and Coptic (q) ones. Alternative forms of Coptic words join the first network that
# holds the word named: the Demotic one, since its word has the Coptic one below it.
_E = "SELECT p_partkey AS k, 'e' || p_partkey AS net FROM part WHERE p_partkey % 4 <> 3"
_Q = "SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 2 AND p_partkey > (SELECT min(p_partkey) FROM part) THEN 'd' || (p_partkey - 1) ELSE 'q' || p_partkey END AS net FROM part"
_ALT = "SELECT p_partkey AS k, 'e' || (p_partkey - 1) AS net FROM part WHERE p_partkey % 4 = 3"
_OLD_NODES = f"""
WITH e AS ({_E}), alt AS ({_ALT}), q AS ({_Q}), d AS (SELECT p_partkey AS k, 'd' || p_partkey AS net FROM part)
SELECT net, 'egy' AS language, 'e' || k AS form, 'Noun' AS part_of_speech, 'm' || k AS meanings, NULL AS period, NULL AS dialect FROM e
UNION ALL SELECT net, 'egy', 'e' || k, 'Noun', '[L] Alternative form of e' || (k - 1) || '.', NULL, NULL FROM alt
UNION ALL SELECT net, 'egy', 'e' || (k - 1), 'Noun', '', NULL, NULL FROM alt WHERE k - 1 NOT IN (SELECT k FROM e)
UNION ALL SELECT net, 'egy', 'a' || k, 'Noun', 'm' || k, 'New Kingdom', NULL FROM e UNION ALL SELECT net, 'egy', 'b' || k, 'Noun', 'm' || k, x, NULL FROM e, (VALUES ('Old Kingdom'), ('6th Dynasty')) t(x)
UNION ALL SELECT 'p' || k, 'egy', 'p' || k, 'Noun', 'm' || k, 'Old Kingdom', NULL FROM e
UNION ALL SELECT net, 'egy', 'w' || k, 'word', '', NULL, NULL FROM e UNION ALL SELECT net, 'egy', '-t', 'morpheme', '', NULL, NULL FROM e
UNION ALL SELECT net, 'dem', 'd' || k, 'Noun', '', NULL, NULL FROM e UNION ALL SELECT net, 'cop', 'c' || k, 'Noun', '', NULL, NULL FROM e
UNION ALL SELECT net, 'dem', 'd' || k, 'Noun', 'md' || k, NULL, NULL FROM d UNION ALL SELECT net, 'cop', 'q' || k, 'Noun', '', NULL, NULL FROM d
UNION ALL SELECT net, 'egy', 'w' || k, CASE WHEN k % 4 = 3 THEN 'Noun' ELSE 'word' END, '', NULL, NULL FROM d
UNION ALL SELECT net, 'cop', 'q' || k, 'Noun', CASE WHEN k % 3 = 2 THEN 'Alternative form of q' || (k - 1) ELSE 'mq' || k END, NULL, NULL FROM q
UNION ALL SELECT net, 'cop', 'v' || k, 'Noun', CASE WHEN k % 3 = 2 THEN 'Alternative form of q' || (k - 1) ELSE 'mq' || k END, NULL, 'Bohairic' FROM q
UNION ALL SELECT net, 'cop', 't' || k, 'Noun', '', NULL, NULL FROM q
UNION ALL SELECT net, 'dem', 'd' || k, 'Noun', '', NULL, NULL FROM q WHERE k % 3 = 0 UNION ALL SELECT net, 'grc', 'g' || k, 'Noun', '', NULL, NULL FROM q WHERE k % 3 = 1
UNION ALL SELECT net, 'cop', 'q' || (k - 1), 'Noun', x, NULL, NULL FROM q, (VALUES (''), ('')) t(x) WHERE k % 3 = 2 AND net LIKE 'q%'
UNION ALL SELECT net, 'cop', 'q' || (k - 1), 'Noun', 'mq' || (k - 1), NULL, NULL FROM q WHERE k % 3 = 2 AND net LIKE 'd%'"""
_OLD_EDGES = f"""
WITH e AS ({_E}), alt AS ({_ALT}), q AS ({_Q}), d AS (SELECT p_partkey AS k, 'd' || p_partkey AS net FROM part)
SELECT net, 'e' || k AS "from", 'b' || k AS "to", 'DESCENDS' AS type, 'First attestation in Old Kingdom' AS notes FROM e
UNION ALL SELECT net, 'e' || (k - 1), 'e' || k, 'VARIANT', 'Alternative form of e' || (k - 1) FROM alt
UNION ALL SELECT net, 'b' || k, 'a' || k, 'EVOLVES', 'Evolution from ' || x || ' to New Kingdom' FROM e, (VALUES ('Old Kingdom'), ('6th Dynasty')) t(x)
UNION ALL SELECT net, 'b' || k, 'b' || k, 'VARIANT', 'Hieroglyphic variant (6th Dynasty)' FROM e
UNION ALL SELECT net, 'a' || k, x || k, 'DESCENDS', NULL FROM e, (VALUES ('d'), ('c')) t(x)
UNION ALL SELECT net, 'w' || k, 'e' || k, 'COMPONENT', 'compound component: w' || k FROM e UNION ALL SELECT net, '-t', 'e' || k, 'COMPONENT', 'suffix: -t' FROM e
UNION ALL SELECT net, 'w' || k, 'd' || k, 'DESCENDS', NULL FROM d UNION ALL SELECT net, 'd' || k, 'q' || k, 'DESCENDS', NULL FROM d
UNION ALL SELECT net, CASE k % 3 WHEN 0 THEN 'd' ELSE 'g' END || k, 'q' || k, 'DESCENDS', NULL FROM q WHERE k % 3 < 2
UNION ALL SELECT net, 'q' || (k - 1), 'q' || k, 'VARIANT', 'Alternative form of q' || (k - 1) || x FROM q, (VALUES (''), (' (from definition)')) t(x) WHERE k % 3 = 2
UNION ALL SELECT net, 'q' || k, 'v' || k, 'VARIANT', NULL FROM q UNION ALL SELECT net, 'q' || k, 't' || k, 'DERIVED', 'Derived from q' || k FROM q
UNION ALL SELECT net, 'v' || k, 'q' || k, 'DERIVED', 'Affixed with affix' FROM q
UNION ALL SELECT net, CASE k % 3 WHEN 0 THEN 'd' ELSE 'no' END || k, 'v' || k, 'DESCENDS', 'Coptic base word from Demotic' FROM q WHERE k % 3 <> 1"""


def _form(c: str):
    return F.split_part(F.col(c), F.lit("\u001f"), F.lit(2))


@query(_OLD_NODES)
def older_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes after the three passes and the merge, each with its network's root form."""
    return passes.older_nodes(_older(spark, sf_dir)).select(_form("network_id").alias("net"), "language", "form", "part_of_speech", F.array_join("meanings", "/").alias("meanings"), "period", "dialect")


@query(_OLD_EDGES)
def older_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after the three passes, the merge and the rerouting, by the forms of their ends."""
    return passes.older_networks(_older(spark, sf_dir)).edges.select(_form("network_id").alias("net"), _form("from").alias("from"), _form("to").alias("to"), "type", "notes")


# One network a brand: its parts in order, each descending from the one before; every part whose size is a multiple of ten leads back three parts (a cycle), each
# seventh is a variant of its neighbour, and components come in from the next brand's part of the same place.
_GRAPH = """WITH p AS (SELECT p_brand, p_size, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
e AS (SELECT 'n' || p_partkey AS a, 'n' || lead(p_partkey) OVER w AS b, 'DESCENDS' AS type, p_brand, i FROM p WINDOW w AS (PARTITION BY p_brand ORDER BY i)
  UNION ALL SELECT 'n' || p_partkey, 'n' || lag(p_partkey, 3) OVER w, CASE WHEN p_size % 10 = 0 THEN 'EVOLVES' ELSE 'BORROWED' END, p_brand, i FROM p WINDOW w AS (PARTITION BY p_brand ORDER BY i)
  UNION ALL SELECT 'n' || p_partkey, 'v' || p_partkey, CASE WHEN p_size % 7 = 0 THEN 'VARIANT' ELSE 'COMPONENT' END, p_brand, i FROM p
  UNION ALL SELECT 'x' || p_partkey, 'v' || p_partkey, 'COMPONENT', p_brand, i FROM p WHERE p_size % 7 = 0)"""


@query(f"""{_GRAPH.replace('WITH', 'WITH RECURSIVE', 1)}, steps AS (SELECT b AS x, a AS y FROM e WHERE type IN ('DESCENDS', 'EVOLVES', 'COMPONENT') AND b IS NOT NULL UNION SELECT a, b FROM e WHERE type = 'VARIANT' UNION SELECT b, a FROM e WHERE type = 'VARIANT'),
roots AS (SELECT 'n' || arg_max(p_partkey, i) AS id FROM p GROUP BY p_brand),
up(seed, node) AS (SELECT id, id FROM roots UNION SELECT seed, y FROM up JOIN steps ON x = node)
SELECT seed, node FROM up""")
def ancestry_of_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ancestry of every network's root at once, over chains as deep as a brand has parts, with cycles and siblings. The root is the last part here."""
    part = table(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey")
    part.createOrReplaceTempView("__parts")
    edges = spark.sql(_GRAPH.replace("FROM part)", "FROM __parts)") + " SELECT p_brand AS network_id, a AS `from`, b AS `to`, type FROM e WHERE b IS NOT NULL")
    nodes = part.select(F.col("p_brand").alias("network_id"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("id"), (-F.col("p_partkey")).alias("node_ord"))
    return g.root_ancestries(nodes, edges)


@query("""
WITH n AS (SELECT p_brand, p_partkey, p_name AS form, lower(p_name) AS f, lower(p_type || ' ' || p_brand) AS m, dense_rank() OVER (ORDER BY p_size, p_brand) AS o, count(*) OVER (PARTITION BY p_size, p_brand) AS n FROM part),
q AS (SELECT unnest(['re', 'red', 'blue ring', 'steel', 'l brand', 'nowhere', 'x']) AS q),
h AS (SELECT q, o, min(n) AS n_nodes, arg_min(form, p_partkey) AS form, arg_min(f = q, p_partkey) AS exact FROM q, n WHERE length(q) >= 2 AND (contains(f, q) OR contains(m, q)) GROUP BY q, o),
t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY o) AS r FROM h)
SELECT q AS query, o AS network_ord, form, n_nodes, exact FROM t WHERE r <= 50""")
def keyword_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 by postings: the first fifty networks in order with each of seven queries, by an index on disk."""
    part = table(spark, sf_dir, "part")
    nets = part.select("p_size", "p_brand").distinct()
    keyed = lex.numbered(nets.select(F.struct("p_size", "p_brand").alias("net")), "net").withColumnRenamed("id", "network_ord")
    nodes = part.select(F.struct("p_size", "p_brand").alias("net"), F.col("p_partkey").alias("node_ord"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("form"), F.array("p_type", "p_brand").alias("meanings")).join(keyed, "net")
    nodes = nodes.select(F.concat_ws("/", "net.p_size", "net.p_brand").alias("network_id"), "network_ord", "node_ord", "id", "form", "meanings")
    path = fresh(spark, "keyword-index")
    keyword_index.build(nodes, path)
    found = [keyword_index.search(spark, path, q).select(F.lit(q).alias("query"), "network_ord", "form", "n_nodes", "exact") for q in ("re", "red", "blue ring", "steel", "l brand", "nowhere", "x")]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@query("""SELECT 'k' || p_partkey AS key, p_name || '}' AS x, '"' || p_brand AS y, CAST(p_size AS INTEGER) AS z FROM part""")
def large_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of objects, one a file, without a line break, written by partitions and read again by byte ranges; braces, quotes and backslashes inside of strings."""
    path = fresh(spark, "large-objects")
    value = F.struct(F.concat("p_name", F.lit("}")).alias("x"), F.struct(F.concat(F.lit('"'), "p_brand").alias("y"), F.array(F.lit("\\"), F.lit("{,")).alias("w")).alias("inner"), F.col("p_size").cast("int").alias("z"))
    objects.write_objects(table(spark, sf_dir, "part").select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"), value.alias("value")), path)
    return objects.read_objects(spark, path, "struct<x:string,inner:struct<y:string>,z:int>").select("key", "value.x", "value.inner.y", "value.z")


#: Pages of several shapes, for part k by k % 6: derived terms below the etymology (0), numbered etymologies with a gap (1), malformed and orphaned descendants (2), a part of
#: speech without an etymology and a heading out of place (3), a page of another language (4), no text (5).
_SHAPES = "CASE p_partkey % 6 " + " ".join(
    f"WHEN {k} THEN {_NL.join(lines)}"
    for k, lines in enumerate([
        ["'==Egyptian=='", "'===Etymology==='", "'From {{m|egy|a' || p_partkey || '}} and more.'", "'===Derived terms==='", "'* {{l|egy|d' || p_partkey || '}}'", "'{{col3|egy|x|d' || p_partkey || '}}'", "'===Noun==='", "'# m' || p_partkey", "'===Verb==='", "'# v' || p_partkey", "'====Derived terms===='", "'* {{l|egy|own}}'"],
        ["'==Egyptian=='", "'===Etymology 1==='", "'first'", "'====Noun===='", "'# m' || p_partkey", "'===Etymology 3==='", "'third'", "'====Noun===='", "'# lost'"],
        ["'==Egyptian=='", "'===Noun==='", "'# m' || p_partkey", "'====Descendants===='", "'** {{desc|cop|orphan}}'", "'* {{desc|cop|c' || p_partkey", "'* {{desc|egx-dem|e' || p_partkey || '}}'", "'** {{desc|cop|f}} {{desc|cop|g}}'", "'* {{desc|cop}}'"],
        ["'===Etymology==='", "'stray'", "'==Egyptian=='", "'===Noun==='", "'# m' || p_partkey", "'#: quoted'", "'==Latin=='", "'===Noun==='", "'# other'"],
        ["'==Latin=='", "'===Noun==='", "'# other'"],
    ])
) + " END"


@query("""
SELECT p_partkey AS lemma_ord, 0 AS def_idx, 'Noun' AS part_of_speech, 'From {{m|egy|a' || p_partkey || '}} and more.' AS etymology, 'm' || p_partkey AS meanings, 'd' || p_partkey || '|x' AS derived, '' AS descendants FROM part WHERE p_partkey % 6 = 0
UNION ALL SELECT p_partkey, 1, 'Verb', 'From {{m|egy|a' || p_partkey || '}} and more.', 'v' || p_partkey, 'own|d' || p_partkey || '|x', '' FROM part WHERE p_partkey % 6 = 0
UNION ALL SELECT p_partkey, 0, 'Noun', 'first', 'm' || p_partkey, '', '' FROM part WHERE p_partkey % 6 = 1
UNION ALL SELECT p_partkey, 0, 'Noun', '', 'm' || p_partkey, '', 'e' || p_partkey || '|f|g' FROM part WHERE p_partkey % 6 = 2
UNION ALL SELECT p_partkey, 0, 'Noun', '', 'm' || p_partkey, '', '' FROM part WHERE p_partkey % 6 = 3""")
def page_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X6, X9, X4e, X10, X11 on pages of six shapes, missing texts among them."""
    part = deal(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    pages = part.select(F.col("p_partkey").alias("lemma_ord"), F.col("p_name").alias("title"), F.lit("Egyptian").alias("language"), F.expr(_SHAPES).alias("full_wikitext"))
    s = wt.senses(wt.parse_pages(pages)).where("def_idx is not null")
    joined = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    return s.select("lemma_ord", "def_idx", "part_of_speech", F.coalesce(F.trim("etymology_text"), F.lit("")).alias("etymology"), joined("meanings").alias("meanings"), joined("derived_terms").alias("derived"), joined(F.transform("descendants", lambda d: d["word"])).alias("descendants"))


#: An Egyptian word for part k: plain (k % 3 = 0), an alternative form alone (1), or an alternative form beside a verb (2).
_ROOTS = _NL.join(["'==Egyptian=='", "'===Noun==='", "CASE WHEN p_partkey % 3 = 0 THEN '# m' ELSE '# Alternative form of w' END || p_partkey"]) + " || CASE WHEN p_partkey % 3 = 2 THEN chr(10) || '===Verb===' || chr(10) || '# v' || p_partkey ELSE '' END"


@query("""SELECT 'w' || p_partkey AS root, 1 AS n_nodes, CASE WHEN p_partkey % 3 = 0 THEN 'm' ELSE 'v' END || p_partkey AS meanings FROM part WHERE p_partkey % 3 <> 1""")
def network_roots_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """senses that only refer to another form are no roots, and a word of such senses alone has no network."""
    part = deal(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    pages = part.select(F.col("p_partkey").alias("lemma_ord"), F.concat(F.lit("w"), F.col("p_partkey").cast("string")).alias("title"), F.lit("Egyptian").alias("language"), F.expr(_ROOTS).alias("full_wikitext"))
    nets, nodes, _ = nw.build_networks(wt.senses(wt.parse_pages(pages)).withColumn("language", F.lit("egy")))
    about = nodes.groupBy("network_id").agg(F.count("*").alias("n_nodes"), F.max(F.array_join("meanings", "/")).alias("meanings"))
    return nets.join(about, "network_id").select(F.col("root_lemma").alias("root"), "n_nodes", "meanings")
