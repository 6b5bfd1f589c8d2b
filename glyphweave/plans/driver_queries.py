"""Queries over the driver's tables, each an operator of the library at work, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from glyphweave.functions import lexical as lx, text as tx
from glyphweave.operators import chronology as ch, components as cc, graph as g, lexicon as lex, trees
from glyphweave.session import deal, table
from glyphweave.sources import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SPACES = "[ \\t\\n\\x0b\\f\\r]+"
WORDS = r"list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, word) of all documents."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.array_remove(F.split("text", SPACES), "")).alias("pos", "word"))


DOC_WORDS = f"SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, {WORDS} AS w FROM documents)"


@query(f"""
WITH t AS ({DOC_WORDS}), s AS (SELECT doc_id, pos, word, lower(regexp_replace(word, '[.,;:!?]+$', '')) AS stem FROM t)
SELECT stem AS lemma_id, arg_max(word, doc_id * 1000000 + pos) AS lemma, CAST(count(DISTINCT word) AS BIGINT) AS n_variants, CAST(count(*) AS BIGINT) AS n_examples
FROM s WHERE stem <> '' GROUP BY stem""")
def lexicon_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1's summary without its lists: words grouped by stem; latest form, variants, occurrences."""
    t = doc_words(spark, sf_dir).withColumn("lemma_id", F.lower(F.regexp_replace("word", "[.,;:!?]+$", "")))
    return lex.lexicon_counts(t.where("lemma_id <> ''").select("lemma_id", F.col("word").alias("translit"), F.col("doc_id").alias("sent_ord"), "pos"))


@query("""
WITH t AS (SELECT p_partkey, '(' || p_brand || ')' || replace(p_name, ' ', '.') || '=' || p_type AS word FROM part),
a AS (SELECT *, regexp_extract(word, '^((?:\\([^)]+\\))*)', 1) AS pre FROM t),
b AS (SELECT *, substr(word, length(pre) + 1) AS rest FROM a),
c AS (SELECT *, regexp_extract(rest, '((?:[.=][^\\s.=]+)*)$', 1) AS suf FROM b)
SELECT p_partkey, array_to_string(regexp_extract_all(pre, '\\([^)]+\\)'), '|') AS prefixes, substr(rest, 1, length(rest) - length(suf)) AS root, array_to_string(regexp_extract_all(suf, '[.=][^\\s.=]+'), '|') AS suffixes FROM c""")
def affix_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1."""
    word = F.concat(F.lit("("), "p_brand", F.lit(")"), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("="), "p_type")
    rows = table(spark, sf_dir, "part").select("p_partkey", tx.affixes(word).alias("a"))
    return rows.select("p_partkey", F.array_join("a.prefixes", "|").alias("prefixes"), "a.root", F.array_join("a.suffixes", "|").alias("suffixes"))


@query(f"SELECT word, CAST(row_number() OVER (ORDER BY word) AS BIGINT) AS id FROM (SELECT DISTINCT word FROM ({DOC_WORDS}))")
def vocab_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, P10."""
    return lex.numbered(doc_words(spark, sf_dir), "word")


@query(f"""
WITH b AS (SELECT word, min(item_id) AS item FROM (SELECT item_id, unnest({WORDS}) AS word FROM benchmark) GROUP BY word)
SELECT t.word, min(b.item) AS item_id, CAST(count(*) AS BIGINT) AS n FROM ({DOC_WORDS}) t LEFT JOIN b ON b.word = t.word GROUP BY t.word""")
def token_lookup_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of the documents with the first benchmark item that holds it."""
    variants = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("lemma_ord"), F.posexplode(F.array_remove(F.split("text", SPACES), "")).alias("variant_ord", "glyph"))
    words = doc_words(spark, sf_dir).groupBy(F.col("word").alias("glyph")).agg(F.count("*").alias("n"))
    return lex.first_match(words, variants).select(F.col("glyph").alias("word"), F.col("match.lemma_ord").alias("item_id"), "n")


@query("""
WITH s AS (SELECT upper(substr(p_name, 1, 1)) AS t, substr(p_name, 1, 1) AS glyph FROM part UNION SELECT upper(substr(p_type, 1, 1)), lower(substr(p_type, 1, 1)) FROM part),
m AS (SELECT glyph, min(t) AS t FROM s GROUP BY glyph)
SELECT n_nationkey AS word_id, string_agg(coalesce(t, '?'), '' ORDER BY i) AS text
FROM (SELECT n_nationkey, lower(n_name) AS w, unnest(range(1, length(n_name) + 1)) AS i FROM nation) LEFT JOIN m ON m.glyph = substr(w, i, 1) GROUP BY n_nationkey""")
def token_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code point by code point."""
    part = table(spark, sf_dir, "part")
    first = lambda c: F.substring(c, 1, 1)
    s = part.select(F.upper(first("p_name")).alias("translit"), first("p_name").alias("glyph")).union(part.select(F.upper(first("p_type")), F.lower(first("p_type")))).distinct()
    singles = s.select("glyph", "translit", F.ascii("translit").alias("lemma_ord"), F.lit(0).alias("variant_ord"))
    words = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("word_id"), F.lower("n_name").alias("glyph"))
    return lex.fallback_text(words, singles)


@query("""
WITH v AS (SELECT lower(split_part(p_type, ' ', 1)) AS translit, min(p_partkey) AS lemma_ord FROM part GROUP BY 1
  UNION ALL SELECT split_part(p_name, ' ', 2), min(p_partkey) FROM part GROUP BY 1),
w AS (SELECT p_partkey AS word_id, replace(p_name, ' ', '') AS word FROM part)
SELECT w.word_id, w.word, min(struct_pack(o := v.lemma_ord, n := length(v.translit), t := v.translit)).t AS translit FROM w LEFT JOIN v ON v.translit <> '' AND (starts_with(w.word, v.translit) OR ends_with(w.word, v.translit)) GROUP BY w.word_id, w.word""")
def prefix_suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings and ends, as an equi-join."""
    part = table(spark, sf_dir, "part")
    v = part.groupBy(F.lower(F.substring_index("p_type", " ", 1)).alias("translit")).agg(F.min("p_partkey").alias("lemma_ord")).union(part.groupBy(F.get(F.split("p_name", " "), F.lit(1))).agg(F.min("p_partkey")))
    v = v.select("translit", "lemma_ord", F.length("translit").alias("variant_ord"), F.col("lemma_ord").cast("string").alias("lemma_id"))
    w = part.select(F.col("p_partkey").alias("word_id"), F.replace("p_name", F.lit(" "), F.lit("")).alias("word"))
    return lex.affix_match(w, v).select("word_id", "word", F.col("match.translit").alias("translit"))


@query("""
SELECT conv_id, turn, '[HIERO] ' || text || chr(10) || '[TRANS] ' || role || chr(10) || '[LEMMA] ' || chr(10) || '[GLOSS] ' AS input_text, nxt AS output_text
FROM (SELECT *, lead(role) OVER w AS nrole, lead(text) OVER w AS nxt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user' AND nrole = 'assistant' AND trim(coalesce(text, '')) <> '' AND trim(coalesce(nxt, '')) <> ''""")
def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant's answer as a training example."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumns({"nrole": F.lead("role").over(w), "translation": F.lead("text").over(w)}).where("role = 'user' and nrole = 'assistant'")
    none = F.lit(None).cast("string")
    rows = rows.select(F.struct("conv_id", "turn").alias("sent_ord"), F.col("text").alias("hieroglyphs"), "translation", F.to_json(F.struct("conv_id", "turn")).alias("UPOS"), none.alias("glossing"), none.alias("lemmatization"), "role")
    texts = rows.select("sent_ord", F.when(F.trim("hieroglyphs") != "", tx.source_text(F.col("hieroglyphs"), F.col("role"), none, none)).alias("text"))
    out = lex.training_examples(rows.drop("role"), texts)
    key = F.from_json("metadata.upos", "conv_id long, turn long")
    return out.select(key["conv_id"].alias("conv_id"), key["turn"].alias("turn"), "input_text", "output_text")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) <= floor((SELECT count(*) FROM documents) * 0.9) AS is_train FROM documents")
def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9."""
    return lex.split_by_place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("""
WITH t AS (SELECT l_orderkey, list(CAST(l_partkey AS INTEGER) ORDER BY l_linenumber, l_partkey, l_suppkey) AS ids FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_concat(ids[1:4], list_transform(range(0, greatest(4 - len(ids), 0)), lambda x: 0)), ',') AS padded,
array_to_string(list_transform(list_concat(ids[1:4], list_transform(range(0, greatest(4 - len(ids), 0)), lambda x: 0)), lambda x: CASE WHEN x = 0 THEN -100 ELSE x END), ',') AS labels,
array_to_string(ids[1:len(ids) - 1], ',') AS decoder_in, array_to_string(ids[2:], ',') AS decoder_out FROM t""")
def pad_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of an order as an id sequence."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    rows = rows.select("l_orderkey", F.transform("x", lambda s: s["l_partkey"].cast("int")).alias("ids"))
    text = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",")
    padded, moved = tx.pad(F.col("ids"), 4), tx.shift(F.col("ids"))
    return rows.select("l_orderkey", text(padded).alias("padded"), text(tx.mask_labels(padded)).alias("labels"), text(moved["input"]).alias("decoder_in"), text(moved["output"]).alias("decoder_out"))


LABELS = ("Old Kingdom", "Second Intermediate Period?", "11th Dynasty", "Greco-Roman Period", "1st Dynasty", "somewhere", "", "Pyramid Texts", "18th dynasty", "late period, Edfu", "Old Kingdom to New Kingdom", "30th Dynasty")
_CASE = "CASE extract(month FROM o_orderdate) " + " ".join(f"WHEN {i + 1} THEN '{x}'" for i, x in enumerate(LABELS)) + " END"
_PERIOD = {"Old Kingdom": ("Old Kingdom", 2), "Second Intermediate Period?": ("Second Intermediate Period", 5), "11th Dynasty": ("11th Dynasty", 3), "Greco-Roman Period": ("Roman", 10), "1st Dynasty": ("1th Dynasty", 1), "somewhere": ("somewhere", 500), "": (None, 999), "Pyramid Texts": ("Pyramid Texts", 2), "18th dynasty": ("18th Dynasty", 6), "late period, Edfu": ("Late Period", 8), "Old Kingdom to New Kingdom": ("Old Kingdom", 2), "30th Dynasty": ("30th Dynasty", 8)}


@query(f"WITH t AS (SELECT o_orderkey, {_CASE} AS label FROM orders) SELECT o_orderkey, label, CASE label " + " ".join(f"WHEN '{k}' THEN {'NULL' if p is None else repr(p)}" for k, (p, _) in _PERIOD.items()) + " END AS period, CASE label " + " ".join(f"WHEN '{k}' THEN {r}" for k, (_, r) in _PERIOD.items()) + " END AS rank FROM t")
def period_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by month, ranked by rule; the twin states the expected values."""
    label = F.element_at(F.array(*map(F.lit, LABELS)), F.month("o_orderdate"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"))
    return rows.select("o_orderkey", "label", lx.period(F.col("label")).alias("period"), lx.period_rank(F.col("label")).alias("rank"))


FORMS = "SELECT user_id, event_type AS type, event_id AS ord, event_id AS node, CASE WHEN user_id % 7 = 3 OR extract(day FROM ts) > 25 THEN 999 WHEN extract(day FROM ts) > 20 THEN 500 ELSE extract(day FROM ts) // 5 END AS rank, CAST(-user_id - 1 AS BIGINT) AS main FROM events"


def event_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as forms: five-day periods of the month, the last days without a usable date."""
    day = F.day("ts")
    rank = F.when((F.col("user_id") % 7 == 3) | (day > 25), 999).when(day > 20, 500).otherwise(F.floor(day / 5).cast("int"))
    return table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("type"), F.col("event_id").alias("ord"), F.col("event_id").alias("node"), rank.alias("rank"), (-F.col("user_id") - 1).alias("main"))


@query(f"""
WITH f AS ({FORMS}), p AS (SELECT user_id, type, rank, min(node) AS first, max(node) AS last FROM f WHERE rank < 500 GROUP BY 1, 2, 3),
n AS (SELECT *, lead(first) OVER (PARTITION BY user_id, type ORDER BY rank) AS nxt, row_number() OVER (PARTITION BY user_id, type ORDER BY rank) AS k FROM p)
SELECT user_id, last AS "from", nxt AS "to", 'EVOLVES' AS type, type AS notes FROM n WHERE nxt IS NOT NULL
UNION ALL SELECT user_id, -user_id - 1, first, 'DERIVED', type FROM n WHERE k = 1""")
def temporal_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1, W2."""
    f = event_forms(spark, sf_dir)
    return ch.temporal_chain(f, "user_id").unionByName(ch.first_attestation(f, "user_id"))


@query(f"WITH f AS ({FORMS}) SELECT user_id, max(CASE WHEN type = 'view' AND rank < 500 THEN rank END) AS top, coalesce(arg_max(node, CASE WHEN type = 'view' AND rank < 500 THEN rank * 100000000 + ord END), min(main)) AS latest FROM f GROUP BY user_id")
def latest_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5."""
    f = event_forms(spark, sf_dir).withColumn("type", F.when(F.col("type") == "view", "base").otherwise(F.col("type")))
    top = f.groupBy("user_id").agg(F.max(F.when((F.col("type") == "base") & (F.col("rank") < 500), F.col("rank"))).cast("long").alias("top"))
    return ch.latest_base(f, "user_id").join(top, "user_id").select("user_id", "top", "latest")


@query(f"WITH f AS ({FORMS}) SELECT a.user_id, a.node AS \"from\", b.node AS \"to\", 'VARIANT' AS type, 'same period' AS notes FROM f a JOIN f b ON a.user_id = b.user_id AND a.type = b.type AND a.rank = b.rank AND a.ord < b.ord WHERE a.rank < 500 AND a.type = 'error'")
def same_period_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3."""
    return ch.same_period_variants(event_forms(spark, sf_dir).where("type = 'error'"), "user_id")


@query(f"WITH f AS ({FORMS}), d AS (SELECT *, max(CASE WHEN rank <> 999 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, type) AS dated FROM f) SELECT user_id, main AS \"from\", node AS \"to\", 'DERIVED' AS type, 'undated' AS notes FROM d WHERE dated = 0")
def undated_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4."""
    return ch.undated_variants(event_forms(spark, sf_dir), "user_id")


@query("""SELECT p_partkey, CASE WHEN s LIKE '%plural%' OR s LIKE '%pl.%' THEN 'plural' WHEN s LIKE '%dual%' THEN 'dual' WHEN s LIKE '%feminine%' OR s LIKE '%fem.%' THEN 'feminine' WHEN s LIKE '%god%' THEN 'god' WHEN s LIKE '%determinative%' THEN 'determinative' ELSE 'base' END AS form_type
FROM (SELECT p_partkey, lower(p_type || ' ' || CASE p_size % 6 WHEN 0 THEN 'Plural' WHEN 1 THEN 'fem. dual' WHEN 2 THEN 'Feminine' WHEN 3 THEN 'GOD' WHEN 4 THEN 'as determinative' ELSE '' END) AS s FROM part)""")
def form_type_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17."""
    k = F.col("p_size") % 6
    note = F.when(k == 0, "Plural").when(k == 1, "fem. dual").when(k == 2, "Feminine").when(k == 3, "GOD").when(k == 4, "as determinative").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", lx.form_type(F.col("p_type"), note).alias("form_type"))


@query("""
WITH n AS (SELECT extract(year FROM l_shipdate) * 100 + extract(month FROM l_shipdate) AS period, l_returnflag, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem GROUP BY 1, 2)
SELECT CAST(period AS BIGINT) AS period, arg_max(l_returnflag, n * 1e10 - ord) AS canonical, CAST(max(n) AS BIGINT) AS n FROM n GROUP BY period""")
def canonical_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: the most frequent flag of each month."""
    rows = table(spark, sf_dir, "lineitem").select((F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("long").alias("period"), "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return ch.canonical_spelling(rows, "l_returnflag", "period")


EDGES = """SELECT 'g' AS network_id, 'n' || n_nationkey AS "from", 'r' || n_regionkey AS "to", 'DESCENDS' AS type FROM nation
UNION ALL SELECT 'g', 'c' || c_custkey, 'n' || c_nationkey, 'DERIVED' FROM customer UNION ALL SELECT 'g', 's' || s_suppkey, 'n' || s_nationkey, 'COMPONENT' FROM supplier
UNION ALL SELECT 'g', 'o' || o_orderkey, 'c' || o_custkey, 'VARIANT' FROM orders"""
NODES = """SELECT 'g' AS network_id, 'r' || r_regionkey AS id, 'region' AS language, r_name AS form FROM region UNION ALL SELECT 'g', 'n' || n_nationkey, 'nation', n_name FROM nation
UNION ALL SELECT 'g', 'c' || c_custkey, 'customer', c_name FROM customer UNION ALL SELECT 'g', 's' || s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT 'g', 'o' || o_orderkey, 'order', o_orderpriority FROM orders"""


def property_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the star schema."""
    t = lambda n: table(spark, sf_dir, n)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    node = lambda n, p, c, kind, form: t(n).select(F.lit("g").alias("network_id"), key(p, c).alias("id"), F.lit(kind).alias("language"), F.col(form).alias("form"))
    edge = lambda n, p, c, q, d, kind: t(n).select(F.lit("g").alias("network_id"), key(p, c).alias("from"), key(q, d).alias("to"), F.lit(kind).alias("type"))
    nodes = node("region", "r", "r_regionkey", "region", "r_name")
    for args in (("nation", "n", "n_nationkey", "nation", "n_name"), ("customer", "c", "c_custkey", "customer", "c_name"), ("supplier", "s", "s_suppkey", "supplier", "s_name"), ("orders", "o", "o_orderkey", "order", "o_orderpriority")):
        nodes = nodes.union(node(*args))
    edges = edge("nation", "n", "n_nationkey", "r", "n_regionkey", "DESCENDS")
    for args in (("customer", "c", "c_custkey", "n", "c_nationkey", "DERIVED"), ("supplier", "s", "s_suppkey", "n", "s_nationkey", "COMPONENT"), ("orders", "o", "o_orderkey", "c", "o_custkey", "VARIANT")):
        edges = edges.union(edge(*args))
    return nodes, edges


@query(f"""WITH e AS ({EDGES}), n AS ({NODES}) SELECT e."from", e."to", e.type, a.form AS from_form, b.form AS to_form FROM e JOIN n a ON a.id = e."from" JOIN n b ON b.id = e."to" """)
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12, K5."""
    nodes, edges = property_graph(spark, sf_dir)
    return g.with_ends(edges, nodes, "form").select("from", "to", "type", "from_form", "to_form")


@query(f"""WITH e AS ({EDGES}), n AS ({NODES}), a AS (SELECT 'nodes' AS what, language AS key FROM n UNION ALL SELECT 'edges', type FROM e)
SELECT what, key, CAST(count(*) AS DOUBLE) AS n FROM a GROUP BY 1, 2 UNION ALL SELECT what, 'total', count(*) FROM a GROUP BY 1 UNION ALL SELECT what, 'per network', count(*) FROM a GROUP BY 1""")
def edge_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3."""
    return g.statistics(*property_graph(spark, sf_dir))


@query(f"""WITH RECURSIVE e AS ({EDGES}), l AS (SELECT "from" AS a, "to" AS b FROM e UNION SELECT "to", "from" FROM e),
w(node, depth) AS (SELECT 'n3', 0 UNION SELECT l.b, w.depth + 1 FROM w JOIN l ON l.a = w.node WHERE w.depth < 2)
SELECT 'n3' AS seed, node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY node""")
def ego_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1."""
    _, edges = property_graph(spark, sf_dir)
    return g.ego(edges, spark.createDataFrame([("n3",)], "id string"), 2)


@query(f"""WITH RECURSIVE e AS ({EDGES}), up AS (SELECT "to" AS a, "from" AS b FROM e WHERE type IN ('DESCENDS', 'COMPONENT') UNION SELECT "from", "to" FROM e WHERE type IN ('DERIVED', 'VARIANT') UNION SELECT "to", "from" FROM e WHERE type IN ('DERIVED', 'VARIANT')),
w(node) AS (SELECT 'n3' UNION SELECT up.b FROM w JOIN up ON up.a = w.node) SELECT 'n3' AS seed, node FROM w""")
def ancestry_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors and siblings."""
    _, edges = property_graph(spark, sf_dir)
    return g.ancestry(edges, spark.createDataFrame([("n3",)], "id string"))


@query("""WITH RECURSIVE d AS (SELECT DISTINCT l_suppkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem WHERE l_quantity >= 49),
l AS (SELECT a, b FROM d UNION SELECT b, a FROM d), w(node, other) AS (SELECT DISTINCT a, a FROM l UNION SELECT w.node, l.b FROM w JOIN l ON l.a = w.other)
SELECT node, min(other) AS component FROM w GROUP BY node""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts that large orders link."""
    e = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))
    return cc.connected_components(e)


_CLEAN = """WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part),
n AS (SELECT 'w' || k AS network_id, 'e1' AS id, 'egy' AS language, s % 11 AS rank, 0 AS node_ord FROM p UNION ALL SELECT 'w' || k, 'e2', 'egy', CASE WHEN s % 3 = 0 THEN 999 ELSE s % 7 END, 1 FROM p
UNION ALL SELECT 'w' || k, 'd', 'dem', 999, 2 FROM p UNION ALL SELECT 'w' || k, 'c', 'cop', 999, 3 FROM p),
"""


@query(_CLEAN + """l AS (SELECT network_id, coalesce(arg_max(id, CASE WHEN rank < 500 THEN rank * 10 + node_ord END)) AS latest FROM n WHERE language = 'egy' GROUP BY 1)
SELECT network_id, latest AS "from", 'd' AS "to", 'DESCENDS' AS type FROM l
UNION ALL SELECT 'w' || k, 'd', 'c', 'DESCENDS' FROM p WHERE s % 2 = 0
UNION ALL SELECT l.network_id, l.latest, 'c', 'DESCENDS' FROM l JOIN p ON l.network_id = 'w' || p.k WHERE s % 2 = 1""")
def redundant_edge_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descent starts at the latest form, and goes through Demotic where it can."""
    p = deal(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(F.concat(F.lit("w"), F.col("p_partkey").cast("string")).alias("network_id"), F.col("p_size").alias("s"))
    s = F.col("s")
    node = lambda id_, lang, rank, ord_: F.struct(F.lit(id_).alias("id"), F.lit(lang).alias("language"), rank.cast("int").alias("rank"), F.lit(ord_).alias("node_ord"))
    nodes = p.select("network_id", F.inline(F.array(node("e1", "egy", s % 11, 0), node("e2", "egy", F.when(s % 3 == 0, 999).otherwise(s % 7), 1), node("d", "dem", F.lit(999), 2), node("c", "cop", F.lit(999), 3))))
    edge = lambda a, b, o: F.struct(F.lit(a).alias("from"), F.lit(b).alias("to"), F.lit("DESCENDS").alias("type"), F.lit(o).alias("edge_ord"))
    base = F.array(edge("e1", "d", 0), edge("e1", "c", 1))
    edges = p.select("network_id", F.inline(F.when(s % 2 == 0, F.array_append(base, edge("d", "c", 2))).otherwise(base)))
    return g.cleanup_descent(nodes, edges).select("network_id", "from", "to", "type")


@query("""WITH t AS (SELECT doc_id AS network_ord, source AS form, text, length(text) AS n_nodes FROM documents WHERE contains(lower(text), 'licen') OR contains(lower(source), 'licen') ORDER BY doc_id LIMIT 50)
SELECT CAST(network_ord AS VARCHAR) AS network_id, form, CAST(1 AS BIGINT) AS n_nodes, lower(form) = 'licen' AS exact FROM t""")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty documents with a keyword."""
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("network_id"), F.col("doc_id").alias("network_ord"), F.col("doc_id").alias("id"), F.col("source").alias("form"), F.array("text").alias("meanings"), F.lit(0).alias("node_ord"))
    return g.keyword_search(nodes, "licen").select("network_id", "form", "n_nodes", "exact")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6."""
    return ingest.unseen(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: later events upserted into earlier ones."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return ingest.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


@query("""WITH t AS (SELECT page_id, unnest(x) AS tag, generate_subscripts(x, 1) - 1 AS ord FROM (SELECT page_id, regexp_extract_all(html, '<(h1|h2|p|li|b|ul)[ >]', 1) AS x FROM pages)),
d AS (SELECT *, CASE tag WHEN 'h1' THEN 0 WHEN 'h2' THEN 1 WHEN 'ul' THEN 1 WHEN 'p' THEN 2 WHEN 'li' THEN 2 ELSE 3 END AS depth FROM t)
SELECT a.page_id, CAST(a.ord AS INTEGER) AS ord, CAST(a.depth AS INTEGER) AS depth, CAST(max(b.ord) AS INTEGER) AS parent FROM d a LEFT JOIN d b ON a.page_id = b.page_id AND b.ord < a.ord AND b.depth < a.depth GROUP BY 1, 2, 3""")
def tree_from_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4e, W8: the parent of each element by depth."""
    tags = F.regexp_extract_all("html", F.lit("<(h1|h2|p|li|b|ul)[ >]"), 1)
    depth = lambda t: F.when(t == "h1", 0).when(t.isin("h2", "ul"), 1).when(t.isin("p", "li"), 2).otherwise(3)
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(tags).alias("ord", "tag")).select("page_id", "ord", depth(F.col("tag")).alias("depth"))
    return trees.parents(rows, "page_id", levels=4)


@query("SELECT lang, CAST(count(*) FILTER (WHERE quality IS NULL) AS BIGINT) AS missing, CAST(count(*) AS BIGINT) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def integrity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9."""
    return g.missing_attribute(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left"), "quality", "lang")
