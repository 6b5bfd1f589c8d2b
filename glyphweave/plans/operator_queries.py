"""Queries that run the library's scalar operators, parsers and builders over rows made from the driver's tables, and their SQL twins.

Most inputs are strings put together from a part's columns, stated once in SQL that both engines read; a twin states what the operator must
give for them, case by case, and repeats no logic of the library.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glyphweave.functions import lexical as lx, tables, text as tx
from glyphweave.operators import chronology as ch, graph as g, lexicon as lex, networks as nw, wikitext as wt
from glyphweave.plans.driver_queries import EDGES, FORMS, NODES, event_forms, property_graph
from glyphweave.session import deal, shared_dir, table
from glyphweave.sources import ingest, objects
from glyphweave.sources.keyed_table import KeyedTable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Signs A1 to A40 or so, one code point each, and their codes by the Unicode names.
SIGNS = "".join(chr(0x13000 + i) for i in range(50))
_NAMES = [unicodedata.name(c).split()[-1] for c in SIGNS]
CODES = [n[0] + n[1:4].lstrip("0") + n[4:] for n in _NAMES]
ADJ, NOUN = "substr(p_name, 1, instr(p_name, ' ') - 1)", "substr(p_name, instr(p_name, ' ') + 1)"
SIGN = f"substr('{SIGNS}', p_size % 50 + 1, 1)"
OTHER = f"substr('{SIGNS}', CAST(p_partkey % 50 AS INT) + 1, 1)"
_code = lambda n: f"([{', '.join(repr(c) for c in CODES)}])[{n} % 50 + 1]"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def case(n: int, *values: str, by: str = "p_size") -> str:
    """SQL for one of several values by a remainder; the last is for the rest."""
    return f"CASE {by} % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1])) + f" ELSE {values[-1]} END"


def scalars(name: str, doc: str, given: dict[str, str], got: dict[str, Callable[[], Column]], want: dict[str, str]) -> None:
    """A query of scalar operators over `part`: given columns in SQL for both engines, columns got from the library, wanted columns in SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "part").select("*", *[F.expr(v).alias(k) for k, v in given.items()])
        return rows.select("p_partkey", *[c().alias(k) for k, c in got.items()])

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run
    ORACLE[name] = f"WITH t AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in given.items())} FROM part) SELECT p_partkey, {', '.join(f'{v} AS {k}' for k, v in want.items())} FROM t"


def joined(c: Column, sep: str = "|") -> Column:
    return F.array_join(c, sep)


scalars(
    "lemma_affix_split", "P1b.",
    {"word": f"'(' || p_brand || ')' || {ADJ} || '.' || {NOUN} || '=' || p_type", "lemma": case(4, "'(' || p_brand || ')x'", "'x=' || p_type", f"'x.' || {NOUN}", "p_name")},
    {"prefixes": lambda: joined(tx.lemma_affixes(F.col("word"), F.col("lemma"))["prefixes"]), "root": lambda: tx.lemma_affixes(F.col("word"), F.col("lemma"))["root"], "suffixes": lambda: joined(tx.lemma_affixes(F.col("word"), F.col("lemma"))["suffixes"])},
    {
        "prefixes": case(4, "''", *["'(' || p_brand || ')'"] * 3),
        "root": case(4, f"'(' || p_brand || ')' || {ADJ}", f"{ADJ} || '.' || {NOUN} || '=' || p_type", f"{ADJ} || '.' || {NOUN}", ADJ),
        "suffixes": case(4, f"'.' || {NOUN} || '|=' || p_type", "''", "'=' || p_type", f"'.' || {NOUN} || '|=' || p_type"),
    },
)

scalars(
    "glyph_codes", "P2, P2b, P2c, P5.",
    {"a": SIGN, "b": OTHER},
    {
        "codes": lambda: joined(tx.glyph_code(F.concat("a", "b", F.lit("x")))),
        "mixed": lambda: joined(tx.mixed_codes(F.concat("a", F.lit("<g>v31a</g> "), "b", F.lit("︂x")))),
        "segment": lambda: joined(tx.segment_codes(F.concat("a", F.lit(" ́"), "b"))),
        "back": lambda: tx.codes_to_text(F.concat(joined(tx.glyph_code(F.concat("a", "b")), "-"), F.lit(" ZZ9"))),
    },
    {"codes": f"{_code('p_size')} || '|' || {_code('p_partkey')} || '|UNK(x)'", "mixed": f"{_code('p_size')} || '|V31A|' || {_code('p_partkey')} || '|UNK(x)'", "segment": f"{_code('p_size')} || '|' || {_code('p_partkey')}", "back": "a || b || ' �'"},
)

scalars(
    "sign_clusters", "P3, P4.",
    {"a": SIGN, "b": OTHER, "s": f"{SIGN} || 'D36  <g>a1</g>' || {OTHER}"},
    {"clusters": lambda: joined(F.transform(tx.sentence_clusters(F.col("s")), lambda w: joined(w, ".")), "/"), "codes": lambda: joined(F.transform(tx.sentence_codes(F.concat("a", F.lit(" <g>a1</g>"), "b")), lambda w: joined(w, ".")), "/")},
    {"clusters": "a || '.D36/<g>a1</g>.' || b", "codes": f"{_code('p_size')} || '/A1.' || {_code('p_partkey')}"},
)

scalars(
    "morph_tags", "P6, P7, P8.",
    {"word": case(5, "'(j)'", "'.f'", "'-'", "'=K'", "p_name"), "kind": case(4, "'PREFIX'", "'SUFFIX'", "'ROOT'", "'UNKNOWN'"), "upos": case(3, "'NOUN, VERB'", "'ADJ;X'", "''", by="p_partkey")},
    {"marked": lambda: tx.morph_marker(F.col("word"), tx.is_prefix(F.col("word")), tx.is_suffix(F.col("word")), tx.is_determinative(F.col("word"))), "tag": lambda: tx.token_type(F.col("kind"), F.col("upos"))},
    {"marked": case(5, "'(j)[prefix]'", "'.f[suffix]'", "'-[det]'", "'=K[suffix]'", "p_name"), "tag": case(4, *(case(3, f"'{p}NOUN'", f"'{p}ADJ'", f"'{r}'", by="p_partkey") for p, r in (("PRE ", "PRE "), ("SUF ", "SUF "), ("", "ROOT"))), "'UNKNOWN'")},
)

scalars(
    "text_clean", "P14.",
    {"s": f"' ' || {ADJ} || chr(10) || chr(10) || {NOUN} || ' '", "u": f"{ADJ} || chr(9) || ' ' || {NOUN} || chr(10)"},
    {"cleaned": lambda: tx.clean(F.col("s")), "collapsed": lambda: tx.collapse(F.col("u"))},
    {"cleaned": "p_name", "collapsed": "p_name"},
)

scalars(
    "head_signs", "P18.",
    {"p": case(3, "'m|head=<hiero>' || p_name || '</hiero>'", "'m|head=' || p_name || '|x=1'", "'m|f'")},
    {"head": lambda: lx.head_hieroglyphs(F.col("p"))},
    {"head": case(3, "p_name", "p_name", "NULL")},
)

scalars(
    "alternative_entries", "P19, P19b.",
    {"m": case(4, f"'Alternative form of ' || {NOUN} || '.'", f"'[rare] alternative form of ' || {NOUN} || ' x'", f"'alternative spelling of ' || {NOUN}", "p_name")},
    {"is_alternative": lambda: lx.is_alternative(F.array("m", "p_name")), "target": lambda: lx.alternative_target(F.array("p_name", "m"))},
    {"is_alternative": "p_size % 4 IN (0, 2)", "target": case(4, NOUN, NOUN, "NULL", "NULL")},
)

scalars(
    "ancestor_forms", "P20.",
    {"e": case(5, f"'x {{{{inh|dem|egy|' || {NOUN} || '<t:x>}}}}'", f"'{{{{der|cop-sah|egy|' || {NOUN} || '}}}}'", f"'{{{{bor|egx-dem|egy| ' || {NOUN} || ' |x}}}}'", f"'{{{{inh|cop|grc|' || {NOUN} || '}}}}'", "'none'")},
    {"dem": lambda: lx.ancestor(F.col("e"), "dem"), "cop": lambda: lx.ancestor(F.col("e"), "cop")},
    {"dem": case(5, NOUN, "NULL", NOUN, "NULL", "NULL"), "cop": case(5, "NULL", NOUN, "NULL", "NULL", "NULL")},
)

scalars(
    "language_codes", "P21, P22, P30.",
    {"code": case(6, "'egx-dem'", "'cop-sah'", "'cop-her'", "'la'", "'zz'", "'egy'"), "kind": case(4, "'VARIANT'", "'BORROWED'", "'EVOLVES'", "'?'", by="p_partkey")},
    {"descendant": lambda: lx.descendant_language(F.col("code")), "name": lambda: lx.language_name(F.col("code")), "colour": lambda: lx.node_colour(F.col("code")), "edge": lambda: lx.edge_colour(F.col("kind")), "dash": lambda: lx.edge_dash(F.col("kind"))},
    {
        "descendant": case(6, "'dem'", "'cop'", "'cop-her'", "'la'", "'zz'", "'egy'"), "name": case(6, "'Demotic'", "'Sahidic Coptic'", "'Hermopolitan Coptic'", "'Latin'", "'zz'", "'Egyptian'"),
        "colour": case(6, "'#ddd'", "'#95e1d3'", "'#95e1d3'", "'#ddd'", "'#ddd'", "'#ff6b6b'"), "edge": case(4, "'#95a5a6'", "'#1abc9c'", "'#e74c3c'", "'#999'", by="p_partkey"), "dash": case(4, "'5,5'", "'8,4'", "'0'", "'0'", by="p_partkey"),
    },
)

scalars(
    "page_urls", "P23.",
    {"lang": case(2, "'Ancient Greek'", "'Egyptian'")},
    {"url": lambda: lx.page_url(F.col("p_name"), F.col("lang"))},
    {"url": "'https://en.wiktionary.org/wiki/' || replace(p_name, ' ', '%20') || '#' || replace(lang, ' ', '_')"},
)

scalars(
    "phonetic_signs", "P24, P25, P26.",
    {"code": case(6, "'nfr'", "'Nb'", "'Aa12'", "'zzz'", "'ḥtp'", "'g43a'"), "s": "'nfr-pr:Z' || p_size || '*A1!t'", "plain": case(4, "'<hiero>A1:G1-zz H_SPACE</hiero>'", "'A2&a3'", "'A4  A1*x'", "'zz'")},
    {"sign": lambda: lx.phonetic_code(F.col("code")), "layout": lambda: F.to_json(lx.layout(F.col("s"))), "glyphs": lambda: lx.layout_text(F.col("plain"))},
    {"sign": case(6, "'F35'", "'V30'", "'Aa12'", "NULL", "'R4'", "'g43a'"), "layout": """'[[[["F35"]],[["O1"],["Z' || p_size || '","A1"]]],[[["X1"]]]]'""", "glyphs": case(4, "'\U00013000\U0001313f'", "'\U00013001\U00013002'", "'\U00013003\U00013000'", "''")},
)

scalars(
    "entry_display", "P27, P28, P31.",
    {"m": f"'{{{{x|y}}}}[[' || {ADJ} || '|' || {NOUN} || ']] of [[' || p_type || ']]'", "e": f"'===E===From {{{{m|egy|' || {NOUN} || '}}}} x '", "long": "repeat(p_name, 12)", "none": case(2, "p_name", "''")},
    {
        "cleaned": lambda: joined(lx.clean_meanings(F.array("m", F.lit("ab")))), "shown": lambda: lx.etymology_display(F.col("e")),
        "snippet": lambda: lx.snippet(F.array("long")), "short": lambda: lx.snippet(F.array("none")), "tip": lambda: lx.tooltip(F.array("m", "p_type", "long", "p_name")),
    },
    {
        "cleaned": f"{NOUN} || ' of ' || p_type", "shown": f"'From ' || {NOUN} || ' x'", "snippet": "substr(long, 1, 80) || CASE WHEN length(long) > 80 THEN '...' ELSE '' END",
        "short": case(2, "p_name", "'No meaning available'"), "tip": f"'[[' || {ADJ} || '|' || {NOUN} || ']] of [[' || p_type || ']]; ' || p_type || '; ' || substr(long, 1, 100)",
    },
)


def _etymologies() -> Column:
    entry = lambda n, head, alt: F.struct(n.cast("int").alias("etymology_number"), F.array(*[F.struct(F.concat(F.lit("m|head="), h).alias("parameters"), F.array(F.struct(alt.alias("hieroglyphs"))).alias("alternative_forms")) for h in head]).alias("definitions"))
    numbered = F.col("p_size") % 3 != 0
    return F.array(entry(F.when(numbered, 1), (F.col("p_brand"), F.col("p_type")), F.col("p_brand")), entry(F.when(numbered, 2), (F.col("p_name"),), F.lit("alt")))


scalars(
    "etymology_signs", "P29.",
    {"n": case(2, "0", "1")},
    {"signs": lambda: joined(lx.etymology_hieroglyphs(_etymologies(), F.col("n")))},
    {"signs": case(2, "p_type || '|' || p_brand", "p_name || '|alt'")},
)


def _lines(*lines: str) -> str:
    return " || chr(10) || ".join(f"'{x}'" for x in lines).replace("<adj>", f"' || {ADJ} || '").replace("<noun>", f"' || {NOUN} || '").replace("<brand>", "' || p_brand || '").replace("<type>", "' || lower(p_type) || '").replace("<size>", "' || p_size || '")


PAGE = _lines(
    "==Egyptian==", "===Pronunciation===", "{{egy-IPA|<noun>}}", "===Etymology 1===", "From {{inh|egy|afa-pro|*<adj>}}. {{compound|egy|<adj>|<noun>|-t}}", "====Noun====", "{{egy-noun|m|head=<hiero><brand></hiero>}}",
    "# {{lb|egy|<type>}} [[<adj>|<noun>]] {{defdate|Old Kingdom}}", "#: an example", "# {{alt form|egy|<noun>}}", "=====Inflection=====", "{{egy-decl-noun|<adj>}}", "=====Alternative forms=====",
    "{{egy-hieroforms|<adj>|read1=<adj>|date1=New Kingdom|<noun>|read2=<noun>|date2=Old Kingdom}}", "=====Usage notes=====", "Used of {{m|egy|<noun>}}, not of [[x|<size>]].", "=====Derived terms=====", "{{col3|egy|<adj>|<noun><t:x>|<adj>}}",
    "=====Synonyms=====", "* {{l|egy|<noun>}}, {{l|egy|<adj>}}", "=====Descendants=====", "* {{desc|egx-dem|<adj>}}", "** {{desc|cop|<noun>|<noun>x}}", "* {{desc|grc|x|tr=y}}", "*** {{desc|la|<size>}}",
    "===Etymology 2===", "====Verb====", "{{egy-verb}}", "# to [[<noun>]]", "===References===", "Book <size>, {{R:x}}p. 1", "==Latin==", "===Noun===", "# other",
)


def _parsed(spark: SparkSession, sf_dir: str, page: str = PAGE, language: str = "Egyptian") -> DataFrame:
    part = deal(table(spark, sf_dir, "part"), "p_partkey")  # before its texts are made
    return wt.parse_pages(part.select(F.col("p_partkey").alias("lemma_ord"), F.col("p_name").alias("title"), F.lit(language).alias("language"), F.expr(page).alias("full_wikitext")))


@query(f"""
SELECT p_partkey AS lemma_ord, 0 AS etym_idx, 0 AS def_idx, 'Noun' AS part_of_speech, 'm|head=<hiero>' || p_brand || '</hiero>' AS parameters, '[' || lower(p_type) || '] ' || {NOUN} || ' (dated: Old Kingdom)/Alternative form of ' || {NOUN} AS meanings, {NOUN} AS alternative_of,
  {ADJ} || ':New Kingdom|' || {NOUN} || ':Old Kingdom' AS forms, {ADJ} || '|' || {NOUN} AS derived, {NOUN} || '|' || {ADJ} AS synonyms, {ADJ} AS inflection, 'Used of ' || {NOUN} || ', not of ' || p_size || '.' AS notes FROM part
UNION ALL SELECT p_partkey, 1, 0, 'Verb', NULL, 'to ' || {NOUN}, '', '', '', '', NULL, NULL FROM part""")
def page_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1-X4, X4a-X4d, X6, X9-X12: dictionary pages as one row per definition block."""
    text = lambda c: F.coalesce(joined(c), F.lit(""))
    return wt.senses(_parsed(spark, sf_dir)).select(
        "lemma_ord", "etym_idx", "def_idx", "part_of_speech", "parameters", joined(F.col("meanings"), "/").alias("meanings"), text(F.col("alternative_forms_from_definitions")).alias("alternative_of"),
        text(F.transform("alternative_forms", lambda a: F.concat_ws(":", a["hieroglyphs"], a["date"]))).alias("forms"), text(F.col("derived_terms")).alias("derived"), text(F.col("synonyms")).alias("synonyms"), "inflection", F.col("usage_notes").alias("notes"),
    )


@query(f"""
SELECT p_partkey AS lemma_ord, ord, parent_ord, level, language, word FROM part, LATERAL (VALUES (0, NULL, 0, 'egx-dem', {ADJ}), (1, 0, 1, 'cop', {NOUN}), (2, 0, 1, 'cop', {NOUN} || 'x'), (3, NULL, 0, 'grc', 'x'), (4, 3, 2, 'la', CAST(p_size AS VARCHAR))) v(ord, parent_ord, level, language, word)""")
def page_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4e: the tree of descendants; a line two levels deeper hangs below the last one that is less deep."""
    return wt.senses(_parsed(spark, sf_dir)).where("etym_idx = 0").select("lemma_ord", F.inline("descendants"))


@query(f"""
SELECT p_partkey AS lemma_ord, 'ancestor' AS what, 'afa-pro' AS language, '*' || {ADJ} AS form, 'inh' AS kind FROM part UNION ALL SELECT p_partkey, 'base', 'egy', {ADJ}, 'compound' FROM part
UNION ALL SELECT p_partkey, 'base', 'egy', {NOUN}, 'compound' FROM part UNION ALL SELECT p_partkey, 'suffix', 'egy', '-t', 'compound' FROM part""")
def page_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors and components of the first etymology."""
    told = lambda what, language, form, kind: F.struct(what.alias("what"), language.alias("language"), form.alias("form"), kind.alias("kind"))
    above = F.transform("ancestors", lambda a: told(F.lit("ancestor"), a["language"], a["form"], a["type"]))
    parts = F.transform("components", lambda c: told(c["role"], c["language"], c["form"], c["template_type"]))
    rows = wt.senses(_parsed(spark, sf_dir)).where("etym_idx = 0")
    return rows.select("lemma_ord", F.inline(F.concat(*[F.coalesce(x, F.array()) for x in (above, parts)])))  # each page is parsed once


@query(f"SELECT p_partkey AS lemma_ord, 'egy-IPA|' || {NOUN} AS pronunciations, 'Book ' || p_size || ', p. 1' AS refs, 2 AS n_etymologies FROM part")
def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11: pronunciations, references and etymologies of a page."""
    return _parsed(spark, sf_dir).select("lemma_ord", joined(F.col("pronunciations")).alias("pronunciations"), F.col("references").alias("refs"), F.size("etymologies").alias("n_etymologies"))


COPTIC = _lines("==Coptic==", "===Etymology===", "{{bor|cop|grc|<adj><t:x>}}. {{alter|cop|<adj>|B|<noun>|S}}", "===Noun===", "{{cop-noun|m}}", "# [[<noun>]] of {{q|<type>}}")


@query(f"""
SELECT p_partkey AS lemma_ord, {ADJ} || ':Bohairic|' || {NOUN} || ':Sahidic' AS forms, 'm' AS parameters, {NOUN} || ' of ' || lower(p_type) AS meanings, 'grc:' || {ADJ} || ':bor' AS ancestors FROM part""")
def coptic_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialect codes belong to the form before them; a page with one unnumbered etymology."""
    rows = wt.senses(_parsed(spark, sf_dir, COPTIC, "Coptic"))
    return rows.select("lemma_ord", joined(F.transform("alternative_forms", lambda a: F.concat_ws(":", a["form"], a["dialect"]))).alias("forms"), "parameters", joined(F.col("meanings"), "/").alias("meanings"), joined(F.transform("ancestors", lambda a: F.concat_ws(":", a["language"], a["form"], a["type"]))).alias("ancestors"))


scalars(
    "simple_pages", "X13: the older parser.",
    {"s": _lines("===Etymology 1===", "====Noun====", "{{egy-h|<brand>}} {{egy-hieroforms|<adj>|title=x|<hiero><noun></hiero>}}", "====Other====", "===Etymology 2===", "====Verb====")},
    {"etymologies": lambda: wt.simple_page(F.col("s"))["n_etymologies"], "speech": lambda: joined(wt.simple_page(F.col("s"))["parts_of_speech"]), "signs": lambda: joined(wt.simple_page(F.col("s"))["hieroglyphs"]), "older": lambda: wt.simple_page(F.col("s"), True)["n_etymologies"]},
    {"etymologies": "2", "speech": "'Noun|Verb'", "signs": f"p_brand || '|' || {ADJ} || '|' || {NOUN}", "older": "0"},
)

scalars(
    "language_sections", "S4: a language's section, or the whole text.",
    {"s": case(3, _lines("==Egyptian==", "<adj>", "===N===", "<noun>", "==Coptic==", "z"), _lines("intro", "==Latin==", "x", "==Egyptian==", "<noun>"), "p_name")},
    {"section": lambda: ingest.language_section(F.col("s"), "Egyptian")},
    {"section": case(3, _lines("==Egyptian==", "<adj>", "===N===", "<noun>"), _lines("==Egyptian==", "<noun>"), "p_name")},
)


@query(f"""
SELECT p_partkey AS page, 0 AS ord, p_brand AS transliteration, {ADJ} || ' ' || {NOUN} AS definition, p_type AS gardiner FROM part UNION ALL SELECT p_partkey, 1, {NOUN}, '', 'A' || p_size FROM part""")
def dictionary_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracketed head words, text and braced codes; entries without a head word or code are none."""
    text = _lines("[<brand>] <adj>", " <noun> {' || p_type || '} [<noun>]{A<size>} [] x {B1} [y] z {} w")
    return wt.scan_entries(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), F.expr(text).alias("text")))


@query("""SELECT conv_id, CAST(block AS BIGINT) AS block, max(turn) AS page, string_agg(trim(text), '' ORDER BY turn) AS text FROM (
  SELECT *, coalesce(sum(CASE WHEN ends_with(trim(text), '.') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM conversations WHERE turn >= 1) GROUP BY 1, 2""")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns from the second on, gathered until one ends with a full stop."""
    return ingest.accumulate_pages(table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page"), "text"), 1, ".").withColumn("block", F.col("block").cast("long"))


@query("""WITH m AS (SELECT l_orderkey AS page, avg(l_quantity) AS middle FROM lineitem GROUP BY 1)
SELECT page, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_quantity >= middle, l_linenumber, CAST(l_partkey AS VARCHAR)) AS text FROM lineitem JOIN m ON page = l_orderkey GROUP BY page""")
def column_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of the mean place first."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ord"), F.col("l_quantity").alias("x0"), F.col("l_partkey").cast("string").alias("word"))
    return ingest.column_text(rows)


@query("SELECT p_partkey AS sent_ord, p_name AS transliteration, p_type AS translation, NULL AS glossing FROM part")
def corpus_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus written as JSON lines and read again; the part key travels as a date."""
    path = f"{shared_dir(spark)}/corpus-round-trip-{uuid.uuid4().hex}"
    ingest.overwrite_json(table(spark, sf_dir, "part").select(F.col("p_name").alias("transliteration"), F.col("p_type").alias("translation"), F.col("p_partkey").cast("string").alias("dateNotBefore")), path)
    return ingest.read_corpus(spark, path).select(F.col("dateNotBefore").cast("long").alias("sent_ord"), "transliteration", "translation", "glossing")


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2 UNION ALL SELECT NULL, 'missing', count(*) FROM region WHERE r_regionkey < 0")
def table_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches upserted into a bucketed table on disk, whose last version is read; a table that is not there reads as empty."""
    path = f"{shared_dir(spark)}/table-upserts-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    kept = KeyedTable.make(spark, path, e.schema, ["user_id", "event_type"], "event_id", buckets=8)
    kept.append(e.where("false"))
    for k in range(3):
        kept.upsert(e.where(F.col("event_id") % 3 == (2 * k) % 3))
    kept.vacuum()
    none = ingest.read_if_there(spark, path + "-none", e.schema).agg(F.count("*").alias("n"))
    return kept.read().union(none.select(F.lit(None).cast("long"), F.lit("missing"), "n"))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = {"hieroglyphs": f"{SIGN} || ' ' || {OTHER}", "transliteration": f"'(' || p_type || ')' || {ADJ} || ' ' || {NOUN} || '.k'", "UPOS": "'ADJ NOUN'", "lemmatization": f"{ADJ} || '|' || {ADJ} || ' ' || {NOUN} || '|' || {NOUN} || ' none'", "glossing": f"p_brand || ' ' || lower({NOUN})", "translation": "p_brand", "dateNotBefore": "p_size"}
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sent_ord"), *[F.expr(v).cast("string").alias(k) for k, v in e.items()], F.lit(None).cast("string").alias("dateNotAfter"))


@query(f"""
WITH t AS (SELECT p_partkey AS k, {ADJ} AS id, '(' || p_type || ')' || {ADJ} AS translit, 'ADJ' AS upos, p_brand AS gloss, {SIGN} AS glyph, {_code('p_size')} AS code, p_type AS affix, p_brand FROM part
  UNION ALL SELECT p_partkey, {NOUN}, {NOUN} || '.k', 'NOUN', lower({NOUN}), {OTHER}, {_code('p_partkey')}, 'k', p_brand FROM part),
v AS (SELECT id, glyph || translit || gloss AS v, min(k) AS k, any_value(code || ':' || affix) AS c FROM t GROUP BY 1, 2)
SELECT id AS lemma_id, arg_max(translit, k) AS lemma, max(upos) AS upos, arg_max(gloss, k) AS gloss, CAST(count(*) AS BIGINT) AS n_examples, string_agg(p_brand, '|' ORDER BY k) AS examples,
  (SELECT string_agg(c, '|' ORDER BY v.k) FROM v WHERE v.id = t.id) AS variants FROM t GROUP BY id""")
def lexicon_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole lexicon builder: lemmas with their distinct variants in order and an example for each occurrence."""
    out = lex.build_lexicon(_corpus(spark, sf_dir))
    affix = lambda v: F.concat_ws("", F.transform(v["prefixes"], lambda x: F.regexp_replace(x, "[()]", "")), F.transform(v["suffixes"], lambda x: F.regexp_replace(x, "^[.]", "")))
    return out.select("lemma_id", "lemma", "upos", "gloss", F.size("examples").cast("long").alias("n_examples"), joined(F.transform("examples", lambda e: e["translation"])).alias("examples"), joined(F.transform("glyph_variants", lambda v: F.concat(joined(v["gardiner"], "-"), F.lit(":"), affix(v)))).alias("variants"))


@query(f"""
SELECT p_partkey AS sent_ord, CASE WHEN p_size % 3 = 0 THEN '[UNKNOWN](j)' || {ADJ} || '.kw' ELSE '[PRE VERB](j) [VERB]' || {ADJ} || ' [SUF VERB].kw' END || ' [NOUN]' || {NOUN} AS input_text, p_type AS output_text FROM part WHERE p_size % 4 <> 0""")
def token_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched words to tokens, model strings and training examples; pairs with an empty side go."""
    part = table(spark, sf_dir, "part")
    lemma = F.when(F.col("p_size") % 3 != 0, F.expr(ADJ))
    one = part.select(F.col("p_partkey").alias("sent_ord"), F.lit(0).alias("pos"), F.concat(F.lit("(j)"), F.expr(ADJ), F.lit(".kw")).alias("word"), lemma.alias("lemma"), F.lit("VERB").alias("upos"))
    two = part.select("p_partkey", F.lit(1), F.expr(NOUN), F.expr(NOUN), F.lit("NOUN"))
    rows = one.union(two).select("*", F.lit(1).alias("upos_id"), F.lit("").alias("gloss"), F.array().cast("array<string>").alias("gardiner"))
    corpus = _corpus(spark, sf_dir).drop("translation").join(part.select(F.col("p_partkey").alias("sent_ord"), F.when(F.col("p_size") % 4 == 0, " ").otherwise(F.col("p_type")).alias("translation")), "sent_ord")
    keyed = corpus.withColumn("UPOS", F.col("sent_ord").cast("string"))
    return lex.training_examples(keyed, lex.model_text(lex.tokens(rows))).select(F.col("metadata.upos").cast("long").alias("sent_ord"), "input_text", "output_text")


@query(f"SELECT p_partkey AS word_id, p_brand || '+|' || {NOUN} || '+|x-' AS segments FROM part")
def sign_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest sign first; what is no sign stands alone."""
    part, noun = table(spark, sf_dir, "part"), F.expr(NOUN)
    signs = part.select(noun.alias("sign")).union(part.select(F.substring(noun, 1, 2))).union(part.select("p_brand")).distinct()
    words = part.select(F.col("p_partkey").alias("word_id"), F.concat("p_brand", noun, F.lit("x")).alias("glyph"))
    out = lex.segment(words, signs)
    return out.select("word_id", joined(F.transform("segments", lambda s: F.concat(s["glyph"], F.when(s["known"], "+").otherwise("-")))).alias("segments"))


@query("""SELECT 'most' AS what, max(o_custkey) AS a, count(*) AS b FROM orders UNION ALL SELECT 'beyond', o_orderkey, o_custkey FROM (SELECT * FROM orders WHERE o_custkey >= 100 ORDER BY o_orderkey LIMIT 20)
UNION ALL SELECT 'batch', b, n FROM (SELECT least(id // 8, 3) AS b, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS id FROM orders) GROUP BY 1)""")
def id_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest id, the first twenty rows with an id beyond the vocabulary, and the sizes of shuffled batches."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.array(F.lit(0).cast("long"), "o_custkey").alias("ids"))
    out = lex.max_token_id(rows).select(F.lit("most").alias("what"), F.col("max_id").alias("a"), F.col("n").alias("b"))
    out = out.union(lex.offenders(rows, 100, "key").select(F.lit("beyond"), "key", F.array_max("ids")))
    dealt = lex.batches(table(spark, sf_dir, "orders").select("o_orderkey"), 8, 1, "o_orderkey")
    return out.union(dealt.groupBy(F.least("batch", F.lit(3)).alias("b")).agg(F.count("*").alias("n")).select(F.lit("batch"), "b", "n"))


@query("""SELECT a.p_partkey AS entry, CAST(arg_min(b.p_partkey, struct_pack(x := split_part(a.p_type, ' ', 1) <> b.p_type, y := CASE WHEN a.p_type <> b.p_type THEN -o ELSE 0 END, z := CASE WHEN a.p_type <> b.p_type AND o = 0 THEN coalesce(d, 0) ELSE 0 END, w := b.p_partkey)) AS VARCHAR) AS parent
FROM part a JOIN (SELECT *, CASE WHEN p_size % 2 = 0 THEN p_size END AS d FROM part WHERE p_partkey % 5 <> 0) b ON a.p_brand = b.p_brand AND a.p_size % 5 = b.p_size % 5,
LATERAL (SELECT CASE WHEN b.p_size % 7 = 0 THEN 0 ELSE (split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1))::INT + (split_part(a.p_name, ' ', 2) = split_part(b.p_name, ' ', 2))::INT END AS o) WHERE a.p_partkey % 5 = 0 GROUP BY 1""")
def best_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate of the same part of speech, else the first of the largest overlap, else the lowest definition."""
    part, size = table(spark, sf_dir, "part"), F.col("p_size") % 5
    a = part.where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("entry"), "p_brand", size.alias("s"), F.col("p_type").alias("part_of_speech"), F.array(F.upper("p_name")).alias("meanings"))
    meanings = F.when(F.col("p_size") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("p_name"))
    b = part.where("p_partkey % 5 <> 0").select("p_brand", size.alias("s"), F.col("p_partkey").cast("string").alias("c_id"), F.col("p_partkey").alias("c_ord"), F.col("p_type").alias("c_pos"), meanings.alias("c_meanings"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("c_def"))
    return nw.best_matches(a, b, "p_brand", "s").select("entry", "parent")


@query(f"WITH f AS ({FORMS}) SELECT user_id, type, rank, string_agg(CAST(node AS VARCHAR), ',' ORDER BY ord) AS nodes FROM f GROUP BY 1, 2, 3")
def forms_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4."""
    out = ch.forms_by_period(event_forms(spark, sf_dir), "user_id")
    return out.select("user_id", "type", "rank", joined(F.transform("nodes", lambda x: x.cast("string")), ",").alias("nodes"))


@query(f"WITH f AS ({FORMS}) SELECT user_id, node, CAST(row_number() OVER (PARTITION BY user_id ORDER BY rank, ord) AS INT) AS place FROM f")
def period_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3."""
    return ch.in_period_order(event_forms(spark, sf_dir), "user_id").select("user_id", "node", "place")


@query(f"WITH f AS ({FORMS}) SELECT user_id, \"from\", \"to\", 'VARIANT' AS type FROM (SELECT user_id, node AS \"from\", lead(node) OVER (PARTITION BY user_id ORDER BY ord) AS \"to\" FROM f) WHERE \"to\" IS NOT NULL")
def adjacent_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6."""
    return ch.adjacent_variants(event_forms(spark, sf_dir), "user_id").select("user_id", "from", "to", "type")


# Networks: one Egyptian lemma e<k> for each part with every kind of tie, a Demotic lemma below it, and a Coptic one that joins it, stands alone or is lost.
_EGYPTIAN = """'==Egyptian==' || chr(10) || '===Etymology===' || chr(10) || '{{inh|egy|afa-pro|*x' || p_partkey || '}}' || CASE WHEN p_partkey > 0 THEN '{{compound|egy|e' || (p_partkey - 1) || '}}' ELSE '' END || chr(10) || '===Noun===' || chr(10) || '{{egy-noun|m|head=<hiero>H' || p_partkey || '</hiero>}}' || chr(10) || '# m' || p_partkey
|| chr(10) || '====Alternative forms====' || chr(10) || '{{egy-hieroforms|A1|read1=a' || p_partkey || '|date1=New Kingdom|B1|read2=b' || p_partkey || '|date2=Old Kingdom}}' || chr(10) || '====Derived terms====' || chr(10) || '{{l|egy|t' || p_partkey || '}}'
|| chr(10) || '====Descendants====' || chr(10) || '* {{desc|egx-dem|d' || p_partkey || '}}' || chr(10) || '** {{desc|cop|c' || p_partkey || '}}' || chr(10) || '* {{desc|grc|g' || p_partkey || '}}'"""
_DEMOTIC = "'==Demotic==' || chr(10) || '===Etymology===' || chr(10) || '{{inh|egx-dem|egy|e' || p_partkey || '}}' || chr(10) || '===Noun===' || chr(10) || '{{egx-dem-noun}}' || chr(10) || '# md' || p_partkey"
_COPTIC = f"'==Coptic==' || chr(10) || '===Etymology===' || chr(10) || {case(3, chr(39) + '{{der|cop|egy|e' + chr(39) + ' || p_partkey', chr(39) + '{{bor|cop|grc|f' + chr(39) + ' || p_partkey', chr(39) + '{{der|cop|egy|nowhere' + chr(39) + ' || p_partkey', by='p_partkey')} || '}}}}{{{{alter|cop|v' || p_partkey || '|B}}}}' || chr(10) || '===Noun===' || chr(10) || '{{{{cop-noun}}}}' || chr(10) || '# mq' || p_partkey"
_NET = "'egy/' || p_partkey || '/0'"
_OWN = "'cop/' || (2000000 + p_partkey) || '/0'"


def _senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = deal(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    page = lambda base, title, language, text: part.select((F.lit(base) + F.col("p_partkey")).alias("lemma_ord"), F.concat(F.lit(title), F.col("p_partkey").cast("string")).alias("title"), F.lit(language).alias("language"), F.expr(text).alias("full_wikitext"))
    pages = page(0, "e", "Egyptian", _EGYPTIAN).union(page(1000000, "d", "Demotic", _DEMOTIC)).union(page(2000000, "q", "Coptic", _COPTIC))
    names = F.create_map(*[F.lit(x) for x in ("Egyptian", "egy", "Demotic", "dem", "Coptic", "cop")])
    return wt.senses(wt.parse_pages(pages)).withColumn("language", names[F.col("language")])


_SOME = "FROM part WHERE p_partkey"
_WANT_NODES = f"""
SELECT {_NET} AS network_id, 'egy' AS language, 'e' || p_partkey AS form, 'Noun' AS part_of_speech, 'm' || p_partkey AS meanings, 'H' || p_partkey AS hieroglyphs, NULL AS period FROM part
UNION ALL SELECT {_NET}, 'egy', 'a' || p_partkey, 'Noun', '', 'A1', 'New Kingdom' FROM part UNION ALL SELECT {_NET}, 'egy', 'b' || p_partkey, 'Noun', '', 'B1', 'Old Kingdom' FROM part
UNION ALL SELECT {_NET}, 'egy', 't' || p_partkey, 'unknown', '', NULL, NULL FROM part UNION ALL SELECT {_NET}, 'dem', 'd' || p_partkey, 'Noun', 'md' || p_partkey, NULL, NULL FROM part
UNION ALL SELECT {_NET}, 'cop', 'c' || p_partkey, 'unknown', '', NULL, NULL FROM part UNION ALL SELECT {_NET}, 'grc', 'g' || p_partkey, 'unknown', '', NULL, NULL FROM part
UNION ALL SELECT {_NET}, 'afa-pro', '*x' || p_partkey, 'unknown', '', NULL, NULL FROM part UNION ALL SELECT {_NET}, 'egy', 'e' || (p_partkey - 1), 'Noun', 'm' || (p_partkey - 1), 'H' || (p_partkey - 1), NULL {_SOME} > 0
UNION ALL SELECT {_NET}, 'cop', 'q' || p_partkey, 'Noun', 'mq' || p_partkey, NULL, NULL {_SOME} % 3 = 0
UNION ALL SELECT {_OWN}, 'cop', 'q' || p_partkey, 'Noun', 'mq' || p_partkey, NULL, NULL {_SOME} % 3 = 1 UNION ALL SELECT {_OWN}, 'cop', 'v' || p_partkey, 'unknown', '', NULL, NULL {_SOME} % 3 = 1
UNION ALL SELECT {_OWN}, 'grc', 'f' || p_partkey, 'unknown', '', NULL, NULL {_SOME} % 3 = 1"""
_WANT_EDGES = f"""
SELECT {_NET} AS network_id, 'b' || p_partkey AS "from", 'a' || p_partkey AS "to", 'EVOLVES' AS type, 'base' AS notes FROM part UNION ALL SELECT {_NET}, 'e' || p_partkey, 'b' || p_partkey, 'EVOLVES', 'base' FROM part
UNION ALL SELECT {_NET}, 'a' || p_partkey, 'd' || p_partkey, 'DESCENDS', '' FROM part UNION ALL SELECT {_NET}, 'd' || p_partkey, 'c' || p_partkey, 'DESCENDS', '' FROM part UNION ALL SELECT {_NET}, 'a' || p_partkey, 'g' || p_partkey, 'DESCENDS', '' FROM part
UNION ALL SELECT {_NET}, 'e' || p_partkey, 't' || p_partkey, 'DERIVED', 'derived term' FROM part UNION ALL SELECT {_NET}, '*x' || p_partkey, 'e' || p_partkey, 'INHERITED', '' FROM part
UNION ALL SELECT {_NET}, 'e' || (p_partkey - 1), 'e' || p_partkey, 'COMPONENT', 'base' {_SOME} > 0 UNION ALL SELECT {_NET}, 'a' || p_partkey, 'q' || p_partkey, 'DESCENDS', 'attested' {_SOME} % 3 = 0
UNION ALL SELECT {_OWN}, 'q' || p_partkey, 'v' || p_partkey, 'VARIANT', 'Bohairic' {_SOME} % 3 = 1 UNION ALL SELECT {_OWN}, 'f' || p_partkey, 'q' || p_partkey, 'BORROWED', '' {_SOME} % 3 = 1"""


@query(_WANT_NODES)
def network_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the networks built from pages."""
    nodes = nw.network_nodes(_senses(spark, sf_dir))
    return nodes.select("network_id", "language", "form", "part_of_speech", joined(F.col("meanings")).alias("meanings"), "hieroglyphs", "period")


@query(_WANT_EDGES)
def network_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges of the networks built from pages, by the forms of their ends."""
    _, nodes, edges = nw.build_networks(_senses(spark, sf_dir))
    return g.with_ends(edges, nodes, "form").select("network_id", F.col("from_form").alias("from"), F.col("to_form").alias("to"), "type", "notes")


@query(f"""WITH n AS (SELECT 'cop' AS lang, 2000000 + p_partkey AS o, 'q' || p_partkey AS lemma, 3 AS nodes, 2 AS edges {_SOME} % 3 = 1 UNION ALL SELECT 'egy', p_partkey, 'e' || p_partkey, 8 + (p_partkey > 0)::INT + (p_partkey % 3 = 0)::INT, 7 + (p_partkey > 0)::INT + (p_partkey % 3 = 0)::INT FROM part)
SELECT 'NET' || lpad(CAST(row_number() OVER (ORDER BY lang, o) AS VARCHAR), CAST(greatest(5, length(CAST(row_number() OVER (ORDER BY lang, o) AS VARCHAR))) AS INTEGER), '0') AS network_id, lemma AS root_lemma, lang AS root_language, nodes AS n_nodes, edges AS n_edges FROM n""")
def network_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks with sequential ids, and their nested nodes and edges."""
    return nw.nested_export(*nw.build_networks(_senses(spark, sf_dir))).select("network_id", "root_lemma", "root_language", F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"))


@query(f"SELECT 'cop' AS language, 'q' || p_partkey AS lemma, 'nowhere' || p_partkey AS root {_SOME} % 3 = 2")
def network_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11."""
    return nw.orphans(_senses(spark, sf_dir))


def _net(c: str) -> str:
    return f"'n' || lpad(concat({c}), 7, '0')"


@query(f"""WITH m AS (SELECT p_brand, min({_net('p_partkey')}) AS low FROM part GROUP BY 1), f AS (SELECT CASE WHEN part.p_brand = 'Brand#1' THEN {_net('p_partkey')} ELSE low END AS network_id, part.* FROM part JOIN m USING (p_brand))
SELECT DISTINCT network_id, 'w' || p_brand AS form FROM f UNION ALL SELECT network_id, 'u' || p_partkey FROM f""")
def networks_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks that share a form become one, unless the form is a stop word."""
    part = table(spark, sf_dir, "part")
    node = lambda kind, name, i: part.select(F.expr(_net("p_partkey")).alias("network_id"), F.concat_ws("/", F.lit(kind), F.col("p_partkey").cast("string")).alias("id"), F.lit(i).cast("long").alias("node_ord"), F.lit("egy").alias("language"), F.concat(F.lit(kind), F.col(name).cast("string")).alias("form"), *[F.lit("").alias(c) for c in ("period", "dialect", "hieroglyphs")], F.lit(0).alias("etymology_index"), F.array("p_type").alias("meanings"))
    nodes = node("w", "p_brand", 0).union(node("u", "p_partkey", 1))
    edges = part.select(F.expr(_net("p_partkey")).alias("network_id"), F.lit(0).cast("long").alias("edge_ord"), F.concat(F.lit("w/"), F.col("p_partkey").cast("string")).alias("from"), F.concat(F.lit("u/"), F.col("p_partkey").cast("string")).alias("to"), F.lit("VARIANT").alias("type"), F.lit("").alias("notes"))
    roots = part.select(F.expr(_net("p_partkey")).alias("network_id"), F.lit(0).alias("root_etymology_index"))
    _, out, _ = g.merge_networks(nodes, edges, roots, spark.createDataFrame([("egy", "wBrand#1")], "language string, form string"))
    return out.select("network_id", "form")


@query(f"SELECT {_net('p_partkey - p_partkey % 4')} AS network_id, {_net('p_partkey')} AS id FROM part")
def networks_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks move into those they are alternatives of, through chains."""
    part = table(spark, sf_dir, "part")
    nodes = part.select(F.expr(_net("p_partkey")).alias("network_id"), F.expr(_net("p_partkey")).alias("id"))
    edges = part.select(F.expr(_net("p_partkey")).alias("network_id"), F.lit(0).alias("edge_ord"), F.lit("a").alias("from"), F.lit("b").alias("to"), F.lit("VARIANT").alias("type"))
    return g.merge_into(nodes, edges, part.where("p_partkey % 4 > 0").select(F.expr(_net("p_partkey")).alias("source"), F.expr(_net("p_partkey - 1")).alias("target")))[0].select("network_id", "id")


@query("""SELECT 'w' || p_partkey AS network_id, 'e' AS "from", 'd' AS "to" FROM part UNION ALL SELECT 'w' || p_partkey, CASE WHEN p_size % 3 = 0 THEN 'e' ELSE 'd' END, 'c' FROM part WHERE p_size % 3 <> 1 UNION ALL SELECT 'w' || p_partkey, 'd', 'c' FROM part WHERE p_size % 3 = 1""")
def descent_rerouted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge that leaps over Demotic moves to the first Demotic child with meanings, or goes if one leads there."""
    p = deal(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(F.concat(F.lit("w"), F.col("p_partkey").cast("string")).alias("network_id"), (F.col("p_size") % 3).alias("s"))
    node = lambda i, lang, o, m: F.struct(F.lit(i).alias("id"), F.lit(lang).alias("language"), F.lit(o).alias("node_ord"), m.alias("meanings"))
    some, none = F.array(F.lit("x")), F.array().cast("array<string>")
    nodes = p.select("network_id", F.inline(F.array(node("e", "egy", 0, some), node("d", "dem", 1, F.when(F.col("s") == 0, none).otherwise(some)), node("c", "cop", 2, none))))
    edge = lambda a, b, o: F.struct(F.lit(a).alias("from"), F.lit(b).alias("to"), F.lit(o).alias("edge_ord"), F.lit("DESCENDS").alias("type"))
    base = F.array(edge("e", "d", 0), edge("e", "c", 1))
    edges = p.select("network_id", F.inline(F.when(F.col("s") == 1, F.array_append(base, edge("d", "c", 2))).otherwise(base)))
    return g.reroute_descent(nodes, edges).select("network_id", "from", "to")


@query(f"""WITH e AS ({EDGES}), n AS ({NODES}), k AS (SELECT 'n3' AS id UNION SELECT "from" FROM e WHERE "to" = 'n3' UNION SELECT "to" FROM e WHERE "from" = 'n3')
SELECT 'node' AS what, n.id AS a, n.form AS b FROM n JOIN k USING (id) UNION ALL SELECT 'edge', e."from", e."to" FROM e JOIN k x ON x.id = e."from" JOIN k y ON y.id = e."to"
UNION ALL SELECT 'parent', "from", type FROM e WHERE "to" = 'n3' UNION ALL SELECT 'child', "to", type FROM e WHERE "from" = 'n3' UNION ALL SELECT 'found', min(id), NULL FROM n WHERE language = 'nation' AND form = (SELECT n_name FROM nation WHERE n_nationkey = 3)""")
def node_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ego graph of a node with the edges inside, its parents and children, and the node found by form."""
    nodes, edges = property_graph(spark, sf_dir)
    nodes = nodes.withColumn("node_ord", F.lit(0))
    found, links = g.ego_query(nodes, edges, "n3", "ego", 1)
    out = found.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.col("form").alias("b")).union(links.select(F.lit("edge"), "from", "to"))
    out = out.union(g.parents(edges, "n3").select(F.lit("parent"), "id", "type")).union(g.children(edges, "n3").select(F.lit("child"), "id", "type"))
    name = table(spark, sf_dir, "nation").where("n_nationkey = 3").first().n_name
    return out.union(g.find_node(nodes, "nation", name).select(F.lit("found"), "id", F.lit(None).cast("string")))


@query("""SELECT l_orderkey AS network_id, l_suppkey AS "from", l_partkey AS "to", min(l_linenumber) AS edge_ord, arg_min(l_returnflag, l_linenumber) AS type FROM lineitem GROUP BY 1, 2, 3""")
def first_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first edge of each pair in a network."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("network_id"), F.col("l_suppkey").alias("from"), F.col("l_partkey").alias("to"), F.col("l_linenumber").alias("edge_ord"), F.col("l_returnflag").alias("type"))
    return g.distinct_edges(e)


@query("""SELECT l_partkey AS id, arg_min(l_suppkey, l_orderkey * 10 + l_linenumber) AS parent FROM lineitem GROUP BY 1""")
def first_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G18."""
    return g.first_parent(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("from"), F.col("l_partkey").alias("to"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_ord")))


@query("""SELECT p_partkey AS id, first_value(p_partkey) OVER w AS canonical, row_number() OVER w = 1 AS is_first FROM part WINDOW w AS (PARTITION BY p_brand, p_type, p_name ORDER BY p_partkey)""")
def canonical_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("network_id"), F.col("p_type").alias("language"), F.col("p_name").alias("form"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("node_ord"))
    return g.canonical_nodes(rows).select("id", "canonical", "is_first")


@query("""SELECT p_brand AS network_id, count(DISTINCT p_type) AS n_languages, bool_or(p_name = 'red ring') AS has_form FROM part GROUP BY 1""")
def network_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9, R10."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("network_id"), F.col("p_type").alias("language"), F.col("p_name").alias("form"))
    return g.languages_of(rows).join(g.networks_with(rows, "red ring").withColumn("has", F.lit(True)), "network_id", "left").select("network_id", "n_languages", F.coalesce("has", F.lit(False)).alias("has_form"))


@query("""SELECT 'from exists' AS "check", count(*) FILTER (WHERE p_size % 5 = 0) AS n FROM part UNION ALL SELECT 'to exists', 0 UNION ALL SELECT 'type known', count(*) FILTER (WHERE p_size % 7 = 0) FROM part
UNION ALL SELECT 'no self loop', count(*) FILTER (WHERE p_size % 5 <> 0 AND p_size % 3 = 0) FROM part UNION ALL SELECT 'ids differ', 0""")
def graph_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ends that don't exist, unknown types, self loops and repeated ids."""
    part, key, size = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string"), F.col("p_size")
    nodes = part.select(F.lit("g").alias("network_id"), F.explode(F.array(F.concat(F.lit("a"), key), F.concat(F.lit("b"), key))).alias("id"))
    start = F.when(size % 5 == 0, "lost").when(size % 3 == 0, F.concat(F.lit("b"), key)).otherwise(F.concat(F.lit("a"), key))
    return g.violations(nodes, part.select(F.lit("g").alias("network_id"), start.alias("from"), F.concat(F.lit("b"), key).alias("to"), F.when(size % 7 == 0, "ODD").otherwise("VARIANT").alias("type")))


@query("""SELECT network_id, seed FROM (SELECT p_brand AS network_id, seed, row_number() OVER (PARTITION BY seed ORDER BY md5(p_brand || '/' || seed), p_brand) AS n FROM (SELECT DISTINCT p_brand FROM part), range(3) t(seed)) WHERE n = 1""")
def random_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network by chance, the same for the same seed: three seeds."""
    nets = table(spark, sf_dir, "part").select(F.col("p_brand").alias("network_id")).distinct()
    return nw.union(*[g.random_network(nets, k).select("network_id", F.lit(k).cast("long").alias("seed")) for k in range(3)])


@query("""SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'egy' WHEN 1 THEN 'dem' WHEN 2 THEN 'cop' END AS family, CASE WHEN p_size % 4 < 3 AND EXISTS (SELECT 1 FROM part q WHERE q.p_name = part.p_name AND q.p_size % 4 = part.p_size % 4 AND q.p_partkey % 3 = 0)
  THEN (SELECT max(p_partkey) FROM part q WHERE q.p_name = part.p_name AND q.p_size % 4 = part.p_size % 4 AND q.p_partkey % 3 = 0) END AS entry FROM part""")
def parsed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with the parsed lemma of their form and language family."""
    part = table(spark, sf_dir, "part")
    lang = lambda cop: F.element_at(F.array(F.lit("egy"), F.lit("dem"), F.lit(cop), F.lit("grc")), F.col("p_size") % 4 + 1)
    nodes = part.select(F.col("p_partkey").alias("id"), lang("cop-sah").alias("language"), F.col("p_name").alias("form"))
    lemmas = part.where("p_partkey % 3 = 0").select(lang("cop").alias("language"), F.col("p_name").alias("lemma"), F.col("p_partkey").alias("lemma_ord"))
    family = F.when(F.col("language").startswith("cop"), "cop").when(F.col("language") != "grc", F.col("language"))
    return nw.parsed_entries(nodes, lemmas).select("id", family.alias("family"), F.col("entry.lemma_ord").alias("entry"))


@query("""SELECT p_partkey AS id, (SELECT min(l_orderkey) FROM lineitem WHERE l_partkey = p_partkey) AS network_id FROM part""")
def nodes_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first network that holds a node's id."""
    nodes = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("network_id"), F.col("l_linenumber").alias("node_ord"))
    return nw.found_elsewhere(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), nodes).select("id", F.col("found.network_id").alias("network_id"))


@query("""SELECT 's' || s_suppkey AS id, s_name AS form FROM supplier UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation""")
def networks_united(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R7."""
    nodes, _ = property_graph(spark, sf_dir)
    return nw.union(*[nodes.where(F.col("language") == x).select("id", "form") for x in ("supplier", "nation")])


@query(f"""
SELECT lemma_id, 'lemma' AS what, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT {ADJ} AS lemma_id FROM part UNION SELECT DISTINCT {NOUN} FROM part) GROUP BY 1
UNION ALL SELECT {ADJ}, 'variant', count(DISTINCT {SIGN} || '/' || p_type || '/' || p_brand) FROM part GROUP BY 1 UNION ALL SELECT {NOUN}, 'variant', count(DISTINCT {OTHER}) FROM part GROUP BY 1
UNION ALL SELECT {ADJ}, 'example', count(*) FROM part GROUP BY 1 UNION ALL SELECT {NOUN}, 'example', count(*) FROM part GROUP BY 1""")
def lexicon_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 as flat tables: how many lemma rows, variants and examples each lemma has."""
    parts = zip(("lemma", "variant", "example"), lex.lexicon_tables(_corpus(spark, sf_dir)), strict=True)
    return nw.union(*[t.groupBy("lemma_id").agg(F.count("*").alias("n")).select("lemma_id", F.lit(name).alias("what"), "n") for name, t in parts])


@query("""SELECT p_brand AS key, arg_max(p_name, p_partkey) AS x, CAST(dense_rank() OVER (ORDER BY min(p_partkey)) AS BIGINT) AS place FROM part GROUP BY 1""")
def keyed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object of objects with repeated keys, written as one file in order and read by ranges; the last value counts, at the first place."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("key"), F.struct(F.col("p_name").alias("x")).alias("value"))
    path = f"{shared_dir(spark)}/keyed-round-trip-{uuid.uuid4().hex}"
    objects.write_objects(rows.repartitionByRange(1, "p_partkey").sortWithinPartitions("p_partkey"), path)  # one object is one file, which one task streams out
    out = objects.read_objects(spark, path, "struct<x:string>").select("key", "value.x", "ord")
    return out.join(lex.numbered(out, "ord").withColumnRenamed("id", "place"), "ord").select("key", "x", "place")


@query("""SELECT row_number() OVER (ORDER BY o) - 1 AS lemma_ord, title FROM (SELECT n_nationkey AS o, n_name AS title FROM nation WHERE n_nationkey % 5 <> 0)""")
def title_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles listed page by page from a stand-in for the site, written as a cached list and read again; category pages are none."""
    names = [("Category:" if r.n_nationkey % 5 == 0 else "") + r.n_name for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # 25 rows

    def get(params: dict) -> dict:
        at = int(params.get("cmcontinue", 0))
        more = {"continue": {"cmcontinue": str(at + 7)}} if at + 7 < len(names) else {}
        return {"query": {"categorymembers": [{"title": n} for n in names[at : at + 7]]}} | more

    found = list(ingest.list_members(get, "C", retries=1, wait=0))
    path = f"{shared_dir(spark)}/title-list"
    spark.createDataFrame([(found,)], "lemmas array<string>").coalesce(1).select(F.to_json(F.struct("lemmas")).alias("value")).write.mode("overwrite").text(path)
    return ingest.read_titles(spark, path, "demotic")


def _answer(title: str) -> dict:
    if title.startswith("red"):
        return {"query": {"pages": {"-1": {}}}}
    return {"query": {"pages": {"1": {"revisions": [{"slots": {"main": {"*": ingest.check_status(200, "text of " + title)}}}]}}}}


@query("SELECT p_name AS title, CASE WHEN starts_with(p_name, 'red') THEN NULL ELSE 'text of ' || p_name END AS full_wikitext FROM part")
def fetched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages from a stand-in for the site; a missing page is a null text."""
    return ingest.fetch_pages(table(spark, sf_dir, "part").select(F.col("p_name").alias("title")), _answer, pause=0)


@query("""SELECT regexp_extract(code, '^[A-Za-z]+', 0) AS series, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT s || i AS code FROM (VALUES ('A', 60), ('B', 20), ('C', 30), ('D', 70), ('E', 40), ('F', 60), ('G', 60), ('H', 10), ('I', 20), ('K', 10), ('L', 10), ('M', 50), ('N', 51), ('O', 60), ('P', 20), ('Q', 10), ('R', 30), ('S', 50), ('T', 40), ('U', 50), ('V', 40), ('W', 30), ('X', 10), ('Y', 10), ('Z', 20), ('Aa', 50)) v(s, m), LATERAL (SELECT unnest(range(m)) AS i)) GROUP BY 1""")
def sign_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate sign codes by series, 911 in all."""
    return tables.sign_list(spark).groupBy(F.regexp_extract("code", "^[A-Za-z]+", 0).alias("series")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS lemma_ord, 'm' || p_partkey || '|v' || p_partkey || '|z' || p_partkey AS chain FROM part WHERE p_partkey % 2 = 0""")
def forms_own_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is derived from an alternative form's own entry hangs below that form."""
    part = deal(table(spark, sf_dir, "part").select("p_partkey").where("p_partkey % 2 = 0"), "p_partkey")
    page = lambda title, own, body: part.select((2 * F.col("p_partkey") + own).alias("lemma_ord"), F.concat(F.lit(title), F.col("p_partkey").cast("string")).alias("title"), F.lit("Coptic").alias("language"), F.expr(body).alias("full_wikitext"))
    nl = " || chr(10) || "
    head = f"'==Coptic=='{nl}'===Etymology==='{nl}"
    noun = f"{nl}'===Noun==='{nl}'{{{{cop-noun}}}}'{nl}'# thing'"
    pages = page("m", 0, f"{head}'{{{{bor|cop|grc|f}}}} {{{{alter|cop|v' || p_partkey || '|B}}}}'{noun}").union(page("v", 1, f"{head}'{{{{bor|cop|grc|f}}}}'{noun}{nl}'====Derived terms===='{nl}'{{{{l|cop|z' || p_partkey || '}}}}'"))
    _, nodes, edges = nw.build_networks(wt.senses(wt.parse_pages(pages)).withColumn("language", F.lit("cop")))
    named = g.with_ends(edges, nodes, "form")
    first, then = named.where("type = 'VARIANT'"), named.where("type = 'DERIVED' and from_form like 'v%' and cast(split_part(network_id, '/', 2) as long) % 2 = 0").select("network_id", F.col("from").alias("to"), F.col("to_form").alias("z"))
    rows = first.join(then, ["network_id", "to"])
    return rows.select(F.substring("from_form", 2, 20).cast("long").alias("lemma_ord"), F.concat_ws("|", "from_form", "to_form", "z").alias("chain"))


@query(f"""SELECT {_net('p_partkey')} AS network_id, {_net('p_partkey')} || '/r' AS id FROM part UNION ALL SELECT NULL, CAST(count(*) AS VARCHAR) FROM part""")
def network_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root of each network, and how many nodes all roots' ego graphs of degree 0 hold."""
    part = table(spark, sf_dir, "part")
    net = F.expr(_net("p_partkey"))
    nodes = part.select(net.alias("network_id"), F.inline(F.array(F.struct(F.concat(net, F.lit("/x")).alias("id"), F.lit(1).alias("node_ord")), F.struct(F.concat(net, F.lit("/r")).alias("id"), F.lit(0).alias("node_ord")))))
    edges = part.select(net.alias("network_id"), F.concat(net, F.lit("/r")).alias("from"), F.concat(net, F.lit("/x")).alias("to"))
    roots = g.network_roots(nodes)
    return roots.select("network_id", "id").union(g.ego_query(nodes, edges, degrees=0)[0].agg(F.count("*").cast("string").alias("n")).select(F.lit(None).cast("string"), "n"))


@query(f"""WITH n AS (SELECT {_net('p_partkey')} AS net, p_brand, p_partkey, min({_net('p_partkey')}) OVER (PARTITION BY p_brand) AS low FROM part)
SELECT low AS network_id, 'shared ' || p_brand AS "from", 'd' || p_partkey AS "to" FROM n UNION ALL SELECT low, 'd' || p_partkey, 'c' || p_partkey FROM n""")
def networks_older_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged view: edges that leap over Demotic rerouted, networks with a common form made one."""
    part, net = deal(table(spark, sf_dir, "part"), "p_partkey"), F.expr(_net("p_partkey"))
    key = F.col("p_partkey").cast("string")
    node = lambda kind, lang, form, i: part.select(net.alias("network_id"), F.concat(F.lit(kind), key).alias("id"), F.lit(i).cast("long").alias("node_ord"), F.lit(lang).alias("language"), form.alias("form"), F.lit("").alias("period"), F.array().cast("array<string>").alias("dialects"), F.lit("").alias("hieroglyphs"), F.lit(0).alias("etymology_index"), F.array("p_type").alias("meanings"))
    nodes = nw.union(node("e", "egy", F.concat(F.lit("shared "), "p_brand"), 0), node("d", "dem", F.concat(F.lit("d"), key), 1), node("c", "cop", F.concat(F.lit("c"), key), 2))
    edge = lambda a, b, i: F.struct(F.concat(F.lit(a), key).alias("from"), F.concat(F.lit(b), key).alias("to"), F.lit(i).cast("long").alias("edge_ord"), F.lit("DESCENDS").alias("type"), F.lit("").alias("notes"))
    edges = part.select(net.alias("network_id"), F.inline(F.array(edge("e", "d", 0), edge("e", "c", 1))))
    networks = part.select(net.alias("network_id"), F.lit(0).alias("root_etymology_index"))
    _, out, links = nw.merged_networks(nodes, edges, networks, spark.createDataFrame([("egy", "none")], "language string, form string"))
    return g.with_ends(links, out, "form").select("network_id", F.col("from_form").alias("from"), F.col("to_form").alias("to"))
