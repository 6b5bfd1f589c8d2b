"""Scalar operators on dictionary entries: dates, forms, etymologies, display."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from glyphweave.functions import tables as t
from glyphweave.functions.text import let


def _first_name(label: Column, names, value) -> Column:
    return F.coalesce(*[F.when(F.lower(label).contains(n.lower()), F.lit(value(n))) for n in names])


def period(label: Column, older: bool = False) -> Column:
    """P15. older: by the older builder's list, and "Dynasty" only as it is written."""
    n = F.regexp_extract(label, ("" if older else "(?i)") + r"(\d+)(?:st|nd|rd|th)\s+Dynasty", 1)
    return F.when(F.coalesce(label, F.lit("")) == "", F.lit(None).cast("string")).otherwise(F.coalesce(_first_name(label, t.OLDER_PERIODS if older else t.PERIODS, lambda n: n), F.when(n != "", F.concat(n, F.lit("th Dynasty"))), label))


def period_rank(label: Column, older: bool = False) -> Column:
    """P16. older: by the older builder's ranks, for any ordinal number."""
    ranks, dynasties = (t.OLDER_PERIOD_RANKS, t.OLDER_DYNASTY_RANKS) if older else (t.PERIOD_RANKS, t.DYNASTY_RANKS)
    n = F.regexp_extract(label, r"(\d+)(?:st|nd|rd|th)", 1).try_cast("int")
    bucket = reduce(lambda c, x: c.when(n <= x[0], x[1]), dynasties[1:], F.when(n <= dynasties[0][0], dynasties[0][1])).otherwise(t.LATER_DYNASTY)
    dynasty = F.when(n.isNotNull() & (F.lit(older) | F.lower(label).contains("dynasty")), bucket)
    return F.when(F.coalesce(label, F.lit("")) == "", t.NO_DATE).otherwise(F.coalesce(_first_name(label, ranks, ranks.get), dynasty, F.lit(t.OTHER_DATE)))


def form_type(title: Column, note: Column) -> Column:
    """P17."""
    s = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(note, F.lit(""))))
    has = lambda *w: reduce(lambda a, b: a | b, [s.contains(x) for x in w])
    return F.when(has("plural", "pl."), "plural").when(has("dual"), "dual").when(has("feminine", "fem."), "feminine").when(has("god", "deity", "divine"), "god").when(has("determinative"), "determinative").otherwise("base")


def head_hieroglyphs(parameters: Column) -> Column:
    """P18."""
    found = lambda p: F.nullif(F.regexp_extract(parameters, p, 1), F.lit(""))
    return F.regexp_replace(F.coalesce(found(r"head=<hiero>([^<]+)</hiero>"), found(r"head=([^|]+)")), "</?hiero>", "")


def is_alternative(meanings: Column) -> Column:
    """The first meaning only refers to another form."""
    first = F.lower(F.get(meanings, F.lit(0)))
    return F.coalesce(first.startswith("alternative form of") | first.startswith("alternative spelling of"), F.lit(False))


def alternative_target(meanings: Column) -> Column:
    """P19b."""
    named = lambda m: F.regexp_extract(m, r"(?U)(?:\[[^\]]+\]\s*)?[Aa]lternative form of\s+(.+?)(?:\s|$)", 1)
    found = F.transform(meanings, lambda m: F.trim(F.regexp_replace(F.regexp_replace(named(m), "[.,;!?]$", ""), r"\{\{.*?\}\}", "")))
    return F.get(F.filter(found, lambda x: x != ""), F.lit(0))


def ancestor(etymology: Column, language: str) -> Column:
    """P20: the Egyptian ancestor of a Demotic or Coptic word."""
    target = {"dem": "(?:dem|egx-dem)", "cop": r"cop[^|]*"}[language]
    form = F.regexp_extract(etymology, r"\{\{(?:inh|der|bor)\|" + target + r"\|egy\|([^|}]+)", 1)
    return F.nullif(F.trim(F.regexp_replace(form, "<[^>]*>", "")), F.lit(""))


def older_ancestor(etymology: Column, code: str) -> Column:
    """P20 of the older builder, as a struct (language, form): what the first inh template of the language names, else the first m template; null without one."""
    part = lambda pattern, k: F.trim(F.regexp_extract(etymology, pattern, k))
    inherited, mentioned = r"\{\{inh\|" + code + r"\|([^|]+)\|([^|}\s]+)", r"\{\{m\|([^|]+)\|([^|}\s]+)"
    form = F.regexp_replace(part(inherited, 2), "<hiero>.*?</hiero>", "")
    return F.when(F.regexp_like(etymology, F.lit(inherited)), F.struct(part(inherited, 1).alias("language"), form.alias("form"))).when(F.regexp_like(etymology, F.lit(mentioned)), F.struct(part(mentioned, 1).alias("language"), part(mentioned, 2).alias("form")))


def descendant_language(code: Column) -> Column:
    """P21."""
    return F.coalesce(t.lookup(t.DESCENDANT_CODES, code), code)


def language_name(code: Column) -> Column:
    """P22."""
    return F.coalesce(t.lookup(t.LANGUAGES, code), code)


def page_url(form: Column, language: Column) -> Column:
    """P23."""
    return F.concat(F.lit("https://en.wiktionary.org/wiki/"), F.replace(F.url_encode(form), F.lit("+"), F.lit("%20")), F.lit("#"), F.replace(language, F.lit(" "), F.lit("_")))


def phonetic_code(code: Column) -> Column:
    """P24."""
    table = t.mapping(t.PHONETIC)
    return F.coalesce(F.try_element_at(table, code), F.try_element_at(table, F.upper(code)), F.when(code.rlike(r"(?i)^[A-Z]a?a?\d+[A-Za-z]?$"), code))


def layout(text: Column, codes: dict[str, str] | None = None) -> Column:
    """P25: lines (by !), blocks (by blanks or hyphens), stacks (by :), rows (by *), as nested arrays of codes.

    codes: phonetic values to replace; a part that is one, with case as written and else in any case, is replaced.
    """
    table = codes or t.PHONETIC
    exact, any_case = t.mapping(table), t.mapping({k.lower(): v for k, v in reversed(table.items())})
    name = lambda g: F.coalesce(F.try_element_at(exact, g), F.try_element_at(any_case, F.lower(g)), g)
    parts = lambda x, p: F.filter(F.split(x, p), lambda y: F.trim(y) != "")
    inner = lambda stack: F.transform(parts(stack, r"\*"), lambda g: name(F.trim(g)))
    block = lambda b: F.transform(parts(b, ":"), inner)
    plain = F.regexp_replace(text, "</?hiero>", "")
    return F.transform(parts(plain, "!"), lambda line: F.transform(parts(line, r"(?U)[\s\-]+"), block))


def layout_text(text: Column) -> Column:
    """Glyphs of a layout text; unknown parts are dropped."""
    table = t.mapping({k: v for k, v in t.code_glyphs().items()} | {k.upper(): v for k, v in t.code_glyphs().items() if k.upper() not in t.code_glyphs()})
    parts = F.filter(F.split(F.trim(F.regexp_replace(text, "</?hiero>", "")), r"(?U)[\s:\-&*]+"), lambda p: (p != "") & ~p.contains("_"))
    found = F.transform(parts, lambda p: F.coalesce(F.try_element_at(table, p), F.try_element_at(table, F.upper(p))))
    return F.array_join(F.filter(found, lambda g: g.isNotNull()), "")


def clean_meanings(meanings: Column) -> Column:
    """P27."""

    def one(m: Column) -> Column:
        m = F.regexp_replace(m, r"\{\{[^}]*\}\}", "")
        return F.trim(F.regexp_replace(F.regexp_replace(m, r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"), r"\[\[([^\]]*)\]\]", "$1"))

    return F.filter(F.transform(meanings, one), lambda m: F.length(m) > 2)


def etymology_display(text: Column) -> Column:
    """Without headings, templates read as their last parameter."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"={2,}[^=]+={2,}", ""), r"\{\{(?:[^{}|]*\|)*([^{}|]*)\}\}", "$1"))


def etymology_hieroglyphs(etymologies: Column, index: Column) -> Column:
    """Head forms and alternative forms of one etymology; a missing number falls back to the place."""
    chosen = F.filter(etymologies, lambda e, i: F.coalesce(e["etymology_number"], i + 1) == index + 1)
    heads = F.filter(F.flatten(F.transform(chosen, lambda e: F.transform(e["definitions"], lambda d: head_hieroglyphs(d["parameters"])))), lambda h: h.isNotNull())
    alts = F.filter(F.flatten(F.transform(chosen, lambda e: F.flatten(F.transform(e["definitions"], lambda d: F.transform(F.coalesce(d["alternative_forms"], F.array()), lambda a: a["hieroglyphs"]))))), lambda h: h.isNotNull())
    return F.array_distinct(F.concat(F.reverse(heads), alts))


def node_colour(language: Column) -> Column:
    """P30."""
    family = F.when(language.startswith("cop"), "cop").otherwise(language)
    return F.coalesce(t.lookup(t.NODE_COLOURS, family), F.lit("#ddd"))


def edge_colour(kind: Column) -> Column:
    return F.coalesce(t.lookup(t.EDGE_COLOURS, kind), F.lit("#999"))


def edge_dash(kind: Column) -> Column:
    return F.coalesce(t.lookup(t.EDGE_DASHES, kind), F.lit("0"))


def snippet(meanings: Column, most: int = 80) -> Column:
    """P31."""
    first = F.get(meanings, F.lit(0))
    return F.when(first.isNull() | (first == ""), "No meaning available").when(F.length(first) > most, F.concat(F.substring(first, 1, most), F.lit("..."))).otherwise(first)


def tooltip(meanings: Column) -> Column:
    plain = F.transform(F.slice(meanings, 1, 3), lambda m: F.substring(F.regexp_replace(m, r"\{\{[^}]*\}\}", ""), 1, 100))
    return F.array_join(plain, "; ")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "reduce", "let", "t", "F", "Column")]
