"""Scalar string operators on words, glyphs and tokens."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from glyphweave.functions.tables import code_glyphs, glyph_codes, mapping

ROOM = r"(?U)\s+"


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def affixes(word: Column) -> Column:
    """(prefixes, root, suffixes); prefixes are leading bracketed groups, suffixes trailing runs after . or =."""
    pre = F.regexp_extract(word, r"^((?:\([^)]+\))*)", 1)

    def rest(p: Column) -> Column:
        left = F.substring(word, F.length(p) + 1, F.length(word))
        suf = F.regexp_extract(left, r"(?U)((?:[.=][^\s.=]+)*)$", 1)
        return F.struct(
            F.regexp_extract_all(p, F.lit(r"\([^)]+\)"), 0).alias("prefixes"),
            F.substring(left, F.lit(1), F.length(left) - F.length(suf)).alias("root"),
            F.regexp_extract_all(suf, F.lit(r"(?U)[.=][^\s.=]+"), 0).alias("suffixes"),
        )

    return let(pre, rest)


def lemma_affixes(word: Column, lemma: Column) -> Column:
    """As affixes(), but prefixes end at the first with which the lemma starts, suffixes (from the right) at the first with which it ends."""
    stop_at = lambda test: lambda acc, x: F.when(acc["stop"] | test(x), F.struct(F.lit(True).alias("stop"), acc["taken"].alias("taken"))).otherwise(F.struct(F.lit(False).alias("stop"), F.array_append(acc["taken"], x).alias("taken")))
    none = F.struct(F.lit(False).alias("stop"), F.array().cast("array<string>").alias("taken"))
    taken = lambda xs, test: F.aggregate(xs, none, stop_at(test), lambda acc: acc["taken"])

    def body(a: Column) -> Column:
        pre = taken(a["prefixes"], lambda x: F.coalesce(lemma.startswith(x), F.lit(False)))
        suf = F.reverse(taken(F.reverse(a["suffixes"]), lambda x: F.coalesce(lemma.endswith(x), F.lit(False))))
        left = F.array_join(F.slice(a["prefixes"], F.size(pre) + 1, F.greatest(F.size(a["prefixes"]) - F.size(pre), F.lit(0))), "")
        right = F.array_join(F.slice(a["suffixes"], F.lit(1), F.greatest(F.size(a["suffixes"]) - F.size(suf), F.lit(0))), "")
        return F.struct(pre.alias("prefixes"), F.concat(left, a["root"], right).alias("root"), suf.alias("suffixes"))

    return let(affixes(word), body)


def _code(c: Column, compat: bool) -> Column:
    return F.coalesce(F.try_element_at(mapping(glyph_codes(compat)), c), F.concat(F.lit("UNK("), c, F.lit(")")))


def glyph_code(glyphs: Column, compat: bool = False) -> Column:
    """The sign code of each code point."""
    return F.transform(F.filter(F.split(glyphs, ""), lambda c: c != ""), lambda c: _code(c, compat))


def mixed_codes(text: Column, compat: bool = False) -> Column:
    """Codes of a text in which <g>CODE</g> names signs; white space and variation selectors are dropped."""
    parts = F.regexp_extract_all(text, F.lit("(?s)<g>.*?</g>|."), 0)
    one = lambda p: F.when(p.startswith("<g>") & p.endswith("</g>"), F.upper(F.regexp_replace(p, "^<g>|</g>$", ""))).otherwise(_code(p, compat))
    kept = F.filter(parts, lambda p: ~p.rlike(r"(?U)^\s$"))
    return F.filter(F.transform(kept, one), lambda c: ~c.isin("UNK()", "UNK(\ufe02)"))


def segment_codes(text: Column, compat: bool = False) -> Column:
    """Codes without marks, format characters and spaces."""
    return glyph_code(F.regexp_replace(text, r"(?U)[\p{Mn}\p{Cf}\s]", ""), compat)


def sentence_clusters(sentence: Column) -> Column:
    """Words as arrays of glyph clusters."""
    words = F.filter(F.split(sentence, ROOM), lambda w: w != "")
    return F.transform(words, lambda w: F.regexp_extract_all(w, F.lit("<g>.*?</g>|[A-Z]{1,2}[0-9]{1,3}[A-Za-z]*|."), 0))


def sentence_codes(sentence: Column, compat: bool = False) -> Column:
    """Words as arrays of codes."""
    return F.transform(sentence_clusters(sentence), lambda w: F.flatten(F.transform(w, lambda c: mixed_codes(c, compat))))


def codes_to_text(sentence: Column) -> Column:
    """P5: code sentence (words by blanks, codes by hyphens) to glyphs; unknown codes read U+FFFD."""
    table = mapping(code_glyphs())
    word = lambda w: F.array_join(F.transform(F.split(w, "-"), lambda k: F.coalesce(F.try_element_at(table, k), F.lit("\ufffd"))), "")
    return F.array_join(F.transform(F.split(sentence, " "), word), " ")


def is_prefix(x: Column) -> Column:
    """P6."""
    return x.rlike(r"^\([a-zA-Z]+\)\z")


def is_suffix(x: Column) -> Column:
    return x.rlike(r"^[.=][a-zA-Z]+\z")


def is_determinative(x: Column) -> Column:
    return x.isin("", "-")


def morph_marker(text: Column, prefix: Column, suffix: Column, determinative: Column) -> Column:
    """P7."""
    return F.concat(text, F.when(prefix, "[prefix]").when(suffix, "[suffix]").when(determinative, "[det]").otherwise(""))


def token_type(kind: Column, upos: Column) -> Column:
    """The tag of a token from its kind (PREFIX, SUFFIX, ROOT, UNKNOWN) and the first of its parts of speech."""
    first = F.element_at(F.split(upos, r"[,;]\s*"), 1)
    return F.when(kind == "PREFIX", F.concat(F.lit("PRE "), first)).when(kind == "SUFFIX", F.concat(F.lit("SUF "), first)).when(kind == "ROOT", F.coalesce(F.nullif(first, F.lit("")), F.lit("ROOT"))).otherwise("UNKNOWN")


def model_string(tokens: Column) -> Column:
    """[type]token ... of an array of structs."""
    return F.array_join(F.transform(tokens, lambda t: F.concat(F.lit("["), t["type"], F.lit("]"), t["token"])), " ")


def model_string_long(tokens: Column) -> Column:
    """P9, older form: [UPOS] glyph [lemma] [gloss]."""
    part = lambda x: F.concat(F.lit("["), F.coalesce(x, F.lit("")), F.lit("]"))
    return F.array_join(F.transform(tokens, lambda t: F.concat_ws(" ", part(t["upos"]), t["glyph"], part(t["lemma"]), part(t["gloss"]))), " ")


def source_text(hieroglyphs: Column, transliteration: Column, lemma: Column, gloss: Column) -> Column:
    """P11."""
    parts = (("[HIERO] ", hieroglyphs), ("\n[TRANS] ", transliteration), ("\n[LEMMA] ", lemma), ("\n[GLOSS] ", gloss))
    return F.concat(*[x for tag, c in parts for x in (F.lit(tag), F.coalesce(c, F.lit("")))])


def pad(ids: Column, size: int, value: int = 0) -> Column:
    """Cut or fill to size; use value -100 for labels."""
    return F.concat(F.slice(ids, 1, size), F.array_repeat(F.lit(value), F.greatest(F.lit(size) - F.size(ids), F.lit(0))))


def mask_labels(ids: Column, pad_id: int = 0) -> Column:
    return F.transform(ids, lambda x: F.when(x == pad_id, -100).otherwise(x))


def shift(ids: Column) -> Column:
    """(decoder input, decoder output)."""
    most = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.struct(F.slice(ids, F.lit(1), most).alias("input"), F.slice(ids, F.lit(2), most).alias("output"))


def clean(text: Column) -> Column:
    """Newline runs to blanks, trimmed."""
    return F.trim(F.regexp_replace(text, r"\n+", " "))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, ROOM, " "))
