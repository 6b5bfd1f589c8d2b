"""Dictionary pages in wikitext to nested rows: X1-X14.

Sections, templates and definitions nest, so a page goes through one grammar in Python, page by page in Arrow batches; all
that follows (senses, forms, descendants) is exploded and joined in Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from glyphweave.functions.tables import DIALECTS
from glyphweave.operators import trees
from glyphweave.session import deal

# Part-of-speech headings, and template names by what becomes of them in a definition.
POS = ("Noun", "Verb", "Adjective", "Adverb", "Pronoun", "Preposition", "Particle", "Conjunction", "Interjection", "Numeral", "Proper noun")
SECOND_VALUE = {"m", "l", "w", "taxfmt", "cog", "inh"}
LINKS = {"l", "link", "m", "mention"}
COLUMNS_POS = {"col", "col2", "col3", "col4", "col5"}
COLUMNS_ETYM = {"col3", "col4", "col5"}
ANCESTOR = {"der": "der", "derived": "der", "inh": "inh", "inherited": "inh", "bor": "bor", "borrowed": "bor"}
AFFIXED = {"prefix": "prefix", "suffix": "suffix", "compound": "compound", "affix": "affix", "confix": "confix"}
ALTERNATIVE = {"alternative form of", "alt form", "altform", "alternative spelling of"}
DIALECT_NAMES = tuple(DIALECTS.values())

FORM = "struct<hieroglyphs:string,transliteration:string,date:string,note:string,title:string,form:string,dialect:string>"
COMPONENT = "struct<form:string,role:string,template_type:string,language:string>"
DESCENDANT = "struct<ord:int,parent_ord:int,level:int,language:string,word:string>"
DEFINITION = f"struct<part_of_speech:string,parameters:string,definitions:array<string>,inflection:string,usage_notes:string,derived_terms:array<string>,synonyms:array<string>,alternative_forms:array<{FORM}>,alternative_forms_from_definitions:array<string>,descendants:array<{DESCENDANT}>,etymology_components:array<{COMPONENT}>>"
ETYMOLOGY = f"struct<etymology_number:int,etymology_text:string,definitions:array<{DEFINITION}>,components:array<{COMPONENT}>,ancestors:array<struct<language:string,form:string,type:string>>>"
PAGE = f"lemma_ord long, lemma string, language string, pronunciations array<string>, etymologies array<{ETYMOLOGY}>, references string"

_LIST, _fields = pa.list_(pa.string()), lambda names: pa.struct([(n, pa.string()) for n in names.split()])
_COMPONENTS = pa.list_(_fields("form role template_type language"))
_DEFINITION = pa.struct([
    *[(n, pa.string()) for n in ("part_of_speech", "parameters")], ("definitions", _LIST), *[(n, pa.string()) for n in ("inflection", "usage_notes")], *[(n, _LIST) for n in ("derived_terms", "synonyms")],
    ("alternative_forms", pa.list_(_fields("hieroglyphs transliteration date note title form dialect"))), ("alternative_forms_from_definitions", _LIST),
    ("descendants", pa.list_(pa.struct([*[(n, pa.int32()) for n in ("ord", "parent_ord", "level")], *[(n, pa.string()) for n in ("language", "word")]]))), ("etymology_components", _COMPONENTS),
])
_ETYMOLOGY = pa.struct([("etymology_number", pa.int32()), ("etymology_text", pa.string()), ("definitions", pa.list_(_DEFINITION)), ("components", _COMPONENTS), ("ancestors", pa.list_(_fields("language form type")))])
#: PAGE in Arrow's types.
_ARROW = pa.schema([("lemma_ord", pa.int64()), *[(n, pa.string()) for n in ("lemma", "language")], ("pronunciations", _LIST), ("etymologies", pa.list_(_ETYMOLOGY)), ("references", pa.string())])


_MARK, _BRACES = re.compile(r"\{\{|\[\[|\}\}|\]\]"), re.compile(r"\{\{|\}\}")


def split_top(text: str, sep: str = "|") -> list[str]:
    """Parts at a separator outside of {{ }} and [[ ]]."""
    if "{{" not in text and "[[" not in text:
        return text.split(sep)
    out, depth, at, i = [], 0, 0, 0
    for m in [*_MARK.finditer(text), None]:
        end = m.start() if m else len(text)
        while depth <= 0 and (found := text.find(sep, i, end)) >= 0:
            out.append(text[at:found])
            at = i = found + 1
        if m:
            depth, i = depth + (1 if m[0] in ("{{", "[[") else -1), m.end()
    return [*out, text[at:]]


def templates(text: str) -> Iterator[tuple[int, int, str, dict[str, str]]]:
    """(start, end, name, parameters) of all templates, outer ones before inner ones."""
    stack, found = [], []
    for m in _BRACES.finditer(text):
        if m[0] == "{{":
            stack.append(m.start())
        elif stack:
            found.append((stack.pop(), m.end()))
    for start, end in sorted(found):
        name, params = parameters(text[start + 2 : end - 2])
        yield start, end, name, params


def parameters(inside: str) -> tuple[str, dict[str, str]]:
    """Name, and parameters by name; unnamed ones are numbered from 1."""
    name, *parts = split_top(inside)
    out, n = {}, 0
    for p in parts:
        key, eq, value = p.partition("=")
        if eq and re.fullmatch(r"[\w\s-]+", key):
            out[key.strip()] = value.strip()
        else:
            n += 1
            out[str(n)] = p.strip()
    return name.strip(), out


def plain(text: str) -> str:
    """Text without templates, links, markup and comments."""
    text = re.sub(r"<!--.*?-->|<ref[^>]*/>|<ref.*?</ref>", "", text, flags=re.S)
    while True:
        new = re.sub(r"\{\{[^{}]*\}\}", "", text)
        if new == text:
            break
        text = new
    text = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", r"\1", text)
    return re.sub(r"'{2,}|<[^>]+>", "", text).strip()


def replace_templates(text: str, how) -> str:
    """Outer templates replaced by how(name, params); None leaves one to plain(). Inner ones go with the outer ones."""
    out, at = [], 0
    for start, end, name, params in templates(text):
        if start >= at:
            new = how(name, params)
            out += [text[at:start], text[start:end] if new is None else new]
            at = end
    return "".join([*out, text[at:]])


def sections(text: str, level: int) -> list[tuple[str, str]]:
    """(heading, body with its deeper sections) at a level."""
    marks = list(re.finditer(r"^(={2,6})\s*(.*?)\s*\1\s*$", text, re.M))
    out = []
    for i, m in enumerate(marks):
        if len(m[1]) == level:
            end = next((n.start() for n in marks[i + 1 :] if len(n[1]) <= level), len(text))
            out.append((m[2], text[m.end() : end]))
    return out


def own_text(body: str) -> str:
    """A section's text before its first deeper heading."""
    return re.split(r"^={2,6}[^=].*$", body, maxsplit=1, flags=re.M)[0]


def hieroforms(p: dict[str, str]) -> list[dict]:
    """X2."""
    return [{"hieroglyphs": re.sub(r"</?hiero>", "", p[str(i)]), "transliteration": p.get(f"read{i}"), "date": p.get(f"date{i}"), "note": p.get(f"note{i}"), "title": p.get("title")} for i in range(1, 100) if p.get(str(i))]


def _in_definition(name: str, p: dict[str, str]) -> str | None:
    values = [v for k, v in p.items() if k.isdigit()]
    if name in ("lb", "label"):
        return "[" + ", ".join(values[1:]) + "]"
    if name == "defdate":
        return f"(dated: {', '.join(values)})"
    if name == "ng":
        return values[0] if values else ""
    if name == "def-uncertain":
        return "[uncertain]"
    if name in ALTERNATIVE:
        return f"Alternative form of {values[1] if len(values) > 1 else ''}"
    if name in SECOND_VALUE:
        return values[1] if len(values) > 1 else (values[0] if values else "")
    if name in ("q", "qualifier"):
        return ", ".join(values)
    return "" if name == "sup" else None


def definitions(body: str, compat: bool = False) -> list[str]:
    """Lines with one leading #; #: and #* lines are examples (compat takes them in)."""
    out = []
    for line in own_text(body).split("\n"):
        if re.match(r"#(?!#)" if compat else r"#(?![#:*])", line):
            text = plain(replace_templates(line.lstrip("#"), _in_definition))
            if text:
                out.append(text)
    return out


def descendants(body: str, compat: bool = False) -> list[dict]:
    """X4e, W8: {{desc}} lines as a tree; the words of one template are siblings, and the first is parent of what is deeper."""
    out, stack = [], []
    for line in body.split("\n"):
        stars = re.match(r"\s*(\*+)", line)
        if not stars or "{{desc" not in line:
            continue
        depth = len(stars[1]) - 1
        if compat:
            stack = stack[:depth]
        else:
            while stack and stack[-1][0] >= depth:
                stack.pop()
        if compat and depth > 0 and not stack:
            continue
        parent = (stack[-1][1] if stack else None) if depth else None
        if depth and parent is None:
            continue
        first = None
        for _, _, name, p in templates(line):
            if name not in ("desc", "descendant"):
                continue
            values = [v for k, v in p.items() if k.isdigit()]
            words = [v for v in values[1:] if v] or ([p["tr"]] if p.get("tr") else [])
            for word in words:
                out.append({"ord": len(out), "parent_ord": parent, "level": depth, "language": values[0] if values else "", "word": re.sub(r"<[^>]*>", "", word)})
                first = out[-1]["ord"] if first is None else first
        if first is not None:
            stack.append((depth, first))
    return out


def terms(body: str, columns: set[str]) -> list[str]:
    """X4d, X6: linked terms in order, each once."""
    out: list[str] = []
    for _, _, name, p in templates(body):
        values = [v for k, v in p.items() if k.isdigit()]
        if name in LINKS:
            out += values[1:2]
        elif name in columns:
            out += [v.split("<")[0] for v in values[1:]]
    return [t for t in dict.fromkeys(x.strip() for x in out) if t]


def alternative_forms(body: str) -> list[dict]:
    """X4b."""
    out: list[dict] = []
    for _, _, name, p in templates(body):
        if "hieroforms" in name:
            out += hieroforms(p)
        elif name in ("alter", "alt"):
            values = [v for k, v in p.items() if k.isdigit()][1:]
            dialect = next((v for v in values if v in DIALECT_NAMES), None)
            out += [{"form": v, "dialect": dialect} for v in values if v and v not in DIALECT_NAMES]
    return out


def coded_forms(body: str) -> list[dict]:
    """Codes and names of dialects belong to the form before them."""
    out: list[dict] = []
    for _, _, name, p in templates(body):
        if name not in ("alter", "alt"):
            continue
        for v in [v for k, v in p.items() if k.isdigit()][1:]:
            dialect = DIALECTS.get(v) or (v if v in DIALECT_NAMES else None)
            if dialect:
                if out and not out[-1].get("dialect"):
                    out[-1]["dialect"] = dialect
            elif v:
                out.append({"form": v})
    return out


def ancestors(text: str) -> list[dict]:
    """X7."""
    return [{"language": p.get("2"), "form": re.sub(r"<[^>]*>", "", p["3"]), "type": ANCESTOR[name]} for _, _, name, p in templates(text) if name in ANCESTOR and p.get("3")]


def components(text: str, language: str) -> list[dict]:
    """Parts named by affix templates, and linked words where a derivation or compound is told. A part is a suffix if its mark comes first, a prefix if last."""
    out: list[dict] = []
    told = "{{der" in text or "{{compound" in text
    for _, _, name, p in templates(text):
        values = [v for k, v in p.items() if k.isdigit()]
        if name in LINKS and told and values[:1] and values[0] in ("egy", "egx-dem", "dem") and len(values) > 1:
            out.append({"form": values[1], "role": "base", "template_type": name, "language": values[0]})
        elif name in AFFIXED and values:
            for form in values[1:]:
                if not form or (language != "Egyptian" and re.fullmatch(r"[A-Za-z]+", form)):
                    continue
                role = "suffix" if form[0] in "-.=" else "prefix" if form[-1] in "-.=" else "base"
                out.append({"form": form, "role": role, "template_type": AFFIXED[name], "language": values[0]})
    return [dict(x) for x in dict.fromkeys(tuple(c.items()) for c in out)]


def pos_block(heading: str, body: str, level: int, language: str) -> dict:
    """X4."""
    own = own_text(body)
    head = next((p for _, _, name, p in templates(own) if re.match(r"(egy|cop|dem|egx-dem)-", name)), None)
    out = {"part_of_speech": heading, "parameters": "|".join(v if k.isdigit() else f"{k}={v}" for k, v in head.items()) if head else None, "definitions": definitions(body), "descendants": []}
    out["alternative_forms_from_definitions"] = [m[1].rstrip(".,;:") for d in out["definitions"] if (m := re.search(r"(?i)(?:Alternative|Alternate)\s+(?:form|spelling|orthography)\s+of\s+(\S+)", d))]
    for name, sub in sections(body, level + 1):
        if name in ("Inflection", "Declension", "Conjugation"):
            found = next((p for _, _, n, p in templates(sub) if "decl" in n or "conj" in n), None)
            out["inflection"] = "|".join(found.values()) if found else None
        elif name == "Alternative forms":
            out["alternative_forms"] = alternative_forms(sub)
        elif name == "Usage notes":
            out["usage_notes"] = plain(replace_templates(sub, lambda n, p: p.get("2") or p.get("1", "") if n in ("m", "l", "w") else None)) or None
        elif name == "Derived terms":
            out["derived_terms"] = terms(sub, COLUMNS_POS)
        elif name == "Synonyms":
            out["synonyms"] = terms(sub, COLUMNS_POS)
        elif name == "Descendants":
            out["descendants"] = descendants(sub)
    return out


def etymology_block(number: int | None, body: str, level: int, language: str) -> dict:
    """The text before the first part of speech, and a block for each; what the section tells goes to all blocks."""
    before = re.split(r"^={2,6}\s*(?:" + "|".join(POS) + r")\s*={2,6}\s*$", body, maxsplit=1, flags=re.M)[0]
    forms, derived, parts = coded_forms(before), terms("".join(b for h, b in sections(body, level) if h == "Derived terms"), COLUMNS_ETYM), components(before, language)
    blocks = [pos_block(h, b, level, language) for h, b in sections(body, level) if h in POS]
    for b in blocks:
        b["alternative_forms"] = (b.get("alternative_forms") or []) + [f for f in forms if f not in (b.get("alternative_forms") or [])]
        b["derived_terms"] = list(dict.fromkeys((b.get("derived_terms") or []) + derived))
        b["etymology_components"] = parts
    return {"etymology_number": number, "etymology_text": own_text(before).strip(), "definitions": blocks, "components": parts, "ancestors": ancestors(before)}


def parse_page(text: str | None, language: str) -> dict:
    """X11."""
    body = next((b for h, b in sections(text or "", 2) if h == language), None)
    out = {"pronunciations": [], "etymologies": [], "references": None}
    if body is None:
        return out
    subs = sections(body, 3)
    for h, b in subs:
        if h == "Pronunciation":
            out["pronunciations"] = ["|".join([n, *p.values()]) for _, _, n, p in templates(b) if "IPA" in n or "pron" in n]
        elif h == "References":
            out["references"] = plain(b) or None
    numbered = dict(subs)
    for i in range(1, 20):
        if f"Etymology {i}" not in numbered:
            break
        out["etymologies"].append(etymology_block(i, numbered[f"Etymology {i}"], 4, language))
    if not out["etymologies"]:
        block = etymology_block(None, body, 3, language)
        if "Etymology" in numbered:
            block |= {"etymology_text": own_text(numbered["Etymology"]).strip(), "components": components(numbered["Etymology"], language), "ancestors": ancestors(numbered["Etymology"])}
        out["etymologies"].append(block)
    return out


def parse_pages(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """Pages (lemma_ord, title, language, full_wikitext) as nested rows; all three languages. parts: deal the pages anew into so many parts or more, for inputs of few files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"lemma_ord": o, "lemma": title, "language": language} | parse_page(text, language) for o, title, language, text in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    rows = pages.select(F.col("lemma_ord").cast("long"), "title", "language", "full_wikitext")
    return (deal(rows, "language", "lemma_ord", parts=parts) if parts else rows).mapInArrow(run, PAGE)


def senses(parsed: DataFrame) -> DataFrame:
    """One row per definition block: (language, lemma_ord, lemma, etym_idx, etymology_text, components, ancestors, def_idx, the block's fields, meanings)."""
    e = parsed.select("language", "lemma_ord", "lemma", F.posexplode("etymologies").alias("etym_idx", "e"))
    e = e.select("language", "lemma_ord", "lemma", "etym_idx", "e.etymology_number", "e.etymology_text", F.col("e.components").alias("components"), F.col("e.ancestors").alias("ancestors"), F.posexplode_outer("e.definitions").alias("def_idx", "d"))
    return e.select(*[c for c in e.columns if c != "d"], "d.*").withColumnRenamed("definitions", "meanings")


def nested_pages(parsed: DataFrame) -> DataFrame:
    """M7, M7d: (key, value) of parsed pages for exchange, by lemma: value has the etymologies with their descendants as trees. sources.objects writes them as objects."""
    tree = lambda d: d.withField("descendants", trees.nested(d["descendants"]))
    each = F.transform("etymologies", lambda e: e.withField("definitions", F.transform(e["definitions"], tree)))
    return parsed.select(F.col("lemma").alias("key"), F.struct("lemma_ord", "language", "pronunciations", each.alias("etymologies"), "references").alias("value"))


def simple_page(text: Column, compat: bool = False) -> Column:
    """The older parser in regular expressions: (etymologies, parts of speech, hieroglyphs). compat: headers are never seen, only codes."""
    codes = F.regexp_extract_all(text, F.lit(r"\{\{egy-h\|([^|}]+)"), 1)
    forms = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"\{\{egy-hieroforms\|([^}]*)\}\}"), 1), lambda x: F.filter(F.split(x, r"\|"), lambda y: ~y.contains("="))))
    found = F.array_distinct(F.concat(codes, F.transform(forms, lambda x: F.regexp_replace(x, "</?hiero>", ""))))
    if compat:
        none = F.array().cast("array<string>")
        return F.struct(F.lit(0).alias("n_etymologies"), none.alias("parts_of_speech"), found.alias("hieroglyphs"))
    heads = F.regexp_extract_all(text, F.lit(r"(?m)^===+\s*([^=]+?)\s*===+\s*$"), 1)
    pos = F.filter(heads, lambda h: h.isin(*POS))
    return F.struct(F.size(F.filter(heads, lambda h: h.startswith("Etymology"))).alias("n_etymologies"), pos.alias("parts_of_speech"), found.alias("hieroglyphs"))


def scan_entries(blocks: DataFrame, most: int = 100) -> DataFrame:
    """(transliteration, definition, gardiner, page) of blocks (page, text), `most` of a block at most, as the printed work has it."""
    p = F.lit(r"\[([^\]]*)\]\s*([^\[\]{}]*)\{([^}]*)\}")
    blocks = blocks.select("page", *[F.regexp_extract_all("text", p, k).alias(n) for k, n in ((1, "t"), (2, "d"), (3, "g"))])
    all_ = F.arrays_zip("t", "d", "g")
    rows = blocks.select("page", F.posexplode(F.slice(all_, 1, most)).alias("ord", "x"))
    tidy = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    rows = rows.select(tidy(F.col("x.t")).alias("transliteration"), tidy(F.col("x.d")).alias("definition"), tidy(F.col("x.g")).alias("gardiner"), "page", "ord")
    return rows.where("transliteration <> '' and gardiner <> ''")
