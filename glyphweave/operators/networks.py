"""Etymology networks from dictionary senses: G5-G11, G16, J6-J11, J15, F3-F7.

One network per (lemma, etymology). Producers give candidate nodes and edges with an ordinal; where a network holds a
form of a language once only, candidates are settled by their first, and edges are mapped to it by a join. Node keys are
natural (network, kind, place), so that nothing is numbered centrally; sequential ids are for export only.

senses: language (egy, dem, cop), lemma_ord, lemma, etym_idx, def_idx, part_of_speech, parameters, meanings, alternative_forms,
descendants, derived_terms, components, ancestors, etymology_text, as operators.wikitext.senses() has them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphweave.functions import lexical as lx
from glyphweave.operators import chronology as ch, graph as g
from glyphweave.session import cut
from glyphweave.sources import ingest

NODE = ("network_id", "node_ord", "id", "language", "form", "transliteration", "hieroglyphs", "part_of_speech", "meanings", "period", "rank", "dialects", "etymology_index", "definition_index")
EDGE = ("network_id", "edge_ord", "from", "to", "type", "notes")
FAMILY = {"egy": ("egy", "egx-dem", "dem"), "dem": ("egy", "egx-dem", "dem"), "cop": ("egy", "egx-dem", "dem", "cop")}
#: Order of producers: earlier ones win where a form is settled.
MAIN, ALT, DESC, DERIVED, COMPONENT, ANCESTOR, ATTACHED, DIALECT = range(8)

_text = lambda v=None: F.lit(v).cast("string")
_none = lambda: F.array().cast("array<string>")


def _key(*parts) -> Column:
    return F.concat_ws("/", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def _place(producer: int, *at) -> Column:
    """An ordinal that sorts producers, then up to three places: a struct, so that no place has to fit a number of digits."""
    at = [*at, *[F.lit(0)] * (3 - len(at))]
    return F.struct(F.lit(producer).alias("producer"), *[c.cast("long").alias(k) for k, c in zip(("a", "b", "c"), at, strict=True)])


def _attached() -> Column:
    return _place(ATTACHED, F.col("lemma_ord"), F.col("etym_idx"), F.col("def_idx"))


def _node(ord_: Column, id_: Column, language: Column, form: Column, **more: Column) -> list[Column]:
    base = {"transliteration": form, "hieroglyphs": _text(), "part_of_speech": F.lit("unknown"), "meanings": _none(), "period": _text(), "rank": F.lit(999), "dialects": _none(), "etymology_index": F.lit(None).cast("int"), "definition_index": F.lit(None).cast("int")} | more
    return [F.col("network_id"), ord_.alias("node_ord"), id_.alias("id"), language.alias("language"), form.alias("form"), *[c.alias(k) for k, c in base.items()]]


def _edge(ord_: Column, a: Column, b: Column, kind: Column | str, notes: Column | str = "") -> list[Column]:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [F.col("network_id"), ord_.alias("edge_ord"), a.alias("from"), b.alias("to"), lit(kind).alias("type"), lit(notes).alias("notes")]


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _rows(senses: DataFrame, language: str) -> DataFrame:
    rows = senses.where((F.col("language") == language) & ~lx.is_alternative(F.col("meanings"))).where("def_idx is not null")
    net = _key(language, F.col("lemma_ord"), F.col("etym_idx"))
    return rows.withColumns({"network_id": net, "main": _key(net, "m", F.col("def_idx")), "lang": F.col("language")})


def _mains(rows: DataFrame) -> DataFrame:
    head = lx.head_hieroglyphs(F.col("parameters"))
    return rows.select(*_node(_place(MAIN, F.col("def_idx")), F.col("main"), F.col("lang"), F.col("lemma"), hieroglyphs=head, part_of_speech=F.coalesce(F.col("part_of_speech"), F.lit("unknown")), meanings=F.coalesce(F.col("meanings"), _none()), etymology_index=F.col("etym_idx"), definition_index=F.col("def_idx")))


def _forms(rows: DataFrame) -> DataFrame:
    """Alternative forms with type, period and rank, in source order."""
    each = rows.select("network_id", "main", "lang", "lemma", "part_of_speech", "etym_idx", "def_idx", F.posexplode("alternative_forms").alias("i", "a"))
    period = lx.period(F.col("a.date"))
    return each.select("network_id", "main", "lang", "part_of_speech", "etym_idx", "def_idx", F.col("i").alias("ord"), _key(F.col("network_id"), "a", F.col("def_idx"), F.col("i")).alias("node"), lx.form_type(F.col("a.title"), F.col("a.note")).alias("type"), lx.period_rank(F.col("a.date")).alias("rank"), period.alias("period"), F.coalesce("a.transliteration", "a.form", "lemma").alias("form"), F.col("a.hieroglyphs").alias("hieroglyphs"))


def _descendants(rows: DataFrame, latest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Demotic and Coptic words at any depth; other languages as leaves with one level below; edges from the tree's parent, or the latest base form."""
    flat = rows.select("network_id", "def_idx", F.inline("descendants")).withColumn("language", lx.descendant_language(F.col("language")))
    near = flat.select("network_id", "def_idx", F.col("ord").alias("parent_ord"), F.col("language").alias("p_lang"), F.col("word").alias("p_word"), F.col("parent_ord").alias("g_ord"))
    full = flat.join(near, ["network_id", "def_idx", "parent_ord"], "left")
    grand = flat.select("network_id", "def_idx", F.col("ord").alias("g_ord"), F.col("language").alias("g_lang"))
    full = full.join(grand, ["network_id", "def_idx", "g_ord"], "left")
    inside = lambda c: F.col(c).isin("dem", "cop")
    full = full.where(F.col("p_lang").isNull() | inside("p_lang") | F.col("g_lang").isNull() | inside("g_lang"))
    key = lambda lang, word: _key(F.col("network_id"), "d", lang, word)
    at = _place(DESC, F.col("def_idx"), F.col("ord"))
    nodes = full.select(*_node(at, key(F.col("language"), F.col("word")), F.col("language"), F.col("word")))
    edges = full.join(latest, ["network_id", "def_idx"]).select(*_edge(at, F.when(F.col("p_word").isNull(), F.col("latest")).otherwise(key(F.col("p_lang"), F.col("p_word"))), key(F.col("language"), F.col("word")), "DESCENDS"))
    return nodes, edges


def _derived(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G7, F5."""
    each = rows.select("network_id", "main", "lang", "lemma", "def_idx", F.posexplode("derived_terms").alias("i", "term")).where("term <> '' and term <> lemma")
    at, key = _place(DERIVED, F.col("def_idx"), F.col("i")), _key(F.col("network_id"), "d", F.col("lang"), F.col("term"))
    return each.select(*_node(at, key, F.col("lang"), F.col("term"))), each.select(*_edge(at, F.col("main"), key, "DERIVED", "derived term"))


def _components(rows: DataFrame, firsts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A component is copied from the first network of an earlier lemma of that form, else a bare node."""
    first_main = rows.groupBy("network_id", "lemma_ord", "lemma", "lang", "etym_idx").agg(F.min_by("main", "def_idx").alias("main"), F.min_by("components", "def_idx").alias("components"))
    each = first_main.select("*", F.posexplode("components").alias("i", "c")).where("c.form <> '' and c.form <> lemma")
    each = each.withColumn("form", F.col("c.form"))
    known = firsts.select(F.col("lemma").alias("form"), F.col("lemma_ord").alias("k_ord"), F.col("part_of_speech").alias("k_pos"), F.col("meanings").alias("k_meanings"), F.col("hieroglyphs").alias("k_hiero"))
    each = each.join(known, "form", "left").withColumn("ok", F.coalesce(F.col("k_ord") < F.col("lemma_ord"), F.lit(False)))
    best = lambda c: F.when(F.col("ok"), F.col(c))
    at, key = _place(COMPONENT, F.lit(0), F.col("i")), _key(F.col("network_id"), "d", F.col("lang"), F.col("form"))
    nodes = each.select(*_node(at, key, F.col("lang"), F.col("form"), part_of_speech=F.coalesce(best("k_pos"), F.lit("unknown")), meanings=F.coalesce(best("k_meanings"), _none()), hieroglyphs=best("k_hiero")))
    return nodes, each.select(*_edge(at, key, F.col("main"), "COMPONENT", F.col("c.role")))


def _ancestors(rows: DataFrame, language: str) -> tuple[DataFrame, DataFrame]:
    """G9, F6."""
    first_main = rows.groupBy("network_id", "lang").agg(F.min_by("main", "def_idx").alias("main"), F.min_by("ancestors", "def_idx").alias("ancestors"))
    each = first_main.select("*", F.posexplode("ancestors").alias("i", "a")).where(~F.col("a.language").isin(*FAMILY[language]) & (F.col("a.form") != ""))
    at, key = _place(ANCESTOR, F.lit(0), F.col("i")), _key(F.col("network_id"), "d", F.col("a.language"), F.col("a.form"))
    kind = F.when(F.col("a.type") == "bor", "BORROWED").when(F.col("a.type") == "inh", "INHERITED").otherwise("DERIVED")
    return each.select(*_node(at, key, F.col("a.language"), F.col("a.form"))), each.select(*_edge(at, key, F.col("main"), kind))


def settle(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One node for each (network, language, form) but alternative and main forms, which stay apart; empty fields filled from
    later candidates; first edge of each pair; no self loops."""
    settled = cut(settled_nodes(nodes))
    return settled.select(*NODE), settled_edges(settled, edges).select(*EDGE)


def settled_nodes(nodes: DataFrame) -> DataFrame:
    """The nodes of settle(), each with the ids that turn into it (olds): its own, and that of what has its form; natural ids, so two at most.

    A network's rows of one language and form are dealt together once, and both steps run there.
    """
    own = F.col("id").rlike("/(m|a)/")
    key = ["network_id", "language", "form"]
    # a descendant, derived term or component that the network has as a main form is that form
    main = F.min(F.when(F.col("id").contains("/m/"), F.struct("node_ord", "id"))).over(Window.partitionBy(*key))
    named = nodes.withColumn("main_id", main["id"])
    named = named.withColumn("group", F.when(own, F.col("id")).otherwise(F.coalesce("main_id", F.concat_ws("\u0001", "language", "form"))))
    fill = lambda c, empty: F.coalesce(F.min_by(F.when(~empty, F.col(c)), F.when(~empty, F.col("node_ord"))), F.min_by(c, "node_ord")).alias(c)
    blank = {"meanings": F.size("meanings") == 0, "part_of_speech": F.col("part_of_speech") == "unknown"}
    plain = ("id", "node_ord", "transliteration", "rank")
    agg = [F.min_by(c, "node_ord").alias("first_ord" if c == "node_ord" else c) for c in plain]
    agg += [fill(c, blank.get(c, F.col(c).isNull())) for c in ("hieroglyphs", "part_of_speech", "meanings", "period", "etymology_index", "definition_index")]
    settled = named.groupBy(*key, "group").agg(*agg, F.array_sort(F.array_distinct(F.flatten(F.collect_set("dialects")))).alias("dialects"), F.collect_set("id").alias("olds"))
    return settled.withColumnRenamed("first_ord", "node_ord").select(*NODE, "olds")


def settled_edges(settled: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges of settle(), with the languages of both ends as from_language and to_language; settled: as settled_nodes() has them, cut."""
    ids = settled.select("network_id", F.explode("olds").alias("old"), F.col("id").alias("new"), "language")
    moved = edges
    for end in ("from", "to"):
        side = ids.select("network_id", F.col("old").alias(end), F.col("new").alias(f"new_{end}"), F.col("language").alias(f"{end}_language"))
        moved = moved.join(side.hint("merge"), ["network_id", end]).drop(end).withColumnRenamed(f"new_{end}", end)
    moved = moved.where(F.col("from") != F.col("to"))
    return g.distinct_edges(moved, "network_id", "from", "to").select(*EDGE, "from_language", "to_language")


def _own(senses: DataFrame, language: str, firsts: DataFrame | None) -> tuple[list[DataFrame], list[DataFrame]]:
    """Producers of the networks of one language's lemmas: G5 for Egyptian, G11 for the others."""
    rows = cut(_rows(senses, language))
    nodes, edges = [_mains(rows)], []
    mains = rows.select("network_id", F.col("def_idx").alias("ord"), F.col("main").alias("node"))
    forms = cut(_forms(rows)) if language == "egy" else None
    if forms is not None:
        nodes.append(forms.select(*_node(_place(ALT, F.col("def_idx"), F.col("ord")), F.col("node"), F.col("lang"), F.col("form"), hieroglyphs=F.col("hieroglyphs"), part_of_speech=F.coalesce("part_of_speech", F.lit("unknown")), period=F.col("period"), rank=F.col("rank"), etymology_index=F.col("etym_idx"), definition_index=F.col("def_idx"))))
        chain = ch.evolution_edges(forms, "network_id", "def_idx")
        place = lambda end: forms.select("network_id", "def_idx", F.col("node").alias(end), F.col("ord").alias(f"{end}_ord"))
        chain = chain.join(place("to"), ["network_id", "def_idx", "to"]).join(place("from"), ["network_id", "def_idx", "from"], "left")
        edges.append(chain.select(*_edge(_place(ALT, F.col("def_idx"), F.col("to_ord"), F.coalesce(F.col("from_ord") + 1, F.lit(0))), F.col("from"), F.col("to"), F.col("type"), F.col("notes"))))
        latest = rows.select("network_id", "def_idx", "main").join(ch.latest_base(forms, "network_id", "def_idx"), ["network_id", "def_idx"], "left").select("network_id", "def_idx", F.coalesce("latest", "main").alias("latest"))
        for ns, es in (_descendants(rows, latest), _derived(rows)):
            nodes.append(ns)
            edges.append(es)
    if language == "cop":
        each = rows.select("network_id", "main", "lang", "def_idx", F.posexplode("alternative_forms").alias("i", "a")).where("a.form <> ''")
        at, key = _place(DIALECT, F.col("def_idx"), F.col("i")), _key(F.col("network_id"), "d", F.col("lang"), F.col("a.form"))
        nodes.append(each.select(*_node(at, key, F.col("lang"), F.col("a.form"), dialects=F.array_compact(F.array("a.dialect")))))
        edges.append(each.select(*_edge(at, F.col("main"), key, "VARIANT", F.coalesce("a.dialect", F.lit("")))))
        # What is derived from an alternative form's own entry
        entries = rows.select(F.col("lemma").alias("f"), F.explode("derived_terms").alias("term")).distinct()
        own = each.join(entries, F.col("a.form") == F.col("f")).where(F.col("term") != "")
        key2 = _key(F.col("network_id"), "d", F.col("lang"), F.col("term"))
        nodes.append(own.select(*_node(at, key2, F.col("lang"), F.col("term"))))
        edges.append(own.select(*_edge(at, key, key2, "DERIVED", "derived term")))
    if language != "dem":
        pairs = [_ancestors(rows, language)] + ([_components(rows, firsts)] if firsts is not None else [])
        for ns, es in pairs:
            nodes.append(ns)
            edges.append(es)
        adjacent = ch.adjacent_variants(mains, "network_id")
        edges.append(adjacent.select(*_edge(_place(MAIN), F.col("from"), F.col("to"), F.col("type"), F.col("notes"))))
    return nodes, edges


def _words(c: str) -> Column:
    """The distinct lower-case words of meanings, none for none."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.array_join(c, " ")), r"(?U)\s+")), "")


def best_match(candidates: DataFrame, *by: str) -> DataFrame:
    """The best candidate for each entry (by): (by, parent, overlap, part_of_speech, meanings).

    The first with the entry's part of speech; else the first of those that share the most words of their meanings, if any do; else the one of
    the lowest definition index, a missing one counting as 0. candidates: part_of_speech, meanings, c_id, c_ord, c_pos, c_meanings, c_def.
    """
    rows = candidates.withColumn("overlap", F.when((F.size("meanings") > 0) & (F.size("c_meanings") > 0), F.size(F.array_intersect(_words("meanings"), _words("c_meanings")))).otherwise(0))
    other = F.coalesce("part_of_speech", F.lit("unknown")) != F.col("c_pos")
    order = F.struct(other.alias("a"), F.when(other, -F.col("overlap")).otherwise(0).alias("b"), F.when(other & (F.col("overlap") == 0), F.coalesce("c_def", F.lit(0))).otherwise(0).alias("c"), F.col("c_ord").alias("d"))
    return rows.groupBy(*by).agg(F.min_by("c_id", order).alias("parent"), F.min_by("overlap", order).alias("overlap"), F.first("part_of_speech").alias("part_of_speech"), F.first("meanings").alias("meanings"))


def best_matches(entries: DataFrame, candidates: DataFrame, *on: str) -> DataFrame:
    """best_match() of all entries with the candidates of their key (on), where a key may have many of both: entries with parent and overlap; those without a candidate are left out.

    No pairs of a key are made. Each of the three ways has its own join: the first candidate of a key and part of speech; those that share words, by postings of words
    over the distinct sets of words on both sides; the first of the lowest definition index of a key.
    """
    words = lambda c: F.array_sort(F.coalesce(_words(c), F.array().cast("array<string>")))
    asked = entries.withColumns({"__pos": F.coalesce("part_of_speech", F.lit("unknown")), "__words": words("meanings")})
    held = candidates.select(*on, "c_pos", words("c_meanings").alias("c_words"), F.coalesce("c_def", F.lit(0)).alias("c_def"), "c_ord", "c_id")
    held = cut(held.groupBy(*on, "c_pos", "c_words", "c_def").agg(F.min_by("c_id", "c_ord").alias("c_id"), F.min("c_ord").alias("c_ord")))
    found = lambda *at: F.min_by(F.struct("c_id", "c_words"), F.struct(*at, "c_ord"))
    nameless = F.min_by(F.when(F.col("c_pos").isNull(), F.struct("c_id", "c_words")), F.when(F.col("c_pos").isNull(), F.col("c_ord")))  # counts as each part of speech
    lowest = held.groupBy(*on).agg(nameless.alias("any"), found("c_def").alias("low"))
    same = held.where("c_pos is not null").groupBy(*on, F.col("c_pos").alias("__pos")).agg(found().alias("same"))
    kinds = cut(asked.select(*on, "__pos", "__words").distinct().join(lowest, list(on)).join(same, [*on, "__pos"], "left"))
    left = kinds.where("any is null and same is null").select(*on, "__words").distinct().select("*", F.explode("__words").alias("word"))
    posted = held.groupBy(*on, "c_words").agg(F.min_by("c_id", "c_ord").alias("c_id"), F.min("c_ord").alias("c_ord")).select("*", F.explode("c_words").alias("word"))
    shared = left.join(posted, [*on, "word"]).groupBy(*on, "__words", "c_words").agg(F.count("*").alias("n"), F.first("c_id").alias("c_id"), F.first("c_ord").alias("c_ord"))
    shared = shared.groupBy(*on, "__words").agg(found(-F.col("n")).alias("most"))
    best = kinds.join(shared, [*on, "__words"], "left").withColumn("best", F.coalesce("any", "same", "most", "low"))
    best = best.select(*on, "__pos", "__words", F.col("best.c_id").alias("parent"), F.size(F.array_intersect("__words", "best.c_words")).alias("overlap"))
    return asked.join(best, [*on, "__pos", "__words"]).select(*entries.columns, "parent", "overlap")


def _attach(senses: DataFrame, languages: tuple[str, ...], nodes: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lemmas with an Egyptian ancestor join the network of its first etymology, below its best matching node."""
    rows = _all([_rows(senses, x).drop("network_id").withColumn("root", lx.ancestor(F.col("etymology_text"), x)).where("root is not null") for x in languages])
    rows = rows.select("lang", "lemma", "lemma_ord", "etym_idx", "def_idx", "part_of_speech", "meanings", "root")
    target = rows.join(roots, "root")
    candidates = nodes.where("language = 'egy'").select("network_id", F.col("form").alias("root"), F.col("id").alias("c_id"), F.col("node_ord").alias("c_ord"), F.col("part_of_speech").alias("c_pos"), F.col("meanings").alias("c_meanings"), F.col("definition_index").alias("c_def"))
    scored = target.join(candidates, ["network_id", "root"])
    best = cut(best_match(scored, "network_id", "lang", "lemma", "lemma_ord", "etym_idx", "def_idx"))
    at = _attached()
    key = _key(F.col("network_id"), "d", F.col("lang"), F.col("lemma"))
    out = best.select(*_node(at, key, F.col("lang"), F.col("lemma"), part_of_speech=F.coalesce("part_of_speech", F.lit("unknown")), meanings=F.coalesce("meanings", _none()), etymology_index=F.col("etym_idx")))
    return out, best.select(*_edge(at, F.col("parent"), key, "DESCENDS", "attested"))


def _candidates(senses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All producers' nodes and edges; senses are cut."""
    egy = _rows(senses, "egy")
    firsts = egy.groupBy("lemma").agg(F.min_by(F.struct("lemma_ord", "part_of_speech", "meanings", lx.head_hieroglyphs(F.col("parameters")).alias("hieroglyphs")), F.struct("lemma_ord", "etym_idx", "def_idx")).alias("x")).select("lemma", "x.*")
    roots = egy.groupBy(F.col("lemma").alias("root")).agg(F.min_by("network_id", F.struct("lemma_ord", "etym_idx")).alias("network_id"))
    ns, es = _own(senses, "egy", firsts)
    nodes, edges = _all(ns), _all(es)
    base = cut(nodes)
    more_nodes, more_edges = _attach(senses, ("dem", "cop"), base, roots)
    nodes, edges = _all([base, more_nodes]), _all([edges, more_edges])
    for language in ("dem", "cop"):
        alone = senses.where((F.col("language") == language) & lx.ancestor(F.col("etymology_text"), language).isNull())
        ns, es = _own(alone, language, firsts if language == "cop" else None)
        nodes, edges = _all([nodes, *ns]), _all([edges, *es])
    return nodes, edges


def network_nodes(senses: DataFrame) -> DataFrame:
    """The nodes of build_networks() alone: no edge is made."""
    return cut(settled_nodes(_candidates(cut(senses))[0])).select(*NODE)


def build_networks(senses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(networks, nodes, edges): Egyptian networks, Demotic and Coptic lemmas attached, the others' own networks, descent cleaned up.

    Lemmas whose ancestor has no network are in none; orphans() lists them.
    """
    senses = cut(senses)
    nodes, edges = _candidates(senses)
    settled = cut(settled_nodes(nodes))
    nodes = settled.select(*NODE)
    edges = cut(g.cleaned_descent(nodes, cut(settled_edges(settled, edges))).select(*EDGE))
    heads = senses.select(_key(F.col("language"), F.col("lemma_ord"), F.col("etym_idx")).alias("network_id"), F.col("lemma").alias("root_lemma"), F.col("language").alias("root_language"), F.col("etym_idx").alias("root_etymology_index"), "lemma_ord").distinct()
    networks = heads.join(nodes.select("network_id").distinct(), "network_id", "left_semi")
    return networks, nodes, edges


def parsed_entries(nodes: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Nodes, each with the parsed lemma (language, lemma, ...) of its form in its language's family, as the struct entry; null without one.

    All Coptic dialects are one family; of lemmas with one name the last counts. Languages outside the three families have no entries.
    """
    family = lambda c: F.when(F.col(c).startswith("cop"), "cop").when(F.col(c).isin("egy", "dem"), F.col(c))
    rest = [c for c in lemmas.columns if c not in ("language", "lemma")]
    last = lemmas.groupBy(family("language").alias("__family"), F.col("lemma").alias("__form")).agg(F.max_by(F.struct("language", "lemma", *rest), "lemma_ord").alias("entry"))
    return nodes.join(last, (family("language") == F.col("__family")) & (F.col("form") == F.col("__form")), "left").drop("__family", "__form")


def found_elsewhere(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ids (id), each with the first node of that id in any network (found: network_id and the node's columns); null if no network has it."""
    first = nodes.groupBy("id").agg(F.min_by(F.struct(*[c for c in nodes.columns if c != "id"]), F.struct("network_id", "node_ord")).alias("found"))
    return ids.join(first, "id", "left")


def union(*parts: DataFrame) -> DataFrame:
    """Networks, nodes or edges of several builders as one table."""
    return _all(list(parts))


def orphans(senses: DataFrame) -> DataFrame:
    """Demotic and Coptic lemmas whose Egyptian ancestor has no network."""
    roots = F.coalesce(*[F.when(F.col("language") == x, lx.ancestor(F.col("etymology_text"), x)) for x in ("dem", "cop")])
    rows = cut(senses.where("language in ('egy', 'dem', 'cop')").select("language", "lemma", roots.alias("root")))  # senses run once, and three narrow columns are kept
    known = rows.where("language = 'egy'").select(F.col("lemma").alias("root")).distinct()
    return rows.where("language <> 'egy' and root is not null").join(known, "root", "left_anti").select("language", "lemma", "root").distinct()


def _numbered(networks: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Networks with export_id (NET00001), nodes with export_node (N00001) and edges between these, all still by network_id.

    Nodes follow their networks, so a network's first number is the count of the nodes before it, and only the counts of networks are put in order.
    """
    nets = g.sequential_ids(networks, "NET", "root_language", "lemma_ord", "root_etymology_index", column="export_id")
    counts = cut(nodes.groupBy("network_id").agg(F.count("*").alias("n")).repartitionByRange("network_id").withColumn("__part", F.spark_partition_id()))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    base = counts.groupBy("__part").agg(F.sum("n").alias("n"))
    base = base.select("__part", F.coalesce(F.sum("n").over(before.orderBy("__part")), F.lit(0)).alias("__base"))
    first = counts.withColumn("__n", F.coalesce(F.sum("n").over(before.partitionBy("__part").orderBy("network_id")), F.lit(0))).join(F.broadcast(base), "__part")  # a row for each range
    first = cut(first.select("network_id", (F.col("__base") + F.col("__n")).alias("__first")))
    place = F.row_number().over(Window.partitionBy("network_id").orderBy("node_ord", "id"))
    named = lambda df: df.join(first.hint("merge"), "network_id").withColumn("export_node", F.format_string("N%05d", F.col("__first") + place)).drop("__first")
    ids = cut(named(nodes.select("network_id", "node_ord", "id")).drop("node_ord"))
    ends = edges
    for end in ("from", "to"):
        ends = ends.join(ids.select("network_id", F.col("id").alias(end), F.col("export_node").alias(f"x_{end}")).hint("merge"), ["network_id", end]).drop(end).withColumnRenamed(f"x_{end}", end)
    return nets, named(nodes), ends.select(*EDGE)


def export_ids(networks: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Networks and nodes numbered NET00001 and N00001 in order, edges mapped."""
    nets, nodes, edges = _numbered(networks, nodes, edges)
    name = nets.select("network_id", "export_id")
    pick = [F.col("export_id").alias("network_id") if c == "network_id" else F.col("export_node").alias("id") if c == "id" else F.col(c) for c in NODE]
    out_edges = edges.join(name, "network_id").select(F.col("export_id").alias("network_id"), *EDGE[1:])
    return nets.select(F.col("export_id").alias("network_id"), "root_lemma", "root_language", "root_etymology_index"), nodes.join(name, "network_id").select(*pick), out_edges


def nested_export(networks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """export_ids() as one row per network. Nodes and edges are gathered by the networks' own ids, by which they are numbered; the exported id comes last."""
    nets, nodes, edges = _numbered(networks, nodes, edges)
    pick = [F.col("export_node").alias("id") if c == "id" else F.col(c) for c in NODE]
    nested = ingest.nested_networks(nets.select("network_id", "export_id", "root_lemma", "root_language", "root_etymology_index"), nodes.select(*pick), edges)
    return nested.drop("network_id").withColumnRenamed("export_id", "network_id")


def merged_networks(nodes: DataFrame, edges: DataFrame, networks: DataFrame, stop: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The older view, in which networks that share a form are one: Egyptian to Coptic edges rerouted, then merged."""
    single = nodes.withColumn("dialect", F.get("dialects", F.lit(0)))
    rerouted = g.reroute_descent(single, edges)
    return g.merge_networks(single, rerouted, networks.select("network_id", "root_etymology_index"), stop)


