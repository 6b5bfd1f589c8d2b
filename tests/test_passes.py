"""The older builder's passes, rule by rule, on pages written out here."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from glyphweave.operators import passes, wikitext as wt

FORMS = "====Alternative forms====\n{{{{egy-hieroforms|{}}}}}"


def page(language, etymologies, level=3):
    """etymologies: (text, [(part of speech, definition lines, sections below)])."""
    out = [f"=={language}=="]
    many = len(etymologies) > 1
    for n, (text, blocks) in enumerate(etymologies, 1):
        out.append(f"===Etymology {n}===" if many else "===Etymology===")
        out.append(text)
        eq = "=" * (4 if many else 3)
        for pos, lines, below in blocks:
            out += [f"{eq}{pos}{eq}", *[f"# {x}" for x in lines], *[b.replace("====", eq + "=") for b in below]]
    return "\n".join(out)


def one(language, text="", pos="Noun", lines=("m",), *below):
    return page(language, [(text, [(pos, lines, below)])])


CASES: dict[str, dict] = {}


def case(egy=(), dem=(), cop=(), whole=False):
    """Pages of one case. All cases are built together, so _ in a page stands for letters of the case's own, which are cut off again in what it gets."""

    def register(f):
        own = "".join(chr(ord("a") + int(d)) for d in f"{len(CASES):02d}") + "z"
        CASES[f.__name__] = {"own": own, "whole": whole, "pages": [(language, title.replace("_", own), text.replace("_", own)) for language, pages in (("Egyptian", egy), ("Demotic", dem), ("Coptic", cop)) for title, text in pages]}
        return f

    return register


@pytest.fixture(scope="module")
def built(spark):
    out = {}
    for whole in (False, True):
        pages = [p for c in CASES.values() if c["whole"] == whole for p in c["pages"]]
        rows = [(k, title, language, text) for k, (language, title, text) in enumerate(pages)]
        senses = wt.senses(wt.parse_pages(spark.createDataFrame(rows, "lemma_ord long, title string, language string, full_wikitext string")))
        code = F.create_map(*[F.lit(x) for x in ("Egyptian", "egy", "Demotic", "dem", "Coptic", "cop")])
        made = (passes.older_networks if whole else passes.build_passes)(senses.withColumn("language", code[F.col("language")]))
        out[whole] = (made.networks.collect(), made.nodes.collect(), made.edges.collect(), passes.numbered(made).collect())
    return out


@pytest.fixture
def got(built, request):
    """(networks, nodes, edges, numbers) of the case, with its letters cut off."""
    c = CASES[request.node.name]
    cut_off = lambda s: s.replace(c["own"], "") if s else s
    networks, nodes, edges, numbers = built[c["whole"]]
    label = lambda i: cut_off(i.split("\u001f")[0] + ":" + i.split("\u001f")[1] + ("~" + i.split("\u001f")[3] if i.split("\u001f")[3] else ""))
    mine = lambda i: c["own"] in i
    name = {r.id: cut_off(r.form) + (f"@{r.period}" if r.period else "") + (f"~{r.dialect}" if r.dialect else "") for r in nodes}
    of = lambda i: name.get(i, cut_off(i.split("\u001f")[1]))
    return SimpleNamespace(
        networks={of(r.root): r for r in networks if mine(r.network_id)},
        nodes=sorted((label(r.network_id), r.language, name[r.id], r.part_of_speech, cut_off("/".join(r.meanings)), r.etymology_index) for r in nodes if mine(r.network_id)),
        edges=[(label(r.network_id), of(r["from"]), of(r.to), r.type, cut_off(r.notes)) for r in sorted(edges, key=lambda r: r.moment) if mine(r.network_id)],
        snippets={of(r.to): cut_off(r.etymology_snippet) for r in edges if mine(r.network_id) and r.etymology_snippet},
        numbers=[(r.number, of(r.id)) for r in sorted(numbers, key=lambda r: r.number) if mine(r.id)],
    )


def hiero(*forms):
    """(glyphs, reading, date, note) of each."""
    parts = []
    for k, (glyphs, reading, date, *note) in enumerate(forms, 1):
        parts += [glyphs, f"read{k}={reading}", f"date{k}={date}"] + ([f"note{k}={note[0]}"] if note else [])
    return "====Alternative forms====\n{{egy-hieroforms|" + "|".join(parts) + "}}"


@case(egy=[("_w", one("Egyptian", "", "Noun", ["m"], hiero(("A", "_a", "Old Kingdom"), ("B", "_b", "Old Kingdom"), ("C", "_c", "New Kingdom"), ("D", "_c", "New Kingdom"), ("E", "_e", "18th Dynasty"), ("F", "_f", "who knows"))))])
def test_every_form_of_a_period_leads_to_the_first_of_the_next(got):
    assert ("egy:w", "w", "a@Old Kingdom", "DESCENDS", "First attestation in Old Kingdom") in got.edges
    assert [e[1:3] for e in got.edges if e[3] == "EVOLVES"] == [("a@Old Kingdom", "c@New Kingdom"), ("b@Old Kingdom", "c@New Kingdom")]
    variants = [e[1:] for e in got.edges if e[3] == "VARIANT"]
    # of one period: by glyphs within a spelling, by spelling from the most frequent; 18th Dynasty ranks with the New Kingdom
    assert ("a@Old Kingdom", "b@Old Kingdom", "VARIANT", "Spelling variant (Old Kingdom)") in variants
    assert ("c@New Kingdom", "c@New Kingdom", "VARIANT", "Hieroglyphic variant (New Kingdom)") in variants
    assert ("c@New Kingdom", "e@18th Dynasty", "VARIANT", "Spelling variant (18th Dynasty)") in variants and len(variants) == 3


@case(egy=[("_w", one("Egyptian", "", "Noun", ["m"], hiero(("A", "_ww", "Old Kingdom", "plural"), ("B", "_ww", "New Kingdom", "pl."), ("C", "_wj", "", "dual"), ("D", "_w", "New Kingdom"))))])
def test_inflected_forms_have_networks_of_their_own(got):
    assert {n[0] for n in got.nodes} == {"egy:w", "egy:ww~plural", "egy:wj~dual"}
    assert [e[1:4] for e in got.edges if e[0] == "egy:ww~plural"] == [("ww@Old Kingdom", "ww@New Kingdom", "EVOLVES")]
    assert [e[1:4] for e in got.edges if e[0] == "egy:w"] == [("w", "w@New Kingdom", "DESCENDS")]
    assert set(got.networks) == {"w", "ww@Old Kingdom", "wj"}


@case(egy=[("_x", one("Egyptian", "", "Verb", ["[L] Alternative form of _y."])), ("_y", one("Egyptian", "", "Verb", ["to y"])), ("_z", one("Egyptian", "", "Verb", ["[L] Alternative form of _y"]))])
def test_an_alternative_form_joins_the_network_it_names(got):
    # the network was made for a word to come: its first node stays the empty one
    assert got.nodes == [("egy:y", "egy", "x", "Verb", "[L] Alternative form of y.", 0), ("egy:y", "egy", "y", "Verb", "", None), ("egy:y", "egy", "z", "Verb", "[L] Alternative form of y", 0)]
    assert got.edges == [("egy:y", "y", "x", "VARIANT", "Alternative form of y"), ("egy:y", "y", "z", "VARIANT", "Alternative form of y")]


@case(egy=[("_x", one("Egyptian", "", "Verb", ["Alternative spelling of _y"])), ("_y", one("Egyptian", "", "Verb", ["to y"])), ("_z", one("Egyptian", "", "Verb", ["Alternative spelling of _y"]))])
def test_other_spellings_join_only_networks_that_are_there(got):
    assert {n[:3] for n in got.nodes} == {("egy:x", "egy", "x"), ("egy:y", "egy", "y"), ("egy:y", "egy", "z"), ("egy:z", "egy", "z")}
    assert got.edges == [("egy:y", "y", "z", "VARIANT", "Alternative form of y (from definition)")]


@case(egy=[("_w", one("Egyptian", "{{compound|egy|_k|_l}} {{affix|egy|_q|-t}} {{prefix|cop|_n|_o}}", "Noun", ["m"], hiero(("A", "_a", "New Kingdom"), ("B", "_b", "Old Kingdom")), "====Descendants====\n* {{desc|egx-dem|_d}}\n** {{desc|cop|_deep}}\n* {{desc|cop-boh|_c}}"))])
def test_descendants_hang_on_the_latest_form_and_components_name_their_kind(got):
    assert [e[1:] for e in got.edges if e[3] == "DESCENDS" and e[4] is None] == [("a@New Kingdom", "d", "DESCENDS", None), ("a@New Kingdom", "c", "DESCENDS", None)]
    assert {(n[1], n[2]) for n in got.nodes} >= {("dem", "d"), ("cop-boh", "c")} and not any(n[2] in ("deep", "n", "o") for n in got.nodes)
    assert {e[4] for e in got.edges if e[3] == "COMPONENT"} == {"compound component: k", "compound component: l", "base: q", "suffix: -t"}
    assert {n[2]: n[3] for n in got.nodes if n[3] in ("word", "morpheme")} == {"k": "word", "l": "word", "q": "morpheme", "-t": "morpheme"}
    assert got.networks["w"].has_demotic_descendant


@case(
    egy=[("_w", one("Egyptian", "{{compound|egy|_k|_l}}", "Noun", ["m"]))],
    dem=[("_d", one("Demotic", "{{inh|egx-dem|egy|_k|t=x}}", "Verb", ["to d"])), ("_e", page("Demotic", [("{{inh|egx-dem|egy|_new}}", [])])), ("_f", one("Demotic", "{{inh|egx-dem|egy|_new}}", "Noun", ["f"], "====Descendants====\n* {{desc|cop|_c}}")), ("_h", one("Demotic", "From {{m|egy|_k}}", "Noun", ["h"]))],
)
def test_a_demotic_word_reads_its_ancestor_where_it_stands_first(got):
    assert ("dem:d", "egy", "k", "word", "", None) in got.nodes  # the compound's part, as the first pass left it
    assert ("dem:e", "dem", "e", "unknown", "", 0) in got.nodes and ("dem:e", "egy", "new", "unknown", "", None) in got.nodes
    assert ("dem:f", "egy", "new", "unknown", "", None) in got.nodes  # as the lemma before made it, not as a noun
    assert ("dem:f", "cop", "c", "Noun", "", None) in got.nodes and ("dem:h", "egy", "k", "word", "", None) in got.nodes
    assert [e for e in got.edges if e[0] != "egy:w"] == [("dem:d", "k", "d", "DESCENDS", None), ("dem:e", "new", "e", "DESCENDS", None), ("dem:f", "new", "f", "DESCENDS", None), ("dem:f", "f", "c", "DESCENDS", None), ("dem:h", "k", "h", "DESCENDS", None)]
    assert "{{inh|egx-dem|egy|k" in got.snippets["d"]
    assert {r: n.has_demotic_descendant for r, n in got.networks.items()} == {"w": False, "d": True, "e": True, "f": True, "h": True}


@case(
    dem=[("_d", one("Demotic", "", "Noun", ["md"]))],
    cop=[("_p", one("Coptic", "{{der|cop|egy|_x}}{{der|cop|egx-dem|_d}}", "Noun", ["p"])), ("_q", one("Coptic", "{{bor|cop|grc|_g}}{{der|cop|egy|_x}}", "Noun", ["q"])), ("_r", one("Coptic", "{{bor|cop|grc|_g}}", "Verb", ["r"])), ("_s", one("Coptic", "cf. {{m|grc|_g}}", "Noun", ["s"])), ("_t", one("Coptic", "", "Noun", ["t"]))],
)
def test_a_coptic_word_prefers_demotic_then_egyptian_then_any_ancestor(got):
    assert {e[0]: e[1] for e in got.edges if e[3] == "DESCENDS"} == {"cop:p": "d", "cop:q": "x", "cop:r": "g", "cop:s": "g"}
    # the Demotic word is asked for without an etymology, so its own node isn't it
    assert ("cop:p", "dem", "d", "Noun", "", None) in got.nodes and ("cop:s", "grc", "g", "Verb", "", None) in got.nodes


@case(
    cop=[
        ("_a", one("Coptic", "{{alter|cop|_v|B}}", "Noun", ["ma"], "====Derived terms====\n{{l|cop|_t}}")),
        ("_b", one("Coptic", "{{der|cop|egy|_x}}", "Noun", ["[B] Alternative form of _t"])),
        ("_c", one("Coptic", "", "Noun", ["Alternative form of _nowhere"])),
        ("_e", one("Coptic", "", "Noun", ["Alternative spelling of _a"])),
    ]
)
def test_coptic_dialects_alternatives_and_derived_terms(got):
    assert ("cop:a", "a", "v~Bohairic", "VARIANT", None) in got.edges and ("cop:a", "a", "t", "DERIVED", "Derived from a") in got.edges
    assert ("cop:b", "t", "b", "VARIANT", "Alternative form of t") in got.edges and not any(e[1] == "x" for e in got.edges)
    assert ("cop:b", "cop", "t", "Noun", "", None) in got.nodes and ("cop:c", "cop", "nowhere", "Noun", "", None) in got.nodes
    # asked for with this etymology's index, the first lemma's own node is found
    assert ("cop:e", "cop", "a", "Noun", "ma", 0) in got.nodes and ("cop:e", "a", "e", "VARIANT", "Alternative form of a (from definition)") in got.edges


@case(
    egy=[("_w", one("Egyptian", "{{compound|egy|_k}}", "Noun", ["m"]))],
    cop=[
        ("_stem", one("Coptic", "", "Noun", ["ms"])),
        ("_a", one("Coptic", "{{der|cop|egx-dem|_d}}{{m|egy|_k}}{{affix|cop|ⲁ-|_stem}}", "Noun", ["ma"])),
        ("_b", one("Coptic", "{{der|cop|egy|_x}}{{suffix|cop|_ⲃ}}{{compound|cop|_ⲅ|_ⲇ}}", "Noun", ["mb"])),
        ("_c", one("Coptic", "{{suffix|cop|_ⲃ}}", "Noun", ["mc"])),
    ],
)
def test_coptic_components(got):
    of = lambda net: [e[1:] for e in got.edges if e[0] == net]
    assert ("k", "d", "COMPONENT", "Egyptian component of Demotic compound") in of("cop:a")
    assert not any("stem" in e[:2] for e in of("cop:a"))  # plain Latin parts are none of a Coptic word's
    assert [e for e in of("cop:b") if e[2] != "DESCENDS" or e[3]] == [("ⲃ", "b", "DERIVED", "Affixed with suffix"), ("x", "ⲃ", "DESCENDS", "Coptic base word from Egyptian"), ("ⲅ", "b", "COMPONENT", "Component of compound"), ("ⲇ", "b", "COMPONENT", "Component of compound")]
    assert of("cop:c") == [("ⲃ", "c", "DERIVED", "Affixed with suffix")]


@case(cop=[("_ⲥ", page("Coptic", [("", [("Noun", ["first"], [])]), ("", [("Verb", ["second"], [])])])), ("_ⲧ", one("Coptic", "{{der|cop|egx-dem|_d}}{{prefix|cop|ⲣ-|_ⲥ}}", "Noun", ["mt"]))])
def test_a_base_is_looked_for_by_form_alone(got):
    assert ("cop:ⲧ", "cop", "ⲥ", "Noun", "first", 0) in got.nodes
    assert [e[1:] for e in got.edges if e[0] == "cop:ⲧ"] == [("d", "ⲧ", "DESCENDS", None), ("ⲥ", "ⲧ", "DERIVED", "Affixed with prefix"), ("d", "ⲥ", "DESCENDS", "Coptic base word from Demotic")]


@case(
    whole=True,
    cop=[
        ("_a", one("Coptic", "", "Noun", ["ma"], "====Derived terms====\n{{l|cop|_ⲃ}}")),
        ("_ⲃ", one("Coptic", "", "Noun", ["mb"], "====Derived terms====\n{{l|cop|_ⲅ}}")),
        ("_c", one("Coptic", "", "Noun", ["Alternative form of _ⲃ"])),
        ("_e", one("Coptic", "", "Noun", ["Alternative form of _ⲅ"], "====Derived terms====\n{{l|cop|_f}}")),
        ("_g", one("Coptic", "", "Noun", ["Alternative form of _f"])),
    ],
)
def test_alternative_networks_merge_through_chains(got):
    assert {n[0] for n in got.nodes} == {"cop:a", "cop:ⲃ"} and set(got.networks) == {"a", "ⲃ"}
    assert {n[2] for n in got.nodes if n[0] == "cop:a"} == {"a", "ⲃ", "c"} and {n[2] for n in got.nodes if n[0] == "cop:ⲃ"} == {"ⲃ", "ⲅ", "e", "f", "g"}


@case(whole=True, cop=[("_x", one("Coptic", "", "Noun", ["Alternative form of _y"], "====Derived terms====\n{{l|cop|_x}}")), ("_y", one("Coptic", "", "Noun", ["Alternative form of _x"], "====Derived terms====\n{{l|cop|_y}}"))])
def test_a_ring_of_alternatives_ends_at_the_first(got):
    assert {n[0] for n in got.nodes} == {"cop:x"} and set(got.networks) == {"x"}
    assert {(e[1], e[2]) for e in got.edges if e[3] == "VARIANT"} == {("y", "x"), ("x", "y")}


@case(whole=True, egy=[("_w", one("Egyptian", "", "Noun", ["m"], "====Descendants====\n* {{desc|egx-dem|_d}}\n* {{desc|cop|_c}}\n* {{desc|cop|_c}}"))])
def test_a_demotic_word_without_meanings_takes_no_edges(got):
    assert [e[1:3] for e in got.edges] == [("w", "d"), ("w", "c"), ("w", "c")]


def test_egyptian_to_coptic_edges_go_through_demotic(spark):
    nodes = spark.createDataFrame([("n", i, lang, [m] if m else [], {"x": k}) for k, (i, lang, m) in enumerate([("e", "egy", "m"), ("d", "dem", "md"), ("d2", "dem", "md"), ("c", "cop", ""), ("b", "cop-boh", "")])], "network_id string, id string, language string, meanings array<string>, moment struct<x:int>")
    rows = [("e", "d"), ("e", "c"), ("e", "c"), ("e", "b"), ("d", "b"), ("e", "d2")]
    made = spark.createDataFrame([("n", {"x": k}, a, b, "DESCENDS", None, None, None, None, False) for k, (a, b) in enumerate(rows)], "network_id string, moment struct<x:int>, from string, to string, type string, notes string, target_language string, etymology_snippet string, dialect string, late boolean")
    moved = [(r["from"], r.to) for r in sorted(passes.reroute(nodes, made).collect(), key=lambda r: r.moment)]
    assert moved == [("e", "d"), ("d", "c"), ("d", "b"), ("e", "d2")]


@case(egy=[("_w", one("Egyptian", "{{compound|egy|_k}}", "Noun", ["m"], hiero(("A", "_ww", "Old Kingdom", "plural"), ("B", "_b", "New Kingdom"))))], dem=[("_d", one("Demotic", "{{inh|egx-dem|egy|_k}}", "Noun", ["md"]))])
def test_numbers_follow_the_order_of_speaking(got):
    assert [name for _, name in got.numbers] == ["w", "ww@Old Kingdom", "b@New Kingdom", "k", "ww", "d"]
    assert all(n[0] == "L" and len(n) == 6 for n, _ in got.numbers)


def test_no_pages(spark):
    parsed = wt.parse_pages(spark.createDataFrame([(1, "x", "Coptic", "==Latin==\nnothing")], "lemma_ord long, title string, language string, full_wikitext string"))
    made = passes.build_passes(wt.senses(parsed).withColumn("language", F.lit("cop")))
    assert made.networks.count() == made.nodes.count() == made.edges.count() == 0


@pytest.mark.parametrize(("label", "name", "rank"), [("Pyramid Texts", "Pyramid Texts", 1), ("19th Dynasty", "19th Dynasty", 6), ("6th Dynasty", "6th Dynasty", 2), ("Predynastic", "Predynastic", 500), ("3rd dynasty", "3rd dynasty", 2), ("", None, 999), (None, None, 999), ("32nd Dynasty", "32th Dynasty", 9)])
def test_older_periods(spark, label, name, rank):
    from glyphweave.functions import lexical as lx

    row = spark.createDataFrame([(label,)], "x string").select(lx.period(F.col("x"), older=True).alias("p"), lx.period_rank(lx.period(F.col("x"), older=True), older=True).alias("r")).first()
    assert (row.p, row.r) == (name, rank)
