import random

import pytest
from pyspark.sql import functions as F

from glyphweave.operators import chronology as ch, graph as g, lexicon as lex, networks, trees, wikitext as w
from glyphweave.operators.components import connected_components
from glyphweave.sources import ingest

CORPUS = "sent_ord long, " + ingest.CORPUS


def corpus(spark, rows):
    return spark.createDataFrame([(i, *r, *[None] * (8 - len(r))) for i, r in enumerate(rows)], CORPUS)


def test_lexicon(spark):  # A1, J1, F1
    a = ("𓀀 𓄿", "a.b q", "NOUN VERB", "7|x nolemma", "g1 g0")
    b = ("𓄿", "a", "NOUN", "7|x", "g2")
    rows = lex.build_lexicon(corpus(spark, [a, b])).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.lemma_id, r.lemma, r.gloss, len(r.glyph_variants), len(r.examples)) == ("7", "a", "g2", 2, 2)
    assert r.glyph_variants[0].gardiner == ["A1"] and r.glyph_variants[0].suffixes == [".b"]
    r = lex.build_lexicon(corpus(spark, [a, b, a])).first()
    assert (r.lemma, len(r.glyph_variants), len(r.examples)) == ("a.b", 2, 3)
    assert lex.build_lexicon(corpus(spark, [("x", "y z", "N", "1|a 2|b")])).where("lemma_id = '2'").first().glyph_variants[0].glyph == ""


def test_matching(spark):  # J2-J5
    v = spark.createDataFrame([("𓀀", 1, 0, "L1", "ab"), ("𓀀", 0, 1, "L0", "zz"), ("𓄿", 2, 0, "L2", "cd")], "glyph string, lemma_ord int, variant_ord int, lemma_id string, translit string")
    words = spark.createDataFrame([(0, "𓀀"), (1, "𓀀𓄿𓏏")], "word_id int, glyph string")
    first = {r.word_id: r.match for r in lex.first_match(words, v).collect()}
    assert first[0].lemma_id == "L0" and first[1] is None
    assert {r.word_id: r.text for r in lex.fallback_text(words, v).collect()}[1] == "zzcd?"
    texts = spark.createDataFrame([(0, "abxx"), (1, "xxcd"), (2, "q"), (3, "")], "word_id int, word string")
    got = {r.word_id: r.match and r.match.lemma_id for r in lex.affix_match(texts, v).collect()}
    assert got == {0: "L1", 1: "L2", 2: None, 3: None}
    seg = lex.segment(words, ["𓀀𓄿", "𓀀"]).where("word_id = 1").first().segments
    assert [(x.glyph, x.known) for x in seg] == [("𓀀𓄿", True), ("𓏏", False)]


def test_training_set(spark):  # M3, M5, P8-P10, F2, W9, R6, A6
    c = corpus(spark, [("X Y", "(j)rx.kw q", "VERB NOUN", "1|rx 2|q", "know q", "wissen"), ("Z", "z", "N", "3|z", "z", "")])
    m = spark.createDataFrame([(0, 0, "(j)rx.kw", "rx", "VERB", 2, "know", ["A1"]), (0, 1, "q", None, None, 0, None, None), (1, 0, "z", "z", "N", 1, "z", None)], "sent_ord long, pos int, word string, lemma string, upos string, upos_id int, gloss string, gardiner array<string>")
    texts = lex.model_text(lex.tokens(m))
    assert {r.sent_ord: r.text for r in texts.collect()}[0] == "[PRE VERB](j) [VERB]rx [SUF VERB].kw [UNKNOWN]q"
    ex = lex.training_examples(c, texts).collect()
    assert len(ex) == 1 and ex[0].output_text == "wissen"
    with pytest.raises(ValueError):
        lex.training_examples(c, texts, "xx")
    assert lex.training_examples(c, texts, "de2hg").first().input_text == "wissen"
    assert [(r.upos, r.id) for r in lex.numbered(m, "upos").orderBy("id").collect()] == [("N", 1), ("VERB", 2)]
    n = spark.range(25).withColumnRenamed("id", "k")
    assert lex.split_by_place(n, "k").where("is_train").count() == 22
    b = lex.batches(n, 8, 1, "k").groupBy("batch").count().collect()
    assert sorted(r["count"] for r in b) == [1, 8, 8, 8]
    ids = spark.createDataFrame([(0, [1, 9]), (1, [2])], "k int, ids array<int>")
    assert lex.max_token_id(ids).first().max_id == 9 and [r.k for r in lex.offenders(ids, 5, "k").collect()] == [0]


FORMS = "e string, main string, type string, rank int, ord int, node string"


def test_chronology(spark):  # W1-W6, A4, A5
    rows = [("e", "M", "base", r, i, n) for i, (n, r) in enumerate([("a", 6), ("b", 2), ("c", 2), ("d", 999), ("x", 500)])] + [("e", "M", "plural", 6, 5, "p"), ("u", "U", "base", 999, 0, "d")]
    f = spark.createDataFrame(rows, FORMS)
    got = {(r["from"], r["to"], r["type"]) for r in ch.evolution_edges(f, "e").collect()}
    assert got == {("M", "b", "EVOLVES"), ("c", "a", "EVOLVES"), ("b", "c", "VARIANT"), ("M", "p", "DERIVED"), ("U", "d", "VARIANT")}
    assert {r.e: r.latest for r in ch.latest_base(f, "e").collect()} == {"e": "a", "u": "U"}
    assert ch.forms_by_period(f, "e").where("rank = 2").first().nodes == ["b", "c"]
    assert ch.adjacent_variants(f.where("e = 'e'"), "e").count() == 5
    s = spark.createDataFrame([("p", "x", 0), ("p", "y", 1), ("p", "y", 2), ("q", "x", 3), ("q", "y", 4)], "e string, s string, ord int")
    assert {r.e: r.canonical for r in ch.canonical_spelling(s, "s", "e").collect()} == {"p": "y", "q": "x"}


EDGES = [("A", "B", "EVOLVES"), ("B", "C", "DESCENDS"), ("C", "D", "DESCENDS"), ("B", "V", "VARIANT"), ("Z", "A", "BORROWED")]


def edges_of(spark, rows, net="n"):
    return spark.createDataFrame([(net, i, *r, "") for i, r in enumerate(rows)], "network_id string, edge_ord long, `from` string, `to` string, type string, notes string")


def test_ego_and_ancestry(spark):  # G1-G4, G17, G18
    e = edges_of(spark, EDGES)
    seed = lambda x: spark.createDataFrame([(x,)], "id string")
    names = lambda df: {r.node for r in df.collect()}
    one = g.ego(e, seed("B"), 1)
    assert names(one) == set("ABCV") and g.induced(e, one).count() == 3
    two = g.ego(e, seed("B"), 2)
    assert names(two) == set("ABCDVZ") and g.induced(e, two).count() == 5
    assert names(g.ancestry(e, seed("C"))) == set("ABCV") and names(g.ancestry(e, seed("C"), True, True)) == set("ABCDV")
    assert names(g.ego(e, seed("Q"), 2)) == {"Q"}
    nodes = spark.createDataFrame([("n", x, i, "egy", x.lower(), ["m"]) for i, x in enumerate("ABCDVZ")], "network_id string, id string, node_ord long, language string, form string, meanings array<string>")
    found, links = g.ego_query(nodes, e, "C", "ancestry")
    assert found.count() == 5 and links.count() == 4
    assert g.ego_query(nodes, e)[0].count() == 5
    with pytest.raises(ValueError):
        g.ego_query(nodes, e, "C", "x")
    assert [r.id for r in g.parents(e, "B").collect()] == ["A"] and {r.id for r in g.children(e, "B").collect()} == {"C", "V"}
    assert {r.id: r.parent for r in g.first_parent(e).collect()}["C"] == "B"
    assert g.find_node(nodes, "egy", "c").first().id == "C"
    assert all(r.n == 0 for r in g.violations(nodes, e).collect())
    assert {(r.what, r.key): r.n for r in g.statistics(nodes, e).collect()}[("edges", "DESCENDS")] == 2


def test_cleanup(spark):  # G12, G13
    nodes = spark.createDataFrame([("n", "e1", "egy", 2, 0, ["x"]), ("n", "e2", "egy", 6, 1, []), ("n", "d", "dem", 999, 2, ["y"]), ("n", "c", "cop", 999, 3, [])], "network_id string, id string, language string, rank int, node_ord long, meanings array<string>")
    e = edges_of(spark, [("e1", "d", "DESCENDS"), ("e1", "c", "DESCENDS"), ("d", "c", "DESCENDS")])
    assert {(r["from"], r["to"]) for r in g.cleanup_descent(nodes, e).collect()} == {("e2", "d"), ("d", "c")}
    assert {(r["from"], r["to"]) for r in g.reroute_descent(nodes, e.where("`from` = 'e1'")).collect()} == {("e1", "d"), ("d", "c")}


def test_merge(spark):  # G14, G15, A8
    held = {"N1": "xy", "N2": "yz", "N3": "z", "N4": "m", "N5": "m"}
    rows = [(n, f"{n}{f}", i, "egy", f, "", "", "", 0, [n]) for n, fs in held.items() for i, f in enumerate(fs)]
    nodes = spark.createDataFrame(rows, "network_id string, id string, node_ord long, language string, form string, period string, dialect string, hieroglyphs string, etymology_index int, meanings array<string>")
    e = edges_of(spark, [("N1x", "N1y", "VARIANT")], "N1").union(edges_of(spark, [("N2y", "N2z", "VARIANT")], "N2"))
    stop = spark.createDataFrame([("egy", "m")], "language string, form string")
    roots = lambda k: spark.createDataFrame([(n, k.get(n, 0)) for n in held], "network_id string, root_etymology_index int")
    to, out, links = g.merge_networks(nodes, e, roots({}), stop)
    assert {r.network_id: r.merged for r in to.collect()} == {"N1": "N1", "N2": "N1", "N3": "N1", "N4": "N4", "N5": "N5"}
    assert out.where("network_id = 'N1'").count() == 3 and links.count() == 2
    assert out.where("network_id = 'N1' and form = 'z'").first().meanings == ["N2", "N3"]
    to, _, _ = g.merge_networks(nodes, e, roots({"N2": 1}), stop)
    assert all(r.network_id == r.merged for r in to.collect())
    targets = spark.createDataFrame([("N3", "N2"), ("N2", "N1")], "source string, target string")
    assert g.merge_into(nodes, e, targets)[0].where("network_id = 'N1'").count() == 5


def test_components_random(spark):
    r = random.Random(5)
    pairs = [(r.randrange(120), r.randrange(120)) for _ in range(80)]
    label = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in label:
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(pairs, "src int, dst int")).collect()}
    assert got == label
    assert connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_search(spark):  # R1
    rows = [("n1", 0, "prt", [""], 3), ("n2", 1, "q", ["house of pr"], 9), ("n3", 2, "pr", [""], 1)]
    nodes = spark.createDataFrame([(n, o, f"{n}_{i}", f if i == 0 else "w", m if i == 0 else [], i) for n, o, f, m, k in rows for i in range(k)], "network_id string, network_ord int, id string, form string, meanings array<string>, node_ord int")
    assert [r.network_id for r in g.keyword_search(nodes, "PR").collect()] == ["n3", "n2", "n1"]
    assert g.keyword_search(nodes, "p").count() == 0
    assert [r.id for r in g.sequential_ids(nodes.select("id"), "N", "id", column="k").orderBy("id").limit(1).select(F.col("k").alias("id")).collect()] == ["N00001"]


def test_trees(spark):  # X4e, W8
    rows = spark.createDataFrame([(1, i, d) for i, d in enumerate((0, 2, 2))], "p int, ord int, depth int")
    parents = lambda df: [r.parent for r in df.orderBy("ord").collect()]
    assert parents(trees.parents(rows, "p")) == [None, 0, 0] and parents(trees.parents_by_stack(rows, "p")) == [None, 0, 1]
    deep = spark.createDataFrame([(1, i, i) for i in range(20)], "p int, ord int, depth int")
    assert parents(trees.parents(deep, "p")) == [None, *range(19)]
    with pytest.raises(Exception, match="depth beyond 12 levels"):
        trees.parents(deep, "p", levels=12).collect()


PAGE = """==Egyptian==
===Pronunciation===
{{egy-IPA}}
===Etymology 1===
From {{inh|egy|afa-pro|*bar}}. {{compound|egy|jr|ꜥꜣ}}
====Noun====
{{egy-noun|m|head=<hiero>O1:Z1</hiero>}}
# {{lb|egy|rare}} [[house]] {{defdate|Old Kingdom}}
#: an example
# {{alt form|egy|pꜣ}}
=====Alternative forms=====
{{egy-hieroforms|a|read1=a|date1=New Kingdom|b|read2=b|date2=Old Kingdom|c|read3=c|date3=Old Kingdom|d|read4=d}}
=====Derived terms=====
{{col3|egy|prt|prw<t:x>|prt}}
=====Descendants=====
* {{desc|egx-dem|pr}}
** {{desc|cop|ⲏⲓ|ⲏⲉⲓ}}
* {{desc|grc|φ|tr=ph}}
*** {{desc|la|x}}
===Etymology 2===
====Verb====
{{egy-verb}}
# to [[go]]
"""


def test_parser():  # X1-X11
    p = w.parse_page(PAGE, "Egyptian")
    e = p["etymologies"][0]
    d = e["definitions"][0]
    assert [len(x["definitions"]) for x in p["etymologies"]] == [1, 1] and p["pronunciations"] == ["egy-IPA"]
    assert d["definitions"] == ["[rare] house (dated: Old Kingdom)", "Alternative form of pꜣ"] and d["alternative_forms_from_definitions"] == ["pꜣ"]
    assert [(a["hieroglyphs"], a["date"]) for a in d["alternative_forms"]] == [("a", "New Kingdom"), ("b", "Old Kingdom"), ("c", "Old Kingdom"), ("d", None)]
    assert d["derived_terms"] == ["prt", "prw"]
    tree = [(x["ord"], x["parent_ord"], x["level"], x["language"], x["word"]) for x in d["descendants"]]
    assert tree == [(0, None, 0, "egx-dem", "pr"), (1, 0, 1, "cop", "ⲏⲓ"), (2, 0, 1, "cop", "ⲏⲉⲓ"), (3, None, 0, "grc", "φ"), (4, 3, 2, "la", "x")]
    assert e["ancestors"] == [{"language": "afa-pro", "form": "*bar", "type": "inh"}] and [c["form"] for c in e["components"]] == ["jr", "ꜥꜣ"]
    assert w.parse_page(PAGE, "Coptic")["etymologies"] == [] and w.parse_page(None, "Coptic")["etymologies"] == []
    gap = "* {{desc|a|1}}\n*** {{desc|a|2}}\n*** {{desc|a|3}}"
    assert [x["parent_ord"] for x in w.descendants(gap)] == [None, 0, 0] and [x["parent_ord"] for x in w.descendants(gap, compat=True)] == [None, 0, 1]
    assert w.components("{{affix|egy|pr|-t}}", "Egyptian")[1]["role"] == "suffix"
    assert w.coded_forms("{{alter|cop|ⲁ|B|ⲃ}}") == [{"form": "ⲁ", "dialect": "Bohairic"}, {"form": "ⲃ"}]


def test_best_match(spark):  # J7: the first of the part of speech, whatever the overlap; then overlap; then the lowest definition
    rows = [("e", "Noun", ["a b"], i, o, pos, m, d) for i, o, pos, m, d in (("x", 2, "Noun", ["z"], 3), ("y", 3, "Noun", ["a b"], 0), ("w", 1, "Verb", ["a b"], 0))]
    rows += [("f", None, ["a b c"], i, o, "Verb", m, d) for i, o, m, d in (("x", 1, ["a"], 0), ("y", 3, ["b C"], 4), ("w", 2, ["c b"], 5))]
    rows += [("g", "Noun", ["q"], i, o, "Verb", ["a"], d) for i, o, d in (("x", 1, 2), ("y", 2, 1), ("w", 3, 1))]
    rows += [("h", "Noun", [], i, o, "Verb", ["a"], d) for i, o, d in (("x", 1, 2), ("y", 2, None))]
    df = spark.createDataFrame(rows, "e string, part_of_speech string, meanings array<string>, c_id string, c_ord long, c_pos string, c_meanings array<string>, c_def int")
    assert {r.e: r.parent for r in networks.best_match(df, "e").collect()} == {"e": "x", "f": "w", "g": "y", "h": "y"}


def test_best_matches(spark):  # J7 without pairs: the same as best_match() over all of them, and no join by the key alone
    r = random.Random(5)
    some = lambda: r.choice([None, [], [""], *[[" ".join(r.choice("abcdeF") for _ in range(r.randrange(1, 4)))] for _ in range(3)]])
    entries = spark.createDataFrame([(i, r.choice("xy"), r.choice(["Noun", "Verb", "unknown", None]), some()) for i in range(150)], "e long, key string, part_of_speech string, meanings array<string>")
    held = spark.createDataFrame([(k, f"c{i}", i, r.choice(pos), some(), r.choice([None, 0, 1, 2, 3])) for i in range(60) for k, pos in (("x", ["Noun", "Adverb"]), ("y", ["Adverb"] * 30 + [None] * (i > 50)), ("z", ["Verb"]))], "key string, c_id string, c_ord long, c_pos string, c_meanings array<string>, c_def int")
    want = {(x.e, x.parent, x.overlap) for x in networks.best_match(entries.join(held, "key"), "e").collect()}
    found = networks.best_matches(entries, held, "key")
    assert {(x.e, x.parent, x.overlap) for x in found.collect()} == want and len(want) == 150
    lone = networks.best_matches(entries, held.where("key = 'y' and c_pos is not null"), "key")
    assert {(x.e, x.parent, x.overlap) for x in lone.collect()} == {(x.e, x.parent, x.overlap) for x in networks.best_match(entries.join(held.where("key = 'y' and c_pos is not null"), "key"), "e").collect()}


def test_networks(spark):  # G5-G11
    dem = "==Demotic==\n===Etymology===\n{{inh|egx-dem|egy|pr}}\n===Noun===\n{{egx-dem-noun}}\n# house\n"
    cop = "==Coptic==\n===Etymology===\n{{bor|cop|grc|φ}}\n===Noun===\n{{cop-noun}}\n# thing\n"
    lost = "==Coptic==\n===Etymology===\n{{der|cop|egy|nowhere}}\n===Noun===\n{{cop-noun}}\n# lost\n"
    rows = [(0, "ꜥꜣ", "Egyptian", "==Egyptian==\n===Noun===\n{{egy-noun}}\n# great\n"), (1, "pr", "Egyptian", PAGE), (2, "pr", "Demotic", dem), (3, "ⲕ", "Coptic", cop), (4, "ⲗ", "Coptic", lost)]
    pages = spark.createDataFrame(rows, "lemma_ord long, title string, language string, full_wikitext string")
    codes = F.create_map(*[F.lit(x) for x in ("Egyptian", "egy", "Demotic", "dem", "Coptic", "cop")])
    senses = w.senses(w.parse_pages(pages)).withColumn("language", codes[F.col("language")])
    nets, nodes, edges = networks.build_networks(senses)
    assert all(r.n == 0 for r in g.violations(nodes, edges).collect())
    assert {r.network_id for r in nets.collect()} == {"egy/0/0", "egy/1/0", "egy/1/1", "cop/3/0"}
    got = {(r["from"].split("/", 3)[-1], r["to"].split("/", 3)[-1], r["type"]) for r in edges.where("network_id = 'egy/1/0'").collect()}
    assert {("m/0", "a/0/1", "EVOLVES"), ("a/0/2", "a/0/0", "EVOLVES"), ("a/0/1", "a/0/2", "VARIANT"), ("a/0/0", "d/dem/pr", "DESCENDS"), ("d/dem/pr", "d/cop/ⲏⲓ", "DESCENDS"), ("m/0", "d/egy/prt", "DERIVED"), ("d/egy/ꜥꜣ", "m/0", "COMPONENT"), ("d/afa-pro/*bar", "m/0", "INHERITED")} <= got
    assert nodes.where("id = 'egy/1/0/d/dem/pr'").first().meanings == ["house"]  # attached: filled in
    assert nodes.where("id = 'egy/1/0/d/egy/ꜥꜣ'").first().meanings == ["great"]  # from the earlier network
    assert [r.lemma for r in networks.orphans(senses).collect()] == ["ⲗ"]
    out = networks.export_ids(nets, nodes, edges)
    assert out[1].count() == nodes.count() and out[2].count() == edges.count() and out[0].agg(F.min("network_id")).first()[0] == "NET00001"
    nested = ingest.nested_networks(nets, nodes, edges).where("network_id = 'egy/0/0'").first()
    assert len(nested.nodes) == 1 and nested.edges is None


def test_entries(spark):  # X13, X14, S9, S10
    b = spark.createDataFrame([(5, "[pr] house {O1} [nfr]  good\n thing {F35} [x] {}")], "page int, text string")
    assert [(r.transliteration, r.definition, r.gardiner) for r in w.scan_entries(b).orderBy("ord").collect()] == [("pr", "house", "O1"), ("nfr", "good thing", "F35")]
    text = F.lit("===Etymology 1===\n====Noun====\n{{egy-h|A}} {{egy-hieroforms|yꜣ|title=x}}")
    r = spark.range(1).select(w.simple_page(text).alias("a"), w.simple_page(text, True).alias("b")).first()
    assert (r.a.n_etymologies, r.a.parts_of_speech, r.a.hieroglyphs) == (1, ["Noun"], ["A", "yꜣ"]) and r.b.parts_of_speech == []
    words = spark.createDataFrame([(1, 0, 10.0, "l1"), (1, 1, 90.0, "r1"), (1, 2, 11.0, "l2")], "page int, ord int, x0 double, word string")
    assert ingest.column_text(words).first().text == "l1 l2 r1"
    pages = spark.createDataFrame([(1, "skip}"), (5, "a "), (6, "b}"), (7, "c")], "page int, text string")
    assert [(r.page, r.text) for r in ingest.accumulate_pages(pages).orderBy("block").collect()] == [(6, "ab}"), (7, "c")]


def test_sources(spark, tmp_path):  # S1-S8, K1, K2, F8
    f = tmp_path / "k.json"
    f.write_text('{"b": {"x": "1"}, "a": {"x": "2"}, "b": {"x": "3"}}')
    assert [(r.key, r.value.x) for r in ingest.read_keyed_json(spark, str(f), "struct<x:string>").orderBy("ord").collect()] == [("b", "3"), ("a", "2")]
    t = tmp_path / "t.json"
    t.write_text('{"lemmas": ["a", "Category:x", "b"]}')
    assert [r.title for r in ingest.read_titles(spark, str(t), "demotic").orderBy("lemma_ord").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        ingest.read_titles(spark, str(t), "latin")
    answers = [{"query": {"categorymembers": [{"title": "a"}, {"title": "Category:b"}]}, "continue": {"cmcontinue": "x"}}, {"query": {"categorymembers": [{"title": "c"}]}}]
    assert list(ingest.list_members(lambda _: answers.pop(0), "C")) == ["a", "c"]
    with pytest.raises(RuntimeError):
        list(ingest.list_members(lambda _: (_ for _ in ()).throw(RuntimeError("down")), "C", retries=2, wait=0))
    with pytest.raises(ingest.StatusError):
        ingest.check_status(500, "x")
    titles = spark.createDataFrame([("a",), ("b",)], "title string")
    get = lambda t: {"query": {"pages": {"1": {"revisions": [{"slots": {"main": {"*": "text " + t}}}]}}}} if t == "a" else {"query": {"pages": {"-1": {}}}}
    assert {r.title: r.full_wikitext for r in ingest.fetch_pages(titles, get, pause=0).collect()} == {"a": "text a", "b": None}
    assert [r.title for r in ingest.unseen(titles, titles.where("title = 'a'")).collect()] == ["b"]
    page = F.lit("==Egyptian==\nx\n===N===\ny\n==Coptic==\nz")
    assert spark.range(1).select(ingest.language_section(page, "Egyptian").alias("s")).first().s == "==Egyptian==\nx\n===N===\ny"
    assert spark.range(1).select(ingest.language_section(F.lit("abc"), "Egyptian").alias("s")).first().s == "abc"
    path = str(tmp_path / "table")
    row = lambda k, v, x: spark.createDataFrame([(k, v, x)], "k int, v int, x string")
    ingest.upsert_path(spark, path, row(1, 1, "a"), ["k"], "v")
    ingest.upsert_path(spark, path, row(1, 2, "b").union(row(2, 1, "c")), ["k"], "v")
    ingest.upsert_path(spark, path, row(1, 1, "old"), ["k"], "v")
    assert {r.k: r.x for r in spark.read.parquet(path).collect()} == {1: "b", 2: "c"}


def test_upsert_after_a_crash(spark, tmp_path):  # K1
    """Whatever step a writer died at, the next call finds a whole table."""
    row = lambda k, v, x: spark.createDataFrame([(k, v, x)], "k int, v int, x string")
    read = lambda path: {r.k: r.x for r in spark.read.parquet(path).collect()}
    for step in ("next whole", "next broken", "only last"):
        path = str(tmp_path / step.replace(" ", "-"))
        if step == "next whole":  # died between the two renames, the new table is whole
            row(1, 2, "new").write.parquet(path + ".next")
            row(1, 1, "old").write.parquet(path + ".last")
        else:
            row(1, 1, "old").write.parquet(path + (".last" if step == "only last" else ""))
            if step == "next broken":  # died while writing
                (tmp_path / "next-broken.next").mkdir()
        ingest.upsert_path(spark, path, row(2, 1, "b"), ["k"], "v")
        assert read(path) == {1: "new" if step == "next whole" else "old", 2: "b"}


def test_shared_folder_is_asked_for():
    """Off a local master, a missing spark.checkpoint.dir is an error."""
    from types import SimpleNamespace

    from glyphweave.session import shared_dir

    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_stream(spark, tmp_path):
    from glyphweave.streaming import upserts

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, v int, x string").write.parquet(src)
    stream = spark.readStream.schema("k int, v int, x string").parquet(src)
    upserts.upsert_stream(stream, str(tmp_path / "out"), ["k"], "v", str(tmp_path / "cp")).awaitTermination()
    assert [r.x for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["b"]
