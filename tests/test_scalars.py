import random
import re

import pytest
from pyspark.sql import functions as F

from glyphweave.functions import lexical as lx, tables as t, text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("word", "pre", "root", "suf"),
    [("wdi̯.kꜣ", [], "wdi̯", [".kꜣ"]), ("(j)rx.kw=f", ["(j)"], "rx", [".kw", "=f"]), ("(a)(b)", ["(a)", "(b)"], "", []), ("..x", [], ".", [".x"]), ("x.", [], "x.", []), (".f", [], "", [".f"]), ("()a", [], "()a", []), ("", [], "", [])],
)
def test_affixes(spark, word, pre, root, suf):  # P1
    got = one(spark, tx.affixes(F.lit(word)))
    assert (got.prefixes, got.root, got.suffixes) == (pre, root, suf)


def test_affixes_against_loop(spark):  # P1
    def loop(w):
        pre, suf = [], []
        while m := re.match(r"\([^)]+\)", w):
            pre.append(m[0])
            w = w[m.end() :]
        while m := re.search(r"[.=][^\s.=]+$", w):
            suf.insert(0, m[0])
            w = w[: m.start()]
        return pre, w, suf

    r = random.Random(3)
    words = ["".join(r.choice("ab().= ꜣ") for _ in range(r.randrange(9))) for _ in range(400)]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", tx.affixes(F.col("w")).alias("a")).collect()
    assert all((x.a.prefixes, x.a.root, x.a.suffixes) == loop(x.w) for x in rows)


def test_lemma_affixes(spark):  # P1b
    got = one(spark, tx.lemma_affixes(F.lit("(j)rx.kw=f"), F.lit("rx.kw=f")))
    assert (got.prefixes, got.root, got.suffixes) == (["(j)"], "rx.kw=f", [])
    got = one(spark, tx.lemma_affixes(F.lit("(j)rx.kw=f"), F.lit("(j)rx")))
    assert (got.prefixes, got.root, got.suffixes) == ([], "(j)rx", [".kw", "=f"])


def test_glyphs(spark):  # P2-P5
    assert one(spark, tx.glyph_code(F.lit("𓀀𓄿𓅱𓇋𓆓𓆑𓊪𓏏x"))) == ["A1", "G1", "G43", "M17", "I10", "I9", "Q3", "X1", "UNK(x)"]
    assert one(spark, tx.mixed_codes(F.lit("𓀀 <g>V31Aa</g>︂"))) == ["A1", "V31AA"]
    assert one(spark, tx.sentence_clusters(F.lit("D36𓀀 <g>a</g>"))) == [["D36", "𓀀"], ["<g>a</g>"]]
    assert one(spark, tx.sentence_codes(F.lit("D3 𓀀"))) == [["UNK(D)", "UNK(3)"], ["A1"]]
    assert one(spark, tx.codes_to_text(F.lit("A1-G1 ZZ9"))) == "𓀀𓄿 �"
    assert one(spark, tx.segment_codes(F.lit("𓀀 ︂"))) == ["A1"]


def test_sign_collisions():  # Q2
    compat, fixed = t.glyph_codes(True), t.glyph_codes()
    assert len(compat) - len(set(compat.values())) == 5 and len(fixed) == len(set(fixed.values())) == len(compat)


def test_tags(spark):  # P6-P9
    assert [one(spark, tx.is_prefix(F.lit(x))) for x in ("(j)", "(ꜣ)", "j")] == [True, False, False]
    assert [one(spark, tx.is_suffix(F.lit(x))) for x in (".f", "=k", ".ꜣ")] == [True, True, False]
    assert one(spark, tx.is_determinative(F.lit("-"))) is True
    assert one(spark, tx.morph_marker(F.lit("a"), F.lit(False), F.lit(True), F.lit(True))) == "a[suffix]"
    toks = F.array(*[F.struct(tx.token_type(F.lit(k), F.lit("VERB")).alias("type"), F.lit(w).alias("token")) for k, w in (("PREFIX", "(j)"), ("ROOT", "rx"), ("SUFFIX", ".kw"))])
    assert one(spark, tx.model_string(toks)) == "[PRE VERB](j) [VERB]rx [SUF VERB].kw"
    assert one(spark, tx.token_type(F.lit("ROOT"), F.lit(""))) == "ROOT"


def test_sequences(spark):  # P11-P14
    none = F.lit(None).cast("string")
    assert one(spark, tx.source_text(F.lit("X"), none, none, none)) == "[HIERO] X\n[TRANS] \n[LEMMA] \n[GLOSS] "
    ids = F.array(*map(F.lit, (5, 6, 7)))
    assert one(spark, tx.pad(ids, 5)) == [5, 6, 7, 0, 0] and one(spark, tx.pad(ids, 2)) == [5, 6]
    assert one(spark, tx.mask_labels(tx.pad(ids, 4))) == [5, 6, 7, -100]
    assert tuple(one(spark, tx.shift(ids))) == ([5, 6], [6, 7])
    assert one(spark, tx.clean(F.lit(" a\n\nb "))) == "a b" and one(spark, tx.collapse(F.lit(" a \t b"))) == "a b"


@pytest.mark.parametrize(
    ("label", "name", "rank"),
    [(None, None, 999), ("", None, 999), ("Second Intermediate Period?", "Second Intermediate Period", 5), ("Greco-Roman Period", "Roman", 10), ("11th Dynasty", "11th Dynasty", 3), ("1st Dynasty", "1th Dynasty", 1), ("18th dynasty", "18th Dynasty", 6), ("Old Kingdom to New Kingdom", "Old Kingdom", 2), ("Pyramid Texts", "Pyramid Texts", 2), ("somewhere", "somewhere", 500)],
)
def test_periods(spark, label, name, rank):  # P15, P16
    c = F.lit(label).cast("string")
    assert (one(spark, lx.period(c)), one(spark, lx.period_rank(c))) == (name, rank)


def test_entries(spark):  # P17-P31
    assert [one(spark, lx.form_type(F.lit(a), F.lit(b))) for a, b in (("Plural", "dual"), ("x", "fem. dual"), ("deity", ""), (None, None))] == ["plural", "dual", "god", "base"]
    assert one(spark, lx.head_hieroglyphs(F.lit("m|head=<hiero>O1:Z1</hiero>"))) == "O1:Z1"
    assert one(spark, lx.is_alternative(F.array(F.lit("Alternative form of x")))) is True
    assert one(spark, lx.alternative_target(F.array(F.lit("[rare] Alternative form of pr.")))) == "pr"
    assert one(spark, lx.ancestor(F.lit("{{inh|egx-dem|egy|pr<t:x>}}"), "dem")) == "pr"
    assert one(spark, lx.ancestor(F.lit("{{der|cop-sah|egy|jb}}"), "cop")) == "jb" and one(spark, lx.ancestor(F.lit("{{der|cop|grc|x}}"), "cop")) is None
    assert one(spark, lx.descendant_language(F.lit("cop-sah"))) == "cop" and one(spark, lx.descendant_language(F.lit("cop-her"))) == "cop-her"
    assert one(spark, lx.language_name(F.lit("la"))) == "Latin" and one(spark, lx.language_name(F.lit("zz"))) == "zz"
    assert one(spark, lx.page_url(F.lit("a b"), F.lit("Egyptian"))).endswith("/a%20b#Egyptian")
    assert [one(spark, lx.phonetic_code(F.lit(x))) for x in ("nfr", "ḥtp", "Nb", "Aa12", "zzz")] == ["F35", "R4", "V30", "Aa12", None]
    assert one(spark, lx.layout(F.lit("nfr-pr:Z1*A1!t"))) == [[[["F35"]], [["O1"], ["Z1", "A1"]]], [[["X1"]]]]
    assert one(spark, lx.layout_text(F.lit("<hiero>A1:G1-zz H_SPACE</hiero>"))) == "𓀀𓄿"
    assert one(spark, lx.clean_meanings(F.array(F.lit("{{x}}[[a|house]] of [[god]]"), F.lit("ab")))) == ["house of god"]
    assert one(spark, lx.etymology_display(F.lit("From {{m|egy|pr}}."))) == "From pr."
    assert one(spark, lx.snippet(F.array(F.lit("x" * 90)))) == "x" * 80 + "..." and one(spark, lx.snippet(F.array().cast("array<string>"))) == "No meaning available"
    assert one(spark, lx.edge_colour(F.lit("VARIANT"))) == "#95a5a6" and one(spark, lx.edge_dash(F.lit("EVOLVES"))) == "0" and one(spark, lx.node_colour(F.lit("cop-sah"))) == "#95e1d3"


def test_sign_list(spark):  # S11
    assert t.sign_list(spark).count() == 911
