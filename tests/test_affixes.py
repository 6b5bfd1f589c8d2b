"""Variants that start or end a word, against plain comparison."""

import random

from glyphweave.operators import affixes, lexicon as lex
from glyphweave.session import settings


def test_against_plain_comparison(spark):
    r = random.Random(1)
    text = lambda n: "".join(r.choice("abé\U00013000") for _ in range(r.randrange(n)))
    variants = [(text(5), r.randrange(30), r.randrange(3), f"l{r.randrange(9)}") for _ in range(60)] + [(None, 0, 0, "null"), ("", 0, 0, "empty"), ("a", 5, None, "x"), ("abab" * 30, 1, 0, "long")]
    words = [(k, text(9)) for k in range(300)] + [(1000, None), (1001, ""), (1002, "abab" * 40), (1003, "zz"), (1004, words_ := "ab"), (1005, words_)]
    order = lambda v: tuple((x is not None, x if x is not None else 0) for x in (v[1], v[2], v[3], v[0]))

    def plain(w):
        hits = [v for v in variants if v[0] and w and (w.startswith(v[0]) or w.endswith(v[0]))]
        best = min(hits, key=order, default=None)
        return best and (best[3], best[0])

    vdf = spark.createDataFrame(variants, "translit string, lemma_ord long, variant_ord long, lemma_id string")
    wdf = spark.createDataFrame(words, "word_id long, word string")
    for conf in ({}, {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        with settings(spark, conf):
            got = {x.word_id: x.match and (x.match.lemma_id, x.match.translit) for x in affixes.affix_match(wdf, vdf).collect()}
            assert got == {k: plain(w) for k, w in words}


def test_no_words_and_no_variants(spark):
    vdf = spark.createDataFrame([], "translit string, lemma_ord long, variant_ord long, lemma_id string")
    wdf = spark.createDataFrame([(1, "ab")], "word_id long, word string")
    assert [x.match for x in lex.affix_match(wdf, vdf).collect()] == [None]
    assert lex.affix_match(wdf.limit(0), vdf).count() == 0
