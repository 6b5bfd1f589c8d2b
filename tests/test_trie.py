"""Longest signs by a trie, against plain comparison."""

import random

import pytest
from pyspark.sql import functions as F

from glyphweave.operators import lexicon as lex, trie


def plain(signs, word):
    out, i = [], 0
    while word and i < len(word):
        hit = max((s for s in signs if s and word.startswith(s, i)), key=len, default=None)
        out.append((hit or word[i], hit is not None))
        i += len(hit or word[i])
    return out


@pytest.mark.parametrize("seed", range(6))
def test_random_signs(seed):
    r = random.Random(seed)
    letters = ["ab", "abcé", "𓀀𓀁𓄿A", "x"][seed % 4]
    word = lambda k: "".join(r.choice(letters + " ") for _ in range(r.randrange(k)))
    signs = [word(5) for _ in range(r.choice([0, 1, 12]))]
    words = [word(12) for _ in range(60)] + [None, ""]
    got = [[(p["glyph"], p["known"]) for p in w] for w in trie.segments(trie.build(signs), words)]
    assert got == [plain(signs, w) for w in words]


def test_signs_from_a_table(spark):
    signs = ["ab", "abc", "b", "", None]
    words = spark.createDataFrame([(1, "abcb"), (2, "aabd"), (3, None), (4, "")], "word_id long, glyph string")
    df = spark.createDataFrame([(s,) for s in signs], "sign string")
    got = {r.word_id: [(s.glyph, s.known) for s in r.segments] for r in lex.segment(words, df).collect()}
    assert got == {1: [("abc", True), ("b", True)], 2: [("a", False), ("ab", True), ("d", False)], 3: [], 4: []}
    with pytest.raises(ValueError, match="more than 2"):
        lex.segment(words, df.union(spark.range(5).select(F.col("id").cast("string"))), most=2)
