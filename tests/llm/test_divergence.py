"""Source divergences against plain integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from glyphweave.llm import divergence
from tests.llm.helpers import ASCII, COLUMNS, sample

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def plain(data, least=3, most=200):
    n, docs, groups = Counter(), Counter(), set()
    for _, text, lang, source, *_ in data:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(TERM, (text or "").translate(ASCII))
        n.update((lang, source, t) for t in found)
        docs.update((lang, t) for t in set(found))
    kept = defaultdict(list)
    for (lang, t), k in docs.items():
        if k >= least:
            kept[lang].append(t)
    p, whole = {}, {}
    of = lambda lang: sorted(s for a, s in groups if a == lang)
    for lang in {a for a, _ in groups}:
        v = len(kept[lang])
        for s in of(lang):
            size = sum(n[lang, s, t] for t in kept[lang])
            p |= {(lang, s, t): 1 + 10**9 * (n[lang, s, t] + 1) // (size + v) for t in kept[lang]}
        every = {t: sum(n[lang, s, t] for s in of(lang)) for t in kept[lang]}
        whole |= {(lang, t): 1 + 10**9 * (every[t] + 1) // (sum(every.values()) + v) for t in kept[lang]}
    out = []
    for lang, s in groups:
        pairs = [(sum((p[lang, s, t] - p[lang, o, t]) ** 2 // p[lang, o, t] for t in kept[lang]), o) for o in of(lang) if o != s]
        terms = [((p[lang, s, t] - whole[lang, t]) ** 2 // whole[lang, t], t) for t in kept[lang] if n[lang, s, t] and p[lang, s, t] > whole[lang, t]]
        for part, found, cut in (("pair", pairs, None), ("term", terms, most)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:cut], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def odd_rows():
    rows = sample(3, 60)
    rows += [(900 + i, t, "xx", f"s{i}", 0, 0, "", "") for i, t in enumerate(["", None, "once", "123 +++ [\\]^_`{|}~\x7f"])]
    return rows + [(950, "İı Iß\U000131a3 a\x80b É é", "en", "s1", 0, 0, "", "")] * 4


@pytest.mark.parametrize("settings", [{}, {"block_terms": 5, "most_terms": 7}, {"cells": 40, "most_terms": 3}, {"least_docs": 1}])
def test_all_rows_are_those_of_plain_integers(spark, settings):
    data = odd_rows()
    df = spark.createDataFrame(data, COLUMNS).repartition(3)
    assert got(divergence.divergence(df, **settings)) == plain(data, settings.get("least_docs", 3), settings.get("most_terms", 200))


def test_dictionaries_that_are_passed_on_early(spark, monkeypatch):
    data = odd_rows()
    monkeypatch.setattr(divergence, "HELD", 3)
    n, docs = Counter(), Counter()
    import pyarrow as pa

    texts = [(r[2] or "", r[3] or "", (r[1] or "").encode()) for r in data]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*texts[i : i + 4], strict=True)], names=["lang", "source", "text"]) for i in range(0, len(texts), 4)]
    for batch in divergence._count(iter(batches)):
        for r in batch.to_pylist():
            n[r["lang"], r["source"], r["term"]] += r["n"]
            docs[r["lang"], r["source"], r["term"]] += r["docs"]
    want = Counter()
    for lang, source, text in texts:
        want.update((lang, source, t.encode()) for t in re.findall(TERM, text.decode().translate(ASCII)))
    assert {k: v for k, v in n.items() if v} == want
    assert {(a, b) for a, b, t in n if not t} == {(a, b) for a, b, _ in texts}
    assert max(docs.values()) <= len(data)


def test_an_empty_table_and_one_without_terms(spark):
    assert got(divergence.divergence(spark.createDataFrame([], COLUMNS))) == []
    rows = [(1, "1 2 3", "en", "a", 0, 0, "", ""), (2, None, "en", "b", 0, 0, "", ""), (3, "x", None, None, 0, 0, "", "")]
    assert got(divergence.divergence(spark.createDataFrame(rows, COLUMNS))) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_ties_are_in_order_of_bytes(spark):
    words = ["zz", "é", "ﬀ", "\U00010400", "aa"]
    rows = [(i, " ".join(words), "en", "a", 0, 0, "", "") for i in range(3)] + [(9, "other " * 50, "en", "b", 0, 0, "", "")] * 3
    found = [r for r in got(divergence.divergence(spark.createDataFrame(rows, COLUMNS))) if r[1] == "a" and r[2] == "term"]
    assert [r[3] for r in sorted(found, key=lambda r: r[5])] == sorted(words, key=str.encode)


def test_shares_by_long_division():
    r = random.Random(1)
    for _ in range(500):
        whole, kinds = r.randrange(10 ** r.randrange(1, 16)), r.randrange(1, 10**6)
        count = r.randrange(whole + 1)
        assert divergence.share(np.array([count]), whole, kinds)[0] == 1 + 10**9 * (count + 1) // (whole + kinds)
