"""The whole pipeline against a plain version, on a table too small for robust estimates (so that the base rule alone decides on quality)."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import helpers as h
from tests.llm.test_line_kinds import _plain

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _targets(words):
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight, total, full = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(words.values()), set()
    while True:
        left = total - sum(2 * words[s] for s in full)
        target = {s: 2.0 * words[s] if s in full else left * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        over = {s for s in order if s not in full and target[s] > 2 * words[s]}
        if not over:
            return target
        full |= over


def _copies(docs):
    """How often the mix takes each (doc_id, text, source)."""
    size = {d: len(h.words(d[1])) for d in docs}
    words = collections.Counter()
    for d in docs:
        words[d[2]] += size[d]
    out = {}
    for source, target in _targets(words).items():
        mine = [d for d in docs if d[2] == source]
        certain = math.floor(target / max(words[source], 1))
        need = target - certain * words[source]
        out |= dict.fromkeys(mine, certain)
        if target / max(words[source], 1) == certain:
            continue
        weight = {d: max(1, math.floor(64 * math.log(size[d] + 2) + 0.5)) for d in mine}
        some, full = [d for d in mine if size[d]], []
        while True:
            scale = (need - sum(size[d] for d in full)) / sum(size[d] * weight[d] for d in some if d not in full)
            over = [d for d in some if d not in full and scale * weight[d] > 1]
            if not over:
                break
            full += [d for d in some if weight[d] == max(weight[x] for x in over)]
        odds = lambda p: p / (1 - p)
        rank = {}
        for d in some:
            u = (int(hashlib.md5(str(d[0]).encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            rank[d] = 0.0 if d in full or scale * weight[d] >= 1 else odds(u) / odds(scale * weight[d])
        gap, taken = need, set()
        for d in sorted(some, key=lambda d: (rank[d], d[0])):
            if size[d] <= gap:
                gap -= size[d]
                taken.add(d)
        last = min((d for d in some if d not in taken and size[d] < 2 * gap), key=lambda d: (abs(gap - size[d]), rank[d], d[0]), default=None)
        for d in taken | ({last} if last else set()):
            out[d] += 1
    return out


def test_against_plain(spark, tmp_path):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghijklmno") for _ in range(r.randrange(3, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for i in range(60):
        body = [line(r.randrange(12, 30)) for _ in range(r.randrange(2, 7))]
        if i % 3 == 0:
            body.insert(r.randrange(len(body)), f"Posted by {word()} on the board for {word()} and friends")
        if i % 4 == 0:
            body.append("All rights are with those who wrote it")
        rows.append((i, "\n".join(body), "en", f"s{i % 5}" if i % 11 else None))
    near = max((x[1] for x in rows), key=len).split(" ")
    near[5] = "changed"
    rows += [(100, rows[9][1], "en", "s0"), (101, " ".join(near), "de", "s1"), (102, "short", "en", "s1"), (103, None, "en", "s2"), (104, "again and again " * 20, "en", "s2"), (105, line(9000), "en", "s3")]
    r.shuffle(rows)
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = []
    for i, text, _, source in sorted(rows):
        n, *rest = h.counts(text)
        if n >= 20 and 100 * rest[-1] <= 30 * n:
            kept.append((i, text, source))
    gone = _plain([t for _, t, _ in kept])
    assert len(gone) > 25
    kept = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if (at, k) not in gone), s) for at, (i, t, s) in enumerate(kept)]
    kept = [d for d in kept if h.words(d[1])]
    sets = {i: h.shingles(t, 5) for i, t, _ in kept}
    component = h.components(sets, h.jaccard_links(sets, 80, 100))
    kept = [d for d in kept if component[d[0]] == d[0]]
    assert {100, 101, 102, 103, 104}.isdisjoint(d[0] for d in kept) and len(kept) == 61
    whole, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), collections.Counter()
    for d, n in _copies(kept).items():
        ids = [*whole.encode(d[1], add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), 4096)):
            want[d[0], p, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())] += n
    assert collections.Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == +want
    used = collections.defaultdict(list)
    for x in got:
        used[x.sequence_id].append((x.offset, x.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
