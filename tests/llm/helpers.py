"""Small tables with every odd case, and plain versions of the operators."""

import collections
import random
import re

SPACE = r"[^\x20\x09-\x0D]+"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, rank string, dropped string"


def words(text):
    return re.findall(SPACE, text or "")


def sample(seed=1, n=40):
    """Texts with copies, near copies, shared passages and lines; nulls, blanks, a very long text, odd spaces, repeated rows, clashing extra columns."""
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdeéßΣ") for _ in range(r.randrange(2, 6))) for _ in range(120)]
    line = lambda k: " ".join(r.choice(pool) for _ in range(k)).capitalize() + "."
    texts = ["\n".join(line(r.randrange(8, 30)) for _ in range(r.randrange(1, 6))) for _ in range(n)]
    texts += [texts[0], texts[0].upper() if texts[0].isascii() else texts[0], texts[1]]
    for k in range(2, 6):  # near copies: one word in about sixty changed
        w = texts[k].split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    passage = line(60)
    texts += [line(20) + " " + passage + " " + line(20), passage + " " + line(30)]
    texts += [None, "", "  \t\n", "one", "Two words", "three\x0bwords\x0chere", "a b c d", "word " * 300, (line(25) + "\n") * 4, " ".join(r.choice(pool) for _ in range(6000))]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", None]), len(t or ""), -1, "x", "y") for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, "no id " + texts[7], "en", "s1", 1, 1, None, None)]


def components(nodes, links):
    label = {x: x for x in nodes}

    def root(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def shingles(text, n):
    w = words((text or "").translate(ASCII))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def jaccard_links(sets, num, den):
    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                yield a, b


def counts(text):
    text = text or ""
    w = words(text)
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    inside = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    seen, again = set(), 0
    for x in text.split("\n"):
        if words(x):
            again += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside)
