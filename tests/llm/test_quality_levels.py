import numpy as np
import random

from glyphweave.llm import quality


def test_small_sources(spark):
    """A source of 50 rows is judged by all rows of its language, a language of 20 by all rows."""
    r = random.Random(5)
    text = lambda w: " ".join("".join(r.choice("abcdefgh") for _ in range(w())) for _ in range(r.randrange(60, 400)))
    usual, wild = lambda: r.randrange(2, 9), lambda: 40
    rows = [(i, text(usual), "en", "large") for i in range(300)]
    rows += [(1000 + i, text(wild if i < 10 else usual), "en", "small") for i in range(50)]
    rows += [(2000 + i, text(wild if i < 5 else usual), "fr", "tiny") for i in range(20)]
    got = {x.doc_id: x for x in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(x.distance is not None for x in got.values())
    assert {i for i, x in got.items() if not x.kept} == {*range(1000, 1010), *range(2000, 2005)}


def _plain_mcd(z, rng):
    """Minimum covariance determinant in numpy: many random starts, exact subsets, then reweighted; FLOOR on the variances."""
    n, p = z.shape
    h, floor = int(np.ceil(quality.SUBSET * n)), np.diag(np.square(quality.FLOOR))

    def estimate(rows, share):
        factor = share / quality._chi2_cdf(quality._chi2_quantile(share, p), p + 2)
        return rows.mean(0), np.cov(rows.T, bias=True) * factor + floor

    def distance(m, c):
        return np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(c), z - m)

    best = (np.inf,)
    for _ in range(60):
        m, c = estimate(z[rng.choice(n, p + 1, replace=False)], 1 - 1e-9)
        for _ in range(30):
            m, c = estimate(z[np.argsort(distance(m, c))[:h]], quality.SUBSET)
        best = min(best, (np.linalg.slogdet(c)[1], m, c), key=lambda x: x[0])
    _, m, c = best
    return (best[0], *estimate(z[distance(m, c) <= quality._chi2_quantile(quality.RETAINED, p)], quality.RETAINED))


def test_minimum_determinant(spark):
    """Location, scatter and determinant against numpy, with none, scattered and clustered junk of up to a fifth."""
    rng = np.random.default_rng(5)
    mix = rng.standard_normal((5, 5))
    groups = {}
    for name, junk in (("clean", 0), ("far", 60), ("cluster", 120)):
        z = rng.standard_normal((600, 5)) @ mix
        if name == "far":
            z[:junk] += rng.standard_normal((junk, 5)) * 30
        else:
            z[:junk] = z[:junk] * 0.1 + np.array([9, -6, 7, 8, -9])
        groups[name] = np.round(z * quality.UNIT) / quality.UNIT
    rows = [(name, *map(int, np.round(v * quality.UNIT))) for name, z in groups.items() for v in z]
    found = {r.grp: r for r in quality.minimum_determinant(spark.createDataFrame(rows, "grp string, " + ", ".join(f"{z} long" for z in quality.Z))).collect()}
    for name, z in groups.items():
        _, m, c = _plain_mcd(z, rng)
        r = found[name]
        low = np.zeros((5, 5))
        for i, j in quality.PAIRS:
            low[i, j] = r[f"l_{i}{j}"]
        mine = low @ low.T
        scale = np.sqrt(np.diag(c))
        assert np.abs((np.array([r[f"m_{i}"] for i in range(5)]) - m) / scale).max() < 0.06
        assert np.abs((mine - c) / np.outer(scale, scale)).max() < 0.1
        gone = lambda m, c: np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(c), z - m) > quality._chi2_quantile(1 - quality.TAIL, 5)
        assert (gone(m, c) == gone(np.array([r[f"m_{i}"] for i in range(5)]), mine)).mean() > 0.995
        if name == "cluster":
            assert gone(np.array([r[f"m_{i}"] for i in range(5)]), mine)[:120].all()
