import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import quality, shared


def test_scatter_of_normal_data(spark):
    rng = np.random.default_rng(3)
    mean, sd = np.array([13.0, 1.6, 3.0, 4.0, 1.52]), np.array([1.2, 0.2, 0.45, 0.62, 0.62])
    x = mean + sd * rng.standard_normal((20_000, 5))
    x = x[(x[:, 4] > 0) & (x[:, 4] < 3.04)]
    n = np.exp(x[:, 0]).round()
    counts = np.stack([n, n * np.exp(x[:, 1]), *[n * np.expm1(x[:, k]) / 100 for k in (2, 3, 4)]], axis=1).round().astype(int)
    rows = spark.createDataFrame([("en", "a", *map(int, r), t.tolist()) for r, t in zip(counts, quality.transformed(counts), strict=True)], "lang string, source string, " + ", ".join(f"{c} long" for c in quality.STATS) + ", x array<double>")
    inv = quality.fit(shared.stash(rows, "rows")).where(F.col("key") == "0|").first().inv
    found = np.diag(np.linalg.inv(np.array(inv).reshape(5, 5)))
    assert found[:4] == pytest.approx(sd[:4] ** 2, rel=0.07)


@pytest.mark.parametrize("keep", [0.5, 0.75, 0.9])
def test_consistency(keep):
    x = np.random.default_rng(5).standard_normal((400_000, 5))
    d = (x**2).sum(axis=1)
    assert quality.consistency(keep) * (x[d <= np.quantile(d, keep)] ** 2).mean() == pytest.approx(1, abs=0.01)


# ------------------------------------------------------------ verdicts against a model of the method on whole groups

def moments(x, scale):
    mean, cov = x.mean(axis=0), np.cov(x.T, bias=True) * scale
    return mean, cov + np.diag(np.maximum(quality.FLOORS**2 - np.diag(cov), 0) + 1e-9)


def distances(x, loc, cov):
    d = x - loc
    return (d @ np.linalg.inv(cov) * d).sum(axis=1)


def estimate(x, keep=quality.KEEP):
    def concentrated(loc, cov):
        d = distances(x, loc, cov)
        return moments(x[d <= np.sort(d)[int(np.ceil(keep * len(x))) - 1]], quality.consistency(keep))

    middle = np.median(x, axis=0)
    spread = np.maximum(1.4826 * np.median(np.abs(x - middle), axis=0), quality.FLOORS)
    short = x[:, 0] <= middle[0]
    starts = [(middle, np.diag(spread**2)), moments(x, 1.0), *[moments(x[m], 1.0) for m in (short, ~short) if m.any()]]
    found = [concentrated(*concentrated(*s)) for s in starts]
    best = min(found, key=lambda f: np.linalg.slogdet(f[1])[1])
    for _ in range(quality.LAST_STEPS):
        best = min(best, concentrated(*best), key=lambda f: np.linalg.slogdet(f[1])[1])
    return best


def test_verdicts_of_small_groups(spark):
    rng = np.random.default_rng(11)
    rows, sizes = [], {("en", "five"): 5, ("en", "below"): 99, ("en", "enough"): 100, ("en", "many"): 400, ("fr", "few"): 30, (None, None): 40, ("de", "own"): 150}
    for (lang, source), n in sizes.items():
        longer = {"en": 0.0, "fr": 0.4, "de": 0.6, None: 0.2}[lang]
        for k in range(n):
            words = int(np.exp(4.6 + rng.normal() * 0.5)) + 12
            junk = k % 25 == 7
            rows.append((len(rows), lang, source, words, int(words * np.exp(1.5 + longer + 0.05 * rng.normal())), int(words * (0.9 if junk else 0.01 * rng.random())), int(rng.random() < 0.05), 0, junk))
    rows.append((len(rows), "en", "many", 4, 10, 0, 0, 0, False))
    n = np.array([r[3] for r in rows], float)
    counts = np.array([r[4:8] for r in rows], float)
    x = np.stack([np.log(n), np.log(counts[:, 0] / n), *[np.log1p(100 * counts[:, k] / n) for k in (1, 2, 3)]], axis=1)
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in quality.STATS) + ", junk boolean, x array<double>"
    stats = shared.stash(spark.createDataFrame([(*r, t.tolist()) for r, t in zip(rows, x, strict=True)], schema), "rows")
    got = {r.doc_id: r for r in quality.judged(stats, quality.fit(stats)).collect()}
    passes, known = n >= 10, {}
    group = [np.array([f(r) for r in rows], object) for f in (lambda r: f"{r[1]}|{r[2]}", lambda r: str(r[1]), lambda r: "")]
    for r in rows:
        model = None
        for level in (2, 1, 0):
            mine = (group[level] == group[level][r[0]]) & passes
            key = group[level][r[0]], level
            if key not in known:
                known[key] = estimate(x[mine])
            share = mine.sum() / (mine.sum() + quality.PRIOR)
            model = known[key] if model is None else [share * a + (1 - share) * b for a, b in zip(known[key], model, strict=True)]
        want = distances(x[r[0] : r[0] + 1], *model)[0]
        assert got[r[0]].base_failed == (r[3] < 10)
        assert abs(np.log(got[r[0]].distance + 1) - np.log(want + 1)) < 0.35, (r, got[r[0]].distance, want)
        if abs(want - quality.CUT) > 12:
            assert got[r[0]].kept == (r[3] >= 10 and want <= quality.CUT)
        assert got[r[0]].kept == (not r[8] and r[3] >= 10)


def test_a_small_group_decides_for_itself(spark):
    """Twelve documents of a source become others: their own estimate follows, and no verdict elsewhere moves."""
    rng = np.random.default_rng(2)

    def table(symbols):
        rows = []
        for k in range(612):
            words = int(np.exp(4.6 + rng.normal() * 0.4)) + 12
            mine = k >= 600
            share = symbols if mine and k < 611 else 0.12 if mine else 0.01 * rng.random()
            rows.append((k, "en", "small" if mine else f"s{k % 3}", words, int(words * np.exp(1.5 + 0.05 * rng.normal())), int(words * share), 0, 0))
        n, counts = np.array([r[3] for r in rows], float), np.array([r[4:8] for r in rows], float)
        x = np.stack([np.log(n), np.log(counts[:, 0] / n), *[np.log1p(100 * counts[:, k] / n) for k in (1, 2, 3)]], axis=1)
        stats = shared.stash(spark.createDataFrame([(*r, t.tolist()) for r, t in zip(rows, x, strict=True)], "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in quality.STATS) + ", x array<double>"), "rows")
        return {r.doc_id: (r.kept, r.distance) for r in quality.judged(stats, quality.fit(stats)).collect()}

    plain, other = table(0.005), table(0.12)
    moved = {k for k in plain if plain[k][0] != other[k][0]}
    assert 611 in moved and moved <= set(range(600, 612))
    assert not plain[611][0] and other[611][0]  # odd among the others, then one of them
    assert all(plain[k][0] for k in range(611)) and all(other[k][0] for k in range(600))


def test_no_document_passes_the_base_rules(spark):
    docs = spark.createDataFrame([(1, "few words", "en", "a", "own"), (2, None, None, None, "own"), (3, "", "en", None, "own")], "doc_id long, text string, lang string, source string, distance string")
    assert [r.kept for r in quality.verdicts(docs).collect()] == [False] * 3 and quality.passing(docs).count() == 0


def test_names_never_clash(spark):
    names = ["row", "x", "key", "key_", "loc0", "inv1", "distance", "kept", "base_failed", "q_k1", "q_key", "n", *quality.STATS]
    text = " ".join(f"word{k}" for k in range(30))
    docs = spark.createDataFrame([(i, text + str(i), "en", "a", *[f"own {n}" for n in names]) for i in range(12)], "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    out = quality.passing(docs)
    assert out.columns == docs.columns and sorted(out.collect()) == sorted(docs.collect())
