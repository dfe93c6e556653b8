"""The source divergence audit against whole dense tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, value long, rank int, n int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def expected(rows, least, top):
    docs = [(r[2] or "", r[3] or "", Counter(lower(w) for w in TERM.findall(r[1] or ""))) for r in rows]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, found in docs:
        df[lang].update(found.keys())
        counts[lang, source].update(found)
    out = []
    for lang in df:
        kept = [t for t, n in df[lang].items() if n >= least]
        sources = sorted({s for x, s, _ in docs if x == lang}, key=str.encode)
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        gap = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(gap(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def made(n, seed):
    rng = random.Random(seed)
    words = ["The", "the", "éCOLE", "Œuvre", "日本", "x1y", "a-b", "don't", "İ", "[x]"] + [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    text = lambda: rng.choice([" ", "\n", ", "]).join(words[min(int(rng.expovariate(0.02)), len(words) - 1)] for _ in range(rng.randrange(1, 90)))
    rows = [(i, rng.choice([None, ""]) if i % 17 == 0 else text(), rng.choice(["en"] * 4 + ["fr", "", None]), rng.choice(["hot"] * 5 + ["b", "c", "Z", "é", "", None]), "own", 1, 2, 3) for i in range(n)]
    return [*rows, *rows[:20], *[rows[1]] * 15, (n, "alone", "solo", "only", "", 0, 0, 0), (n + 1, "... 123", "none", "s1", "", 0, 0, 0), (n + 2, None, "none", "s2", "", 0, 0, 0), (n + 3, "z" * 200_000 + " the", "en", "b", "", 0, 0, 0)]


@pytest.mark.parametrize(("n", "least", "top"), [(400, 10, 10), (60, 2, 3)])
def test_values_and_ranks_are_exact(spark, n, least, top):
    rows = made(n, n)
    got = divergence.divergence(spark.createDataFrame(rows, SCHEMA).repartition(5), least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == expected(rows, least, top)


def test_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_terms_are_those_of_the_pattern():
    texts = ["The éCOLE, x1y", "", "a", "B", "日本 [ÀB]", "...", "tail"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    found, text = divergence.terms(np.frombuffer(data, np.uint8), offsets)
    assert list(zip(text.tolist(), found.to_pylist(), strict=True)) == [(k, lower(w)) for k, t in enumerate(texts) for w in TERM.findall(t)]


def test_the_sketch_never_underestimates_and_drops_most_rare_terms(spark):
    rng = random.Random(3)
    rows = [(f"common{chr(97 + i % 3)} " + " ".join("".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(30)), "en", "s") for i in range(300)]
    frame = spark.createDataFrame(rows, "text string, lang string, source string").repartition(6)
    for bits, most in ((18, 5), (6, 10**9)):  # cells for all, and far too few
        table = divergence.sketch(frame, 10, bits)
        values = pa.array(sorted({w for r in rows for w in TERM.findall(r[0])}), pa.large_string())
        keys = divergence.kernels.mix(divergence.string_hashes(values) + divergence.kernels.mix(divergence.string_hashes(pa.array(["en"], pa.large_string()))))
        passed = set(np.asarray(values)[divergence.possible(table, keys, bits)])
        assert {"commona", "commonb", "commonc"} <= passed and len(passed) < most
    assert frame.where(F.col("text").contains("commona")).count() == 100
