"""The language model against plain counts, a loop over tokens, and sums over its whole vocabulary."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import maxent

SCHEMA = "doc_id long, text string, n long, name string, row string, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    tongues = [[f"{a}{b}{c}" for a in x for b in "aeiou" for c in "nrst"] for x in ("bcdfg", "jklmp")]
    out = []
    for i in range(420):
        tongue = tongues[i % 2]
        text = " ".join(tongue[min(int(rng.expovariate(0.08)), len(tongue) - 1)] for _ in range(rng.randrange(1, 120)))
        out.append((i, text + (f" Only{i}É." if i % 3 == 0 else ""), 1, "own", "own", "own"))
    return [*out, *out[:30], *[out[5]] * 12, (500, None, 0, "", "", ""), (501, "", 0, "", "", ""), (502, " \n\t", 0, "", "", ""), (503, "w" * 70_000 + " The END", 0, "", "", ""), (None, "without an id", 0, "", "", ""), (504, "ban " * 40_000, 0, "", "", "")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("head", [1 << 18, 9])
def test_counts_base_scores_and_gain(docs, rows, head):
    train = Counter()
    for i, t, *_ in rows:
        if not held(i):
            train.update(words(t))
    n, v = sum(train.values()), len(train)
    want = []
    for i, t, *_ in rows:
        w = words(t)
        want.append((i, held(i), len(w), sum(train[x] > 0 for x in w), n, sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w)))
    got = maxent.scores(docs, head=head)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    found = got.collect()
    key = lambda r: (r[0] is not None, *r[:1], r[2])
    assert len(found) == len(want)
    for a, b in zip(sorted(map(tuple, found), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] < 0
    apart = [r for r in found if r.held_out]
    assert len(apart) > 40 and sum(r.score for r in apart) > sum(r.base_score for r in apart) * 0.97
    assert len({r.score for r in found if r.doc_id == 5}) == 1


def test_scores_are_those_of_a_loop_and_probabilities_add_up(spark, docs, rows):
    texts = docs.where(~maxent.held_out()).select("text", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(maxent.ROUNDS)).alias("fold"))
    counts = maxent.word_counts(texts)
    model = maxent.train(texts, counts)
    known = {np.int64(r["name"]).astype(np.uint64): (r["code"], r["n"]) for r in counts.collect()}
    assert np.abs(model.weights).max() > 0.1

    def chance(before, name, code):
        mixed = []
        for k, distances in enumerate(maxent.FEATURES):
            h = np.array([k + 1], np.uint64)
            for d in distances:
                h = maxent.kernels.mix(h + (before[-d] if d <= len(before) else maxent.START))
            mixed.append(int(h[0]) >> (64 - model.bits))
        z = (sum(model.weights[r].astype(float) for r in mixed) + model.bias).astype(float)
        share = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        if name in model.singles:
            return share[list(model.singles).index(name)]
        kind = model.shape[code]
        return share[kind] * (known.get(name, (0, 0))[1] + 1) / 10 ** model.within[kind]

    got = {r.doc_id: r.score for r in maxent.scores(docs).collect()}
    for i, text in ((7, rows[7][1]), (12, rows[12][1]), (501, "")):
        _, names, codes, _ = next(maxent.tokens(pa.array([text])))
        total = sum(math.log10(chance(list(names[:k]), names[k], codes[k])) for k in range(len(names)))
        assert got[i] == pytest.approx(total, rel=1e-4)
    before = list(next(maxent.tokens(pa.array(["ban ben"])))[1][:2])
    unseen = sum(chance(before, np.uint64(k), int(np.flatnonzero(model.shape == kind)[0])) for k, kind in enumerate(range(len(model.singles), len(model.bias))))
    assert sum(chance(before, w, code) for w, (code, _) in known.items()) + unseen == pytest.approx(1, abs=1e-5)


def test_nothing_to_learn_from_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", 0, "", "", ""), (2, None, 0, "", "", "")], SCHEMA)
    found = {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in maxent.scores(docs, F.lit(True)).collect()}
    assert found == {1: (True, 3, 0, 0, 0.0), 2: (True, 1, 0, 0, 0.0)}
    assert maxent.scores(docs.limit(0)).collect() == []
