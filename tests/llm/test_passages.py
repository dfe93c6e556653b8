"""Suffix-array deduplication and the pipeline's stage of it against brute force."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from quillspark.llm import suffixes

WORDS = "a an the of over under house river mountain wanderer table window green quiet ever often slowly before".split()


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(90)) if rng.random() < 0.5 else "") for _ in range(n))


def left(rows, length, keep_first):
    """What is left of each row's text, by a table of all windows."""
    places = defaultdict(list)
    texts = [(r[1] or "").encode() for r in rows]
    keys = [(r[0] if r[0] is not None else 1 << 63, t) for r, t in zip(rows, texts, strict=True)]
    distinct = {}
    for k, t in zip(keys, texts, strict=True):
        distinct.setdefault(t, []).append(k)
    for t, owners in distinct.items():
        for a in range(len(t) - length + 1):
            places[t[a : a + length]].append((min(owners), a, len(owners)))
    out = []
    for (key, t) in zip(keys, texts, strict=True):
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            found = places[t[a : a + length]]
            if sum(n for _, _, n in found) < 2:
                continue
            first = min((k[0], a_) for k, a_, _ in found)
            if keep_first and first == (key[0], a):
                continue
            gone[a : a + length] = b"\1" * length
        out.append(bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore"))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    line, passage = text_of(rng, 12), text_of(rng, 70)
    texts = [text_of(rng, rng.randrange(1, 90)) for _ in range(30)]
    texts += [f"{text_of(rng, 40)} {line} {text_of(rng, 40)}" for _ in range(60)]  # a hot line
    texts += [f"{text_of(rng, 25)} {passage} {text_of(rng, 25)}" for _ in range(60)]  # a hot passage
    texts += ["ab" * 900, "z" * 700, "", None, passage, passage, passage, "é🙂" * 150]
    out = [(i, t) for i, t in enumerate(texts)]
    return [*out, (None, passage), (2, texts[2]), (2, texts[2])]


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("members", [None, 5])
def test_cut_equals_brute_force(spark, rows, keep_first, members):
    names = ["row", "k1", "k2", "id", "cuts", "n_bytes", "kept_text", "start", "q_one", "q_bytes", "later", "lead"]
    docs = spark.createDataFrame([(*r, *[f"own {n}" for n in names]) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)).repartition(3)
    got = suffixes.cut(docs, 120, keep_first, members).select("row.*", "kept_text").toDF(*docs.columns, "left_").collect()
    assert all(r[n] == f"own {n}" for r in got for n in names)
    want = left(rows, 120, keep_first)
    assert sorted((str(r.doc_id), r.text or "", r.left_ or "") for r in got) == sorted((str(r[0]), r[1] or "", w) for r, w in zip(rows, want, strict=True))


def test_stage_cuts_passages_of_over_50_words(spark):
    rng = random.Random(8)
    words = "some words from a rather plain language with many short ones and here the usual longer ones too".split()
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "s", "ly", "er"]) for _ in range(n))
    planted = [prose(n) for n in range(51, 61)]
    texts = {}
    for k, p in enumerate(planted):
        for j in range(3):
            texts[10 * k + j] = f"{prose(60)} {p} {prose(60)}"
        texts[10 * k + 5] = prose(150)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), i) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long, start long")
    out = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    assert len(out) == len(texts) and all(r.n_chars == len(r.text) and r.start == r.doc_id for r in out.values())
    for k, p in enumerate(planted):
        assert p in out[10 * k].text and out[10 * k].text == texts[10 * k]
        assert p[5:-5] not in out[10 * k + 1].text and p[5:-5] not in out[10 * k + 2].text
        assert out[10 * k + 5].text == texts[10 * k + 5]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert suffixes.cut(docs).count() == 0 and corpus_pipeline.repeated_passages(spark, docs, "").columns == docs.columns
