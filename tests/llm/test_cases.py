"""Nulls, empty and long inputs, ties, repeats, clashing names: cases of the operators that the other tests leave out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import archives, bytebpe, chat, langid, shared, tokencount, vectors


def marked(df, *names):
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in names])


def test_archives_of_large_pages_and_clashing_names(spark):
    rows = [(1, "http://a", "<p>" + "x" * 5_000_000), (2, "http://b", "<p>" + "x" * 5_000_000), (3, "", None)]
    pages = marked(spark.createDataFrame(rows, "page_id long, url string, html string"), "arc_url", "digest", "block", "payload_bytes", "content", "name", "error")
    got = {r.page_id: (r.record_type, r.payload_bytes, r.refers_to) for r in archives.archive_pages(pages).collect()}
    assert got == {1: ("response", 5_000_003, None), 2: ("revisit", 5_000_003, 1), 3: ("response", 0, None)}


LETTERS = {"aa": "abcde", "bb": "fghij"}


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(4)
    text = lambda lang: " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(5)) for _ in range(25))
    return spark.createDataFrame([(i, text(lang), lang) for i in range(160) for lang in ["aa" if i % 2 else "bb"]], "doc_id long, text string, lang string")


def test_language_rejects_what_is_far_from_every_centroid(spark, languages):
    model = langid.train(languages)
    far = ["язык которого никто не учил " * 5, "日本語の文章です" * 10, "مرحبا بالعالم الجديد " * 5]
    near = [r.text for r in languages.limit(20).collect()]
    found = langid.predict(marked(spark.createDataFrame([(t,) for t in far + near], "text string"), "held_out", "owner"), model).collect()
    assert {r.text: r.rejected for r in found} == {t: t in far for t in far + near} and all(r.owner == "own owner" for r in found)


def test_language_ties_long_texts_and_replaced_names(spark, languages):
    model = langid.train(languages)
    tie = "abcde fghij"
    rows = [tie, tie, "abcde " * 400_000, None, "12 34"]
    docs = spark.createDataFrame([(t, "x", 2.0) for t in rows], "text string, lang_pred string, score double")  # columns of the result's names are replaced
    got = [(r.lang_pred, r.score) for r in langid.predict(docs, model).collect()]
    assert got[0] == got[1] and got[2][0] == "aa" and [g[0] for g in got[3:]] == ["und"] * 2


def test_language_learns_nothing_from_an_empty_table(spark, languages):
    model = langid.train(languages.limit(0))
    assert [r.lang_pred for r in langid.predict(languages.limit(2), model).collect()] == ["und"] * 2


def test_preferences_empty_long_and_clashing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.format_preferences(chat.swapped_replies(spark.createDataFrame([], schema))).count() == 0
    long = "word " * 200_000
    turns = spark.createDataFrame([(0, 0, "user", long), (0, 1, "assistant", long), (0, 1, "assistant", "tie"), (1, 0, "assistant", "b"), (1, 0, "assistant", "b")], schema)
    got = {r.conv_id: r for r in chat.format_preferences(chat.swapped_replies(marked(turns, "turns", "reply", "other", "paired"))).collect()}
    assert got[0].prompt.startswith("<|user|>\n" + long) and len(got) == 2 and got[1].paired
    pairs = marked(turns.limit(1).select("conv_id"), "kept", "q")
    sides = F.array(F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.lit("x").alias("text")))
    out = chat.format_preferences(pairs.withColumn("chosen", sides).withColumn("rejected", F.lit(None).cast("array<struct<turn:bigint,role:string,text:string>>"))).first()
    assert out.kept == "own kept" and out.chosen_text == "<|assistant|>\nx<|end|>\n" and out.rejected_text == ""


def test_neighbours_of_equal_vectors_and_repeated_ids(spark):
    equal = marked(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)], "vec_id long, embedding array<double>"), "leaf", "block", "bundle", "v", "q", "score", "rank")
    got = [tuple(r) for r in vectors.search(equal).orderBy("query_id", "rank").collect()]
    assert got[:20] == [(0, k, k, 5.0) for k in range(1, 21)] and got[20:] == [(20, k + 1, k, 5.0) for k in range(20)]  # ties to the smaller id
    again = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [3.0]), (1, [3.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in vectors.search(again).orderBy("rank").collect()] == [(0, 1, 1, 3.0), (0, 2, 1, 2.0), (0, 3, 2, 1.0)]


def test_equal_vectors_have_equal_scores_wherever_they_stand(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(701, 64))
    for k in range(6):
        x[rng.permutation(701)[:50]] = x[k]
    got = {}
    for r in vectors.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q, found in got.items():
        scores = (x * x[q]).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(701), -scores)) if i != q][:20]
        found.sort()
        assert [v for _, v, _ in found] == want  # of equal vectors those with the smaller ids, in order
        assert all(abs(s - scores[v]) < 1e-12 for _, v, s in found)
        assert len({s for _, _, s in found}) == len({x[v].tobytes() for _, v, _ in found})


def test_texts_whose_names_clash_pass_through_the_encoder(spark):
    import public_tokenizers as P

    docs = marked(spark.createDataFrame([(1, "ab c"), (2, None)], "doc_id long, text string"), "ids", "found", "line")
    out = bytebpe.encode_texts(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert [r.line for r in out.collect()] == ["own line"] * 2 and [r.bpe_ids for r in out.orderBy("doc_id").collect()][1] == []


def test_counts_ignore_clashing_columns(spark, tmp_path):
    import public_tokenizers as P

    docs = marked(spark.createDataFrame([(1, "one two"), (1, "one two"), (2, "three " * 200_000), (None, None)], "doc_id long, text string"), "content", "content_digest", "n_tokens", "n_bytes", "tokenizer_digest")
    got = tokencount.count_tokens(docs, P.path("piece_bpe_32k.model"), str(tmp_path / "c")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.over_limit) for r in got) == [("1", 7, False), ("1", 7, False), ("2", 1_200_000, True), ("None", 0, False)]


def test_pipeline_cases(spark):
    """Nulls in any column, empty and very long texts, repeated rows and clashing names go through all stages."""
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choice(["river", "stone", "winter", "over", "the", "a", "quiet"]) + str(rng.randrange(99)) for _ in range(n))
    texts = [prose(rng.randrange(20, 90)) for _ in range(40)] + [prose(4_000), None, "", "few words"]
    rows = [(i, t, "en" if i % 3 else None, "web" if i % 2 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, prose(30), None, None, None), (77, rows[5][1], "en", "web", 5)]
    names = ["row", "k1", "key", "cuts", "copy", "n", "bin", "root", "least"]
    docs = marked(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), *names)
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = shared.stash(stage(spark, docs, ""), name)
        if name != "byte_bpe":
            assert docs.columns == columns
        assert all(r[n] == f"own {n}" for r in docs.collect() for n in names)
        if name == "near_duplicates":
            kept = [r.doc_id for r in docs.collect()]
            assert kept.count(3) == 1 and 77 not in kept and {r.doc_id for r in docs.collect()} >= set(range(40))
    assert np.all([r.bpe_count > 0 for r in docs.collect()])
