import base64
import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import archives, bytebpe, chat, jaccard, langid, mixing, quality, shared, suffixes, tokencount, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, copies int, n string"
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "Lambda", "mü"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base = [prose(rng, rng.randrange(3, 160)) for _ in range(25)]
    near = [" ".join(w if k % 60 != 31 else "CHANGED" for k, w in enumerate(b.split())) for b in base]
    passage = prose(rng, 80)
    texts = base + near + base[:6] + base[:3] + [f"{prose(rng, 30)}\n{passage}\n{prose(rng, 30)}" for _ in range(6)]
    texts += [None, "", "   \n", "one two", "ONE TWO", "x" * 3000, "日本語 🙂 é" * 40, prose(rng, 3000), "line\nline\nother\nline"]
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["hot"] * 5 + ["b", None]), None if t is None else len(t), "clash", 1, "clash") for i, t in enumerate(texts)]
    return [*out, out[0], (None, "a row without an id", "en", "b", 19, "clash", 1, "clash"), (500, "toward the same id", None, None, 1, "", 0, ""), (500, "another text of this id", None, None, 1, "", 0, "")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


# ------------------------------------------------------------ 1

def test_archives_round_trip(spark):
    rng = random.Random(2)
    html = [None, "", "short", "short", *["<p>é" + "x" * 200] * 3, "<p>" + prose(rng, 50)]
    pages = spark.createDataFrame([(i, f"http://h/{i} x" if i else None, h, "c") for i, h in enumerate(html)] + [(None, "http://n", html[4], "c")], "page_id long, url string, html string, digest string")
    got = {r.page_id: r for r in archives.archive_pages(pages).collect()}
    for i, h in enumerate(html):
        raw = (h or "").encode()
        first = min(j for j, o in enumerate(html) if (o or "").encode() == raw)
        again = len(raw) >= 100 and first != i
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None)
    assert got[None].record_type == "revisit" and got[None].refers_to == 4
    assert got[5].refers_to_record == got[4].record_id
    assert archives.archive_pages(pages.limit(0)).count() == 0


def test_arc_versions_and_errors():
    import gzip

    rec = {"url": "http://a/b", "ip": "1.2.3.4", "date": "20010203040506", "mime": "text/html", "block": b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\n\nmore", "key": "1"}
    for version in (1, 2):
        data = archives.arc_archive([rec, rec], version, "n.arc")
        for raw in (data, gzip.compress(data)):
            found = list(archives.parse_arc(raw))
            assert [f["block"] for f in found] == [rec["block"]] * 2 and found[0]["head"]["Archive-date"] == rec["date"]
        assert list(archives.parse_arc(data[:-10]))[-1]["error"]
    warc = archives.converted(found[0])
    one = next(archives.parse_warc(warc))
    assert one["block"] == rec["block"] and one["fields"]["warc-date"] == "2001-02-03T04:05:06Z" and one["fields"]["warc-payload-digest"] == archives.sha1_digest(b"body\n\nmore")


# ------------------------------------------------------------ 2

def test_language(spark, empty):
    rng = random.Random(3)
    alphabet = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    data = [(i, " ".join("".join(rng.choice(alphabet[lang]) for _ in range(5)) for _ in range(30)), lang) for i in range(120) for lang in [rng.choice(list(alphabet))]]
    data += [(1000, None, "aa"), (1001, "123 !", "bb"), (1002, "", None), (None, "abc abc", None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in data if i is not None and i < 1000)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and 0 <= got[None].score <= 1
    assert langid.identify(empty).count() == 0


# ------------------------------------------------------------ 3

def test_preferences(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "ho"), (1, 1, "assistant", "no"), (2, 0, "user", None), (4, 0, "assistant", "same"), (5, 0, "assistant", "same"), (None, 0, "user", "x"), (3, 0, None, "")]
    got = {r.conv_id: r for r in chat.format_preferences(chat.swapped_replies(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5}
    assert got[0].prompt == "<|user|>\nhi<|end|>\n" and got[0].chosen_text == "<|assistant|>\nyes<|end|>\n" and got[0].rejected_text == "<|assistant|>\nno<|end|>\n"
    (span,) = got[0].chosen_spans
    assert got[0].chosen_text[span.start : span.start + span.length] == "yes<|end|>"
    assert got[4].n_common == 1 and got[4].chosen_text == got[4].rejected_text == "" and not got[2].paired


# ------------------------------------------------------------ 4

def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def test_near_duplicates(docs, rows, empty):
    sets = [shingles(r[1]) for r in rows]
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                part[max(a, b)] = min(a, b)
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        least[root(i)].append(r[0])
    want = sorted((str(r[0]), len(sets[i]), str(min((x for x in least[root(i)] if x is not None), default=None))) for i, r in enumerate(rows))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.near_duplicates(docs).collect())
    assert got == want
    assert jaccard.near_duplicates(empty).count() == 0
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    groups = {root(i) for i in range(len(rows)) if sets[i]}
    assert kept.where("text rlike '[^ \\n]'").count() == len(groups)


@pytest.mark.parametrize(("block", "bucket"), [(1500, 1000), (6000, 1), (64 << 20, 1)])
def test_blocks_of_large_clusters(docs, monkeypatch, block, bucket):
    want = sorted(map(str, jaccard.near_duplicates(docs).collect()))
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    assert sorted(map(str, jaccard.near_duplicates(docs).collect())) == want


def test_links_outside_the_largest_component(spark, monkeypatch):
    """Chains and a hub in one candidate cluster, over many blocks."""
    rng = random.Random(2)
    base = prose(rng, 120).split()
    texts = [" ".join(base)]
    for k in range(40):  # a chain: each next text changes one more place, far texts are not linked
        words = texts[-1].split()
        words[(k * 7) % 120] = f"new{k}"
        texts.append(" ".join(words))
    other = texts[20].split()
    texts += [" ".join(other[:90] + prose(rng, 25).split()), prose(rng, 100)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    part = list(range(len(texts)))
    for _ in range(len(texts)):
        for i in range(len(texts)):
            for j in range(len(texts)):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    part[i] = part[j] = min(part[i], part[j])
    for block, bucket in [(64 << 20, 1000), (3000, 1), (3000, 1000)]:
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "BUCKET", bucket)
        assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == dict(enumerate(part))


def test_representatives_carry_clashing_names(spark):
    names = ["row", "k1", "k2", "id", "words", "least_id", "n", "root", "node", "name", "q_k1", "q_n", "q_id"]
    docs = spark.createDataFrame([(i, t, *[f"own {n}" for n in names]) for i, t in [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, "z y x w v u")]], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = jaccard.representatives(docs)
    assert out.columns == docs.columns and sorted(out.collect()) == sorted(docs.where("doc_id <> 2").collect())


# ------------------------------------------------------------ 5

def removed(texts, length):
    counts = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        edge = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                edge[i] += 1
                edge[i + length] -= 1
        out.append(np.cumsum(edge)[:-1] > 0)
    return out


def test_repeated_bytes():
    rng = np.random.default_rng(4)
    for trial in range(60):
        length = int(rng.integers(2, 40))
        texts = [bytes(rng.integers(97, 99 + trial % 5, int(rng.integers(1, 80))).astype(np.uint8)) for _ in range(6)]
        data = np.frombuffer(b"".join(texts), np.uint8)
        valid = np.concatenate([np.arange(len(t)) <= len(t) - length for t in texts])
        counts = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = [i + length <= len(t) and counts[t[i : i + length]] > 1 for t in texts for i in range(len(t))]
        assert suffixes.repeated(data, valid, np.ones(len(data), int), length)[0].tolist() == want


def test_suffix_dedup(docs, rows, empty):
    masks = removed([(r[1] or "").encode() for r in rows], 400)
    want = sorted((str(r[0]), len(m), int(m.sum()), len(suffixes.ranges(m)) // 2, hashlib.sha256(np.frombuffer((r[1] or "").encode(), np.uint8)[~m].tobytes()).hexdigest()) for r, m in zip(rows, masks, strict=True))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.deduplicated(docs).collect())
    assert got == want and sum(m.sum() for m in masks) > 0
    assert suffixes.deduplicated(empty).count() == 0


# ------------------------------------------------------------ 6, 7

def test_byte_bpe(docs, rows, empty):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bytebpe.digests(docs, path, P.PATTERN).collect())))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted(str((r[0], len(ids), sha(" ".join(map(str, ids)).encode()), sha((r[1] or "").encode()))) for r in rows for ids in [library.encode_ordinary(r[1] or "")])
    assert got == want
    assert bytebpe.digests(empty, path, P.PATTERN).count() == 0
    coder = bytebpe.ByteBpe(path, P.PATTERN)
    for text in ("".join(map(chr, range(1, 0x2FF))), "½ ²³ \x1c\x85\xa0 ǅ", "a" * 500, "<|endoftext|>"):
        assert coder.encode(text) == library.encode_ordinary(text) and coder.decode(coder.encode(text)) == text.encode()


def test_token_counts(docs, rows, empty, tmp_path):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted(str((r[0], len((r[1] or "").encode()), n, n > 4096)) for r in rows for n in [len(library.encode(r[1] or ""))])
    cache = str(tmp_path / "cache")
    for _ in range(2):  # misses, then hits
        assert sorted(str((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit)) for r in tokencount.count_tokens(docs, path, cache).collect()) == want
    stored = lambda c: docs.sparkSession.read.parquet(c).count()
    distinct = {r[1] or "" for r in rows}
    assert stored(cache) == len(distinct)
    half = tokencount.seeded_cache(docs, path)  # some of the contents are hits, the others are encoded
    assert stored(half) == sum(hashlib.sha256(t.encode()).digest()[0] < 128 for t in distinct) not in (0, len(distinct))
    assert sorted(str((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit)) for r in tokencount.count_tokens(docs, path, half).collect()) == want
    assert stored(half) == len(distinct)
    wrong = docs.sparkSession.read.parquet(half).withColumn("n_tokens", F.lit(7).cast("long"))  # hits come from the cache
    wrong.write.parquet(str(tmp_path / "wrong"))
    assert {r.n_tokens for r in tokencount.count_tokens(docs, path, str(tmp_path / "wrong")).collect()} == {7}
    assert tokencount.count_tokens(empty, path, str(tmp_path / "none")).count() == 0
    counter = tokencount.PieceCounter(path)
    odd = ["", " ", "\n\n a", "▁x ▁", "a\0b", "<s> </s>", "日本 🙂\t\tx", "".join(map(chr, range(1, 0x2FF)))]
    assert counter.divides and counter.counts(odd) == [len(library.encode(t)) for t in odd]


# ------------------------------------------------------------ 8

def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, rows, empty):
    got = sorted(str((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.base_failed)) for r in quality.verdicts(docs).collect())
    assert got == sorted(str((r[0], s, s[0] < 10 or 100 * s[4] > 20 * s[0])) for r in rows for s in [statistics(r[1] or "")])
    assert quality.verdicts(empty).count() == 0
    rng = random.Random(5)
    clean = [(i, prose(rng, rng.randrange(40, 200)), "en", "s") for i in range(300)]
    junk = [(1000 + i, " ".join(w + "###" for w in prose(rng, 80).split()), "en", "s") for i in range(20)]
    verdict = {r.doc_id: r.kept for r in quality.verdicts(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(verdict[r[0]] for r in clean) and not any(verdict[r[0]] for r in junk)


# ------------------------------------------------------------ 9

def test_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 8)).astype(np.float32)
    x[300:800] = x[300]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [1.0]), (None, [1.0] * 8)]
    got = collections.defaultdict(list)
    for r in vectors.search(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    exact, hits = x.astype(float), 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(s - exact[q] @ exact[v]) < 1e-9 and v != q for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        scores = exact @ exact[q]
        scores[q] = -np.inf
        hits += len({v for _, v, _ in found} & set(np.lexsort((np.arange(1500), -scores))[:20]))
    assert hits / (20 * len(got)) >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in vectors.search(few).collect()] == [(0, 1, 1, 0.5)]
    assert vectors.search(few.limit(0)).count() == 0


# ------------------------------------------------------------ 10, pipeline

def test_mixing(spark, docs, rows, empty):
    out = mixing.replicate(docs, total=400)
    assert out.columns == [*docs.columns, "copy_no", "n_copies", "shuffle_key"]
    names = ["row", "id", "q_s", "q_n", "q_pieces", "q_cdf", "q_source", "q_none", "pieces", "cdf", "rate"]
    marked = docs.select("doc_id", "source", "text", *[F.lit(f"own {n}").alias(n) for n in names])
    drawn = mixing.replicate(marked, total=400)
    assert drawn.columns[:-3] == marked.columns and all(r[n] == f"own {n}" for r in drawn.collect() for n in names)
    assert sorted(map(str, drawn.select("doc_id", "copy_no").collect())) == sorted(map(str, out.select("doc_id", "copy_no").collect()))
    long = spark.createDataFrame([(i, "a", "word " * 400_000) for i in range(4)], "doc_id long, source string, text string")
    assert all(len(r.text) == 2_000_000 for r in mixing.replicate(long, total=20).collect())
    again = mixing.replicate(docs, total=400)
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))
    assert 300 < out.count() < 500
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    by = {r.source: r.n for r in mixing.replicate(many, weights={"a": 1, "b": 1}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(by["a"] - 10000) < 400 and abs(by["b"] - 10000) < 400
    high = mixing.replicate(many.limit(50), weights={"a": 1, "b": 1}, total=50 * 300).count()
    assert abs(high - 15000) < 900
    assert mixing.replicate(empty).count() == 0


def test_pipeline(spark, docs, empty):
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        columns = kept.columns
        kept = shared.stash(stage(spark, kept, ""), name)
        if name != "byte_bpe":
            assert kept.columns == columns, name
    assert {"bpe_ids", "bpe_count"} < set(kept.columns)
    kept = empty
    for name, stage in corpus_pipeline.STAGES:
        kept = shared.stash(stage(spark, kept, ""), name)
    assert kept.count() == 0
