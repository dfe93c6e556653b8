"""Language model scoring: a hashed maximum-entropy model with class-factored softmax.

The probability of a word is that of its class, given the words before it, times that of the word in its class. Frequent
words are classes by themselves; all others are in classes by their last two bytes, and each of these has a place for words
that training did not see. Context features (the words before, alone, in a pair, and with words skipped) are hashed to the
rows of one table of weights; weights are fitted by gradients that tasks sum over their documents, a fold of the training
documents in each round. Counts of rare words never meet in one place: texts are joined to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import kernels
from quillspark.llm.shared import Scratch, stash

#: Frequent words that are classes by themselves, classes of all others, rows of the table of weights (a power of two).
SINGLES, SHAPES, BITS = 8, 24, 15
#: Rounds of training (each training document is in one), step width, and the count that steadies rare features' steps.
ROUNDS, STEP, STEADY = 4, 0.5, 5.0
#: Frequent words whose counts are broadcast; texts are joined to the counts of the others.
HEAD = 1 << 18
#: Tokens that are scored at a time, and different words that a task holds before it sends their counts on.
BLOCK, HELD = 1 << 15, 1_000_000
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Context features by distances: previous word, previous two, and words with one, two and three skipped.
FEATURES = [(1,), (1, 2), (2,), (3,), (4,)]
_END_CODE = 10 << 8
_CHUNK = 256  # rows of weights in a record


def tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Over runs of whole texts: the first text, all tokens' hashes and last two bytes, and each text's first token.

    Words have only A-Z made small; every text has one more token, its end. A null text is an empty one.
    """
    for lo, hi, data, offsets in kernels.texts(column):
        hashes, starts, solid = kernels.words(data, offsets, lower=True)
        first, final = kernels.spans(solid, offsets)
        low = kernels.LOWER[data]
        code = low[final - 1].astype(np.int64) << 8 | np.where(final - first > 1, low[np.maximum(final - 2, 0)], 0) if len(final) else np.zeros(0, np.int64)
        n = hi - lo
        at = np.concatenate([[0], np.cumsum(np.diff(starts) + 1)])
        where = np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(starts))
        names, codes = np.full(at[-1], END), np.full(at[-1], _END_CODE, np.int64)
        names[where], codes[where] = hashes, code
        yield lo, names, codes, at


def rows_of(names: np.ndarray, place: np.ndarray, begin: int, end: int, bits: int) -> list[np.ndarray]:
    """The rows of weights of the tokens ``begin`` to ``end``, for each feature; ``place`` is a token's number in its text."""
    before = {}
    for k in {d for f in FEATURES for d in f}:
        w = names[np.maximum(np.arange(begin, end) - k, 0)]
        w[place[begin:end] < k] = START
        before[k] = w
    out = []
    for n, distances in enumerate(FEATURES):
        mixed = np.full(end - begin, np.uint64(n + 1))
        for d in distances:
            mixed = kernels.mix(mixed + before[d])
        out.append((mixed >> np.uint64(64 - bits)).astype(np.int64))
    return out


@dataclass
class Model:
    """``singles`` are sorted hashes, classes by themselves; ``shape`` the class of a word's last two bytes; ``within`` the
    log10 of what a class's counts are divided by; ``bias`` and ``weights`` of the classes."""

    singles: np.ndarray
    shape: np.ndarray
    within: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    bits: int

    def classes(self, names: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out = self.shape[codes]
        if len(self.singles):
            at = np.minimum(np.searchsorted(self.singles, names), len(self.singles) - 1)
            out = np.where(self.singles[at] == names, at, out)
        return out.astype(np.int64)

    def weighed(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """What each class weighs, a line for each token, and the lines' sums. Weights have moved by STEP a round at most, so
        nothing overflows."""
        z = np.zeros((len(rows[0]), len(self.bias)), np.float32)  # of numpy's own type: sums over one that was unpickled are slow
        for r in rows:
            z += np.take(self.weights, r, axis=0)
        z += self.bias
        np.exp(z, out=z)
        return z, z.sum(axis=1)


def _blocks(model: Model, names: np.ndarray, codes: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    place = np.arange(len(names)) - np.repeat(at[:-1], np.diff(at))
    for begin in range(0, len(names), BLOCK):
        end = min(begin + BLOCK, len(names))
        yield begin, end, rows_of(names, place, begin, end, model.bits), model.classes(names[begin:end], codes[begin:end])


def word_counts(texts: DataFrame) -> DataFrame:
    """``name, code, n``: the tokens' hashes, last two bytes and occurrences, combined in each task before the shuffle."""

    def combined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names, codes, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        found, first, which = np.unique(names, return_index=True, return_inverse=True)
        return found, codes[first], np.bincount(which, weights=n).astype(np.int64)

    def send(part: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        table = pa.table([pa.array(part[0].view(np.int64)), pa.array(part[1].astype(np.int32)), pa.array(part[2])], names=["name", "code", "n"])
        yield from table.to_batches(100_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        for batch in batches:
            for _, names, codes, _ in tokens(batch.column("text")):
                found, first, n = np.unique(names, return_index=True, return_counts=True)
                parts.append((found, codes[first], n))
                if sum(len(p[0]) for p in parts) > HELD:
                    parts = [combined(parts)]
                    if len(parts[0][0]) > HELD // 2:
                        yield from send(parts.pop())
        if parts:
            yield from send(combined(parts))

    return texts.mapInArrow(count, "name long, code int, n long").groupBy("name").agg(F.min("code").alias("code"), F.sum("n").alias("n"))


def fresh(counts: DataFrame, singles: int = SINGLES, shapes: int = SHAPES, bits: int = BITS) -> Model:
    """A model whose classes have their frequencies and no context yet. Only the most frequent words and the sums by last two
    bytes (65,536 rows at most) reach the driver."""
    top = counts.orderBy(F.col("n").desc(), "name").limit(singles).select("name", "n").collect()
    alone = {np.int64(r["name"]).astype(np.uint64): r["n"] for r in top}
    names = np.array(sorted(alone), np.uint64)
    n, v = np.zeros(1 << 16), np.zeros(1 << 16)
    for r in counts.where(~F.col("name").isin([r["name"] for r in top])).groupBy("code").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        n[r["code"]], v[r["code"]] = r["n"], r["v"]
    # Neighbours in the order of last bytes share a class, so that classes have about equal shares of the tokens.
    middle = np.cumsum(n) - n / 2
    part = np.minimum((middle / max(n.sum(), 1) * shapes).astype(np.int64), shapes - 1)
    size = np.concatenate([[alone[x] for x in names], np.bincount(part, weights=n, minlength=shapes)])
    words = np.bincount(part, weights=v, minlength=shapes)
    within = np.concatenate([np.zeros(len(names)), np.log10(size[len(names) :] + words + 1)])
    bias = np.log((size + 1) / (size.sum() + len(size))).astype(np.float32)
    return Model(names, len(names) + part, within, bias, np.zeros((1 << bits, len(size)), np.float32), bits)


def gradient(texts: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of each feature with each class, observed and expected under ``model``, summed over all ``texts``.

    A task sums in tables of the weights' size and sends them in chunks; each chunk is summed by itself. Four tasks' work
    is done by one, since a round reads one document in ROUNDS.
    """
    shape = model.weights.shape
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (rows, width) = shared.value, shape
        seen, expected, here = np.zeros(rows * width), np.zeros(rows * width), np.zeros(rows * width, np.float32)
        any_ = False
        for batch in batches:
            for _, names, codes, at in tokens(batch.column("text")):
                any_ = True
                here[:] = 0  # small numbers are summed apart, so that large ones don't swallow them
                for _, _, features, classes in _blocks(own, names, codes, at):
                    share, whole_ = own.weighed(features)
                    share /= whole_[:, None]
                    for r in features:
                        np.add.at(seen, r * width + classes, 1.0)
                        np.add.at(here, (r[:, None] * width + np.arange(width)).ravel(), share.ravel())
                expected += here
        if any_:
            seen, expected = seen.reshape(rows, width).astype("<f4"), expected.reshape(rows, width)
            for k in range(0, rows, _CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([seen[k : k + _CHUNK].tobytes()], pa.binary()), pa.array([expected[k : k + _CHUNK].astype("<f4").tobytes()], pa.binary())], names=["chunk", "seen", "expected"])

    def total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [0.0, 0.0]
        for batch in batches:
            for k, name in enumerate(("seen", "expected")):
                for part in batch.column(name).to_pylist():
                    out[k] = out[k] + np.frombuffer(part, "<f4").astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), *[pa.array([x.astype("<f8").tobytes()], pa.binary()) for x in out]], names=["chunk", "seen", "expected"])

    columns = "chunk int, seen binary, expected binary"
    fewer = texts.coalesce(max(1, texts.rdd.getNumPartitions() // ROUNDS))
    seen, expected = np.zeros(shape), np.zeros(shape)
    for r in fewer.mapInArrow(sums, columns).groupBy("chunk").applyInArrow(total, columns).toLocalIterator():
        for table, part in ((seen, r["seen"]), (expected, r["expected"])):
            table[r["chunk"] : r["chunk"] + _CHUNK] = np.frombuffer(bytes(part), "<f8").reshape(-1, shape[1])
    shared.unpersist()
    return seen, expected


def train(texts: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> Model:
    """A model of ``texts`` (``fold`` says in which round a text is used), whose tokens' counts are ``counts``.

    A step moves each weight along its gradient, scaled by the larger of its observed and expected occurrences.
    """
    model = fresh(counts)
    for k in range(rounds):
        seen, expected = gradient(texts.where(F.col("fold") == k).select("text"), model)
        model.weights += (STEP * (seen - expected) / (np.maximum(seen, expected) + STEADY)).astype(np.float32)
    return model


def held_out(fold: int = 2, folds: int = 7) -> Column:
    """Whether a row of ``documents`` is kept from training; one without an id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the most frequent words, ``most`` at most: those from a bound on, which a histogram of
    the counts' logarithms gives (some hundred bars, so that no sort sends each task's candidates to the driver)."""
    bar = F.floor(F.log2("n") * 32).cast("int")
    bound, room = None, most
    for r in counts.groupBy(bar.alias("bar")).count().orderBy(F.col("bar").desc()).collect():
        room -= r["count"]
        if room < 0:
            break
        bound = r["bar"]
    if bound is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table = counts.where(bar >= bound).select("name", "n").toArrow()
    names, n = (np.asarray(table.column(c).combine_chunks()) for c in ("name", "n"))
    order = np.argsort(names.view(np.uint64))
    return names.view(np.uint64)[order], n[order]


def _scored(rows: DataFrame, model: Model, head: np.ndarray, head_n: np.ndarray) -> DataFrame:
    """For each row: tokens, what the model and frequent words' counts give, and its rare words with their numbers."""
    shared = rows.sparkSession.sparkContext.broadcast((model, head, head_n))
    names_ = ["doc_id", "held_out", "row", "n_tokens", "n_head", "log_head", "log_alone", "log_class", "rare", "rare_n"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, head, head_n = shared.value
        log_n = np.log10(head_n + 1.0)
        for batch in batches:
            for lo, names, codes, at in tokens(batch.column("text")):
                n = len(at) - 1
                line = np.repeat(np.arange(n), np.diff(at))
                gain, alone = np.zeros(len(names)), np.zeros(len(names), bool)
                for begin, end, features, classes in _blocks(own, names, codes, at):
                    share, whole_ = own.weighed(features)
                    gain[begin:end] = np.log10(share[np.arange(end - begin), classes]) - np.log10(whole_) - own.within[classes]
                    alone[begin:end] = classes < len(own.singles)
                found, which, times = np.unique(names, return_inverse=True, return_counts=True)
                spot = np.minimum(np.searchsorted(head, found), max(len(head) - 1, 0))
                hit = head[spot] == found if len(head) else np.zeros(len(found), bool)
                logs = np.where(hit, log_n[spot], 0.0)[which] if len(head) else np.zeros(len(names))
                by = lambda weights: np.bincount(line, weights=weights, minlength=n)
                rare = ~hit[which]
                pairs, times = np.unique(line[rare] * (len(found) + 1) + which[rare], return_counts=True)
                owner = pairs // (len(found) + 1)
                offsets = pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, v) for v in (pa.array(found[pairs % (len(found) + 1)].view(np.int64)), pa.array(times.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(lo, n) for c in names_[:3]], pa.array(np.diff(at)), pa.array(by(hit[which].astype(float)).astype(np.int64)), pa.array(by(logs)), pa.array(by(np.where(alone, logs, 0.0))), pa.array(by(gain)), *lists], names=names_)

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, row long, n_tokens long, n_head long, log_head double, log_alone double, log_class double, rare array<long>, rare_n array<int>")


def scores(docs: DataFrame, apart: Column | None = None, head: int = HEAD) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row of ``docs``.

    The model learns from the rows that are not held out (``apart``, by default a fold by the checksum of the id). Texts are
    read whole; a null text is an empty one, which is the token of its end alone. ``score`` is the sum of log10 probabilities,
    of the end too; ``base_score`` that of single words with one added to each count. Equal texts get equal scores, and
    repeated rows train as often as they occur; a row without an id trains. Where nothing trains, no word is known.
    An empty table gives no rows. Other columns are ignored. Words are named by 64-bit hashes.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    mark = held_out() if apart is None else F.coalesce(apart, F.lit(False))
    texts = docs.select("doc_id", mark.alias("held_out"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(ROUNDS)).alias("fold"))
    train_texts = texts.where(~F.col("held_out")).select("text", "fold")
    counts = scratch.put(word_counts(train_texts), "words")
    all_ = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    model = train(train_texts, counts)
    names, n = frequent(counts, head)
    found = scratch.put(_scored(texts.drop("fold").withColumn("row", F.monotonically_increasing_id()), model, names, n), "scored")
    rare = found.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("w")).select("row", F.col("w.rare").alias("name"), F.col("w.rare_n").alias("times"))
    met = rare.join(counts.select("name", "n"), "name").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("log_rare"), F.sum("times").alias("n_rare"))
    whole = found.drop("rare", "rare_n").join(met, "row", "left")
    log_rare = F.coalesce("log_rare", F.lit(0.0))
    base = F.col("log_head") + log_rare - F.col("n_tokens") * F.log10(F.lit(float(all_["n"] + all_["v"] + 1)))
    out = stash(whole.select("doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(all_["n"]).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("log_class") + F.col("log_head") - F.col("log_alone") + log_rare).alias("score")), "scores")
    scratch.clear()
    return out
