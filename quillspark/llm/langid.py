"""Language identification: nearest of several centroids per language, by cosine of TF-IDF n-gram vectors."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import small, stash

#: Cells of an n-gram vector, centroids of a language, labelled documents per language and in all that a fit may use.
CELLS, CENTROIDS, PER_LANGUAGE, IN_ALL = 4096, 3, 400, 6000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """True for each code point that is a letter."""
    return np.array([unicodedata.category(chr(c))[0] == "L" if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed 1- to 3-grams of lower-cased letters (all else is one blank), and whether there is a letter."""
    parts = [t.lower() for t in texts]
    codes = np.frombuffer("\0\0".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum([len(p) + 2 for p in parts])])
    letter = _letters()[codes]
    c = np.where(letter, codes, 0).astype(np.uint32)
    owner = np.repeat(np.arange(len(parts), dtype=np.int64) * CELLS, np.diff(at))[: len(c)]
    total = np.zeros(len(parts) * CELLS, np.int64)
    any_letter = np.zeros(len(c), bool)
    h = np.full(len(c), 2166136261, np.uint32)
    for k in range(3):
        n = len(c) - k
        if n <= 0:
            break
        h = (h[:n] ^ c[k:]) * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
        any_letter = any_letter[:n] | letter[k:]
        total += np.bincount(owner[:n][any_letter] + ((h * np.uint32(2246822519)) >> np.uint32(20))[any_letter], minlength=len(total))
    sums = np.concatenate([[0], np.cumsum(letter)])
    has = sums[np.minimum(at[1:], len(c))] > sums[np.minimum(at[:-1], len(c))]
    return total.reshape(len(parts), CELLS), has


def runs(texts: list[str], limit: int = 1 << 18) -> Iterator[list[str]]:
    """Lists of whole texts of about ``limit`` characters, at most 128 texts."""
    held: list[str] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= limit or len(held) >= 128:
            yield held
            held, size = [], 0
    if held:
        yield held


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        w = np.sqrt(counts, dtype=np.float32) * self.idf
        return w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9)

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """Language, cosine to its nearest centroid, and whether that is too far for the language."""
        counts, has = vectors(texts)
        if not self.languages:
            return [(UNKNOWN, 0.0, True)] * len(texts)
        cosine = self.weigh(counts) @ self.centroids.T
        best = cosine.argmax(axis=1)
        out = []
        for i, b in enumerate(best):
            score = float(min(max(cosine[i, b], 0.0), 1.0))
            out.append((self.languages[self.owner[b]], score, score < self.least[self.owner[b]]) if has[i] else (UNKNOWN, 0.0, True))
        return out


def _clusters(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means: unit centroids."""
    k = min(k, len(x))
    chosen = [int(rng.integers(len(x)))]
    for _ in range(k - 1):  # farthest first
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    c = x[chosen]
    for _ in range(12):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def _has_letter() -> Column:
    """Whether ``text`` has a letter, by the classes that ``vectors`` uses; only texts without a plain one go to Python."""

    @F.pandas_udf("boolean")
    def other(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t is not None and any(map(str.isalpha, t))).astype(bool)

    plain = F.col("text").rlike("[A-Za-z]")
    return plain | other(F.when(~plain, F.col("text")))


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, in_all: int = IN_ALL, centroids: int = CENTROIDS) -> Model:
    """Fit on at most ``per_language`` different texts of each language and ``in_all`` in all, chosen by a hash of the text.

    ``labelled`` has ``text`` and a non-null ``lang``. The choice keeps the different texts with a letter that have the
    smallest hashes per language: first the hashes alone are made distinct and ranked, then the texts up to the last
    hash needed are made distinct and ranked, so copies take one place and few texts are shuffled (row-number limits
    are cut per task before they shuffle, so a language with most of the rows makes no large group). Only count vectors
    of the chosen texts reach the driver. A language's rejection distance is half the least cosine of its own training
    texts.
    """
    hashed = labelled.where("text is not null and lang is not null").where(_has_letter()).select("text", "lang").withColumn("h", F.xxhash64("text"))
    some = hashed.select("lang", "h").distinct().withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= per_language)
    last = stash(some.groupBy("lang").agg(F.max("h").alias("last")), "langid")
    usable = hashed.join(small(last), "lang").where("h <= last").select("text", "lang", "h").distinct()
    order = Window.partitionBy("lang").orderBy("h", "text")
    chosen = usable.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).orderBy("k", "h", "lang").limit(in_all)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, at = batch.column("lang").to_pylist(), 0
            for some in runs(batch.column("text").to_pylist()):
                v, has = vectors(some)
                yield pa.RecordBatch.from_pydict({"lang": langs[at : at + len(some)], "v": [x.astype(np.uint32).tobytes() for x in v], "has": has.tolist()})
                at += len(some)

    rows = chosen.select("text", "lang").repartition(8).mapInArrow(count, "lang string, v binary, has boolean").where("has").collect()  # at most in_all rows
    if not rows:
        return Model([], np.zeros(CELLS, np.float32), np.zeros((0, CELLS), np.float32), np.zeros(0, int), np.zeros(0))
    rows.sort(key=lambda r: (r["lang"], r["v"]))
    counts = np.stack([np.frombuffer(r["v"], np.uint32) for r in rows])
    names = sorted({r["lang"] for r in rows})
    label = np.array([names.index(r["lang"]) for r in rows])
    idf = (np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    model = Model(names, idf, np.zeros((0, CELLS), np.float32), np.zeros(0, int), np.zeros(len(names)))
    x = model.weigh(counts)
    rng = np.random.default_rng(11)
    made = [_clusters(x[label == i], centroids, rng) for i in range(len(names))]
    model.centroids = np.concatenate(made).astype(np.float32)
    model.owner = np.concatenate([np.full(len(c), i) for i, c in enumerate(made)])
    model.least = np.array([0.5 * float((x[label == i] @ made[i].T).max(axis=1).min()) for i in range(len(names))])
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred, score, rejected`` from the whole ``text``; a map over rows.

    ``lang_pred`` is a learned language, or ``und`` for a null text or one without a letter (or if nothing was
    learned). Columns of those three names are replaced, others pass unchanged. Of centroids at one distance the first
    language in alphabetical order is taken. ``rejected`` marks texts farther from every centroid of that language than its rejection distance.
    """
    from pyspark.sql import types as T

    docs = docs.drop("lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r for some in runs(pc.fill_null(batch.column("text"), "").to_pylist()) for r in shared.value.predict(some)]
            lang, score, out = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([bool(x) for x in out], pa.bool_())], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def held_out(doc_id: Column) -> Column:
    """Every fourth document by the CRC-32 of its id as text; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for each row; learned from the rows that aren't held out."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(rows.where("not held_out"))
    return predict(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
