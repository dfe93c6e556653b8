"""Token counts through a digest cache: only contents that the cache doesn't hold are encoded, once each."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.bytebpe import field
from quillspark.llm.shared import Scratch, at_most, shared_path, stash

#: Units whose count a worker keeps, in each of two generations.
KEPT_UNITS = 400_000


class PieceCounter:
    """Counts the pieces a sentencepiece BPE model gives a text.

    No merge crosses a place that no piece contains. Where no piece has a space after another character and no
    longer piece a line feed (checked on the vocabulary), the text falls into units there and counts of units add
    up to that of the text; units repeat, so their counts are kept. Otherwise texts are encoded whole.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.whole.id_to_piece(i) for i in range(self.whole.vocab_size()) if not self.whole.is_byte(i)]
        self.divides = not any(re.search("[^▁]▁", p) or ("\n" in p and len(p) > 1) for p in pieces)
        self.divides &= len(self.whole.encode("  a  b \n c ")) == len(self.whole.encode("  a  b ")) + len(self.whole.encode("c ")) + 1  # spaces and line feeds are kept
        self.units = re.compile(" *[^ \n]+| +|\n").findall
        # A second normalizer field merges into the first: no space is put before a unit.
        self.alone = sentencepiece.SentencePieceProcessor(model_proto=self.whole.serialized_model_proto() + field(3, field(3, 0)))
        self.kept: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        if not self.divides:
            return [len(x) for x in self.whole.encode(texts, num_threads=1)]
        parts = [self.units(" " + t) if t and "▁" not in t and "\0" not in t else [] for t in texts]
        needed = set().union(*parts)
        held, new = self.kept, []
        for p in needed:
            if p not in held:
                if (found := self.older.get(p)) is not None:
                    held[p] = found
                else:
                    new.append(p)
        if new:
            if len(held) > KEPT_UNITS:
                self.older, self.kept = held, {p: held[p] for p in needed if p in held}
            self.kept.update(zip(new, map(len, self.alone.encode(new, num_threads=1)), strict=True))
        get = self.kept.__getitem__
        return [sum(map(get, own)) if own else len(self.whole.encode(t)) if t else 0 for t, own in zip(texts, parts, strict=True)]


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def tokenizer_digest(path: str) -> str:
    """SHA-256 over the model file and the library's version: either change makes all cached counts miss."""
    import sentencepiece

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + sentencepiece.__version__.encode()).hexdigest()


def _encoded(misses: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                yield pa.RecordBatch.from_arrays([part.column("content_digest"), pa.array(count.counts(part.column("content").to_pylist()), pa.int64())], names=["content_digest", "n_tokens"])

    return misses.mapInArrow(run, "content_digest binary, n_tokens long")


def _stored(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """Digests and counts that the cache holds for a tokenizer version."""
    try:
        return spark.read.parquet(cache).where(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens")
    except AnalysisException:  # no cache yet
        return None


def content_digest() -> Column:
    """SHA-256 of the normalised content: null becomes empty; nothing else, since any change could change its count."""
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))


def fill(docs: DataFrame, model: str, cache: str) -> None:
    """Append to ``cache`` the counts of the contents of ``docs`` that it lacks, encoded once each.

    Digests are compared first (32 bytes a row, copies combined map-side); texts are read again for the misses only.
    Few misses are broadcast by their digests, so hits' texts never leave their tasks; many (a new cache) are found behind
    the one shuffle that brings copies of a text together, of which each task sends one.
    """
    spark, version, scratch = docs.sparkSession, tokenizer_digest(model), Scratch(docs.sparkSession)
    digests = docs.select(content_digest().alias("content_digest")).distinct()
    held = _stored(spark, cache, version)
    misses = scratch.put(digests if held is None else digests.join(held, "content_digest", "left_anti"), "misses")
    texts = docs.select(content_digest().alias("content_digest"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content"))
    few = at_most(misses, 200_000)
    if few:
        texts = texts.join(F.broadcast(misses), "content_digest", "left_semi")
    once = texts.groupBy("content_digest").agg(F.first("content").alias("content"))
    if not few:
        once = once.join(misses, "content_digest", "left_semi")
    _encoded(once, model).withColumn("tokenizer_digest", F.lit(version)).write.mode("append").option("compression", "zstd").parquet(cache)
    scratch.clear()


def count_tokens(docs: DataFrame, model: str, cache: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``; ``cache`` is a folder of Parquet files.

    A text's key is the digest of its content with that of the tokenizer version. Distinct keys that the cache lacks are
    encoded and appended to it; then every row is joined to its stored count. Counts are those of the library on the
    whole text, without begin or end tokens. Both sides of that join are read from tables, so it may divide a hot text.
    Repeated rows each give a row; an empty table gives none and leaves the cache as it is. Extra columns are ignored.
    """
    fill(docs, model, cache)
    stored = _stored(docs.sparkSession, cache, tokenizer_digest(model))
    sized = docs.select("doc_id", content_digest().alias("content_digest"), F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("n_bytes"))
    counts = stash(stored.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return sized.join(counts, "content_digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def seeded_cache(docs: DataFrame, model: str) -> str:
    """A cache as an earlier run over half of the contents leaves it: those whose digest begins with a bit 0."""
    cache = shared_path(docs.sparkSession, "token-counts")
    fill(docs.where(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256) < "8"), model, cache)
    return cache
