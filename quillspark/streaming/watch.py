"""Streaming additions: incremental passages of a watched folder, duplicate suppression, windows over events."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators import documents, passages
from quillspark.plans.rules import RuleSet
from quillspark.session import settled
from quillspark.tree.passages import Options


def watched(spark: SparkSession, folder: str, pattern: str = "*.xml") -> DataFrame:
    """A stream of files: ``doc_id, source, raw``. A document's name is its path below the folder, without suffix."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    inside = F.element_at(F.split("path", re.escape(folder.rstrip("/")) + "/"), -1)
    return files.select(F.regexp_replace(inside, r"\.[^./]*$", "").alias("doc_id"), F.col("path").alias("source"), F.col("content").alias("raw"))


def passages_of(docs: DataFrame, rules: RuleSet | None = None, options: Options | None = None) -> DataFrame:
    """``doc_id, id, hash, document`` of passages: of marked-up documents by their rules, of plain texts by their lines."""
    if rules is not None:
        return documents.indexed(docs, rules, options or Options()).select("doc_id", "id", "hash", "document")
    texts = docs.select("doc_id", F.col("raw").cast("string").alias("text"))
    found = passages.pieces(passages.units(passages.islands(passages.runs_of_lines(texts), F.length("line") < 40)))
    return found.select("doc_id", F.concat_ws("#", "doc_id", F.col("unit_no").cast("string"), F.col("part").cast("string")).alias("id"), "hash", "document")


#: Folders that a target's documents are dealt out to; a target keeps the number it began with.
BUCKETS = 64


def bucket_of(doc_id: str = "doc_id", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(buckets)).cast("int")


def upsert(new: DataFrame, target: str, key: str = "id", batch: str | None = None, docs: DataFrame | None = None, buckets: int = BUCKETS) -> int:
    """Make the target hold the passages of ``new``: one row an id (of repeats the one with the least hash), changed ones
    replaced, those that a document no longer has removed, other documents' kept. ``docs`` names the documents that were
    read, so that one without passages loses those it had. Returns how many buckets were written.

    The target is partitioned by a hash of the document. Only buckets in which something changes are read whole and
    written again, by dynamic partition overwrite, so a batch costs what it touches. A ``batch`` that the target has seen is
    passed over; one that broke off is run again and gives the same rows, since it is noted only when all is written.
    """
    spark = new.sparkSession
    note = None if batch is None else f"{target}/_batches/{batch}"
    if note and _folder(spark, note).exists(_path(spark, note)):
        return 0
    least = new.groupBy(key).agg(F.min_by(F.struct(*new.columns), F.struct("hash", "doc_id")).alias("r")).select("r.*")
    fresh = settled(least.withColumn("bucket", bucket_of(buckets=buckets)))
    ids = fresh.select("doc_id") if docs is None else fresh.select("doc_id").unionByName(docs.select("doc_id"))
    ids = settled(ids.distinct().withColumn("bucket", bucket_of(buckets=buckets)))
    state, written = current(spark, target), 0
    if state is None:
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(target)
        spark.createDataFrame([(fresh.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/_columns")  # a target may become empty
        written = fresh.select("bucket").distinct().count()
    else:
        own = state.where(F.col("bucket").isin([r["bucket"] for r in ids.select("bucket").distinct().collect()]))  # of some buckets, so at most their number
        mine = own.join(ids.select("doc_id"), "doc_id", "left_semi").withColumn("side", F.lit("old")).unionByName(fresh.withColumn("side", F.lit("new")))
        sides = mine.groupBy(key, "bucket").agg(F.min(F.when(F.col("side") == "old", F.col("hash"))).alias("old"), F.min(F.when(F.col("side") == "new", F.col("hash"))).alias("fresh"))
        touched = [r["bucket"] for r in sides.where("not (old <=> fresh)").select("bucket").distinct().collect()]
        if touched:
            names = [*new.columns, "bucket"]
            rest = own.where(F.col("bucket").isin(touched)).join(ids.select("doc_id"), "doc_id", "left_anti")
            rows = settled(rest.select(*names).unionByName(fresh.where(F.col("bucket").isin(touched)).select(*names)))  # it replaces what it is read from
            filled = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)
            for bucket in set(touched) - filled:
                _folder(spark, target).delete(_path(spark, f"{target}/bucket={bucket}"), True)
            written = len(touched)
    if note:
        _folder(spark, note).create(_path(spark, note)).close()
    return written


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _folder(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The target's rows with their ``bucket``; none where there is no target yet. Who reads while a batch is committed may
    have to read again."""
    if not _folder(spark, target).exists(_path(spark, f"{target}/_columns/_SUCCESS")):
        return None
    return spark.read.schema(T.StructType.fromJson(json.loads(spark.read.text(f"{target}/_columns").first()[0]))).parquet(target)


def index_folder(spark: SparkSession, folder: str, target: str, checkpoint: str, rules: RuleSet | None = None, options: Options | None = None, pattern: str = "*.xml") -> StreamingQuery:
    """Index every file there is, once, and what comes later on the next call."""
    docs = watched(spark, folder, pattern)

    def land(batch: DataFrame, number: int) -> None:
        stream = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]  # numbers are the stream's own
        upsert(passages_of(batch, rules, options), target, batch=f"{stream}-{number}", docs=batch)

    return docs.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_repeats(stream: DataFrame, time: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def _late(rows: DataFrame, time: str, delay: str) -> DataFrame:
    """A stream with its watermark; a table as it is."""
    return rows.withWatermark(time, delay) if rows.isStreaming else rows


def tumbling(rows: DataFrame, time: str, size: str, by: list[str], delay: str = "1 hour", **more: Column) -> DataFrame:
    """Counts (and ``more`` aggregates) by window of a stream or a table: ``started``, the keys, ``n``."""
    found = _late(rows, time, delay).groupBy(F.window(time, size).alias("w"), *by).agg(F.count("*").alias("n"), *[c.alias(n) for n, c in more.items()])
    return found.select(F.col("w.start").alias("started"), *by, "n", *more)


def sliding(rows: DataFrame, time: str, size: str, step: str, by: list[str], delay: str = "1 hour") -> DataFrame:
    return _late(rows, time, delay).groupBy(F.window(time, size, step).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), *by, "n")


def sessions(rows: DataFrame, time: str, gap: str, by: list[str], delay: str = "1 hour") -> DataFrame:
    return _late(rows, time, delay).groupBy(F.session_window(time, gap).alias("s"), *by).agg(F.count("*").alias("n")).select(F.col("s.start").alias("started"), *by, "n")


__all__ = ["current", "index_folder", "passages_of", "sessions", "sliding", "tumbling", "upsert", "watched", "without_repeats"]
