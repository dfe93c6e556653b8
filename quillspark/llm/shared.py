"""Session helpers: the cluster's shared folder, materialised tables, content keys, components."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcasts are made only below this many rows, counted first.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a temporary folder serves a local session only:
    executors of a cluster would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quill-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quill-{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and a lost executor loses nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that one call needs on its way; ``clear`` deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        context = self.spark.sparkContext
        for path in self.paths:
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = []


def at_most(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` (already materialised) has at most so many rows; with rows of fixed size, a bound on its bytes."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` (already materialised, rows of fixed size) for broadcast if it has at most ``rows`` rows, else leave the join to AQE."""
    return F.broadcast(df) if at_most(df, rows) else df


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """All columns of ``docs`` in one struct ``row``, beside columns computed from them: no name can clash."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in more.items()])


def row_text(batch: pa.RecordBatch) -> pa.Array:
    """The texts inside the struct ``row``, which so need not be sent beside it."""
    return batch.column("row").field("text").cast(pa.string())


def content_keys(text: str = "text") -> tuple[Column, Column]:
    """Two 64-bit hashes that name a text; null and empty texts share theirs."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.xxhash64(whole), F.xxhash64(F.lit(7), whole, F.length(whole))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges(a, b)`` of one ordered type, any order, repeats and self-loops allowed. Returns ``node, root`` for every
    node that has an edge, root being the smallest reachable node. Each round is two hash aggregations on
    the node; a round is written to the shared folder, so lineage stays short. Least neighbours are written too, so
    that both sides of their join are read from tables and it may divide the node that many others hang on.
    """
    scratch = Scratch(edges.sparkSession)
    flow = scratch.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        done = Scratch(edges.sparkSession)
        done.paths, scratch.paths = scratch.paths, []
        both = flow.select("a", "b").unionByName(flow.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = done.put(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "lows")
        large = both.where("b > a").join(lows, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        mins = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(mins, "a")
        nxt = linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(mins.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        nxt = scratch.put(nxt, "edges")
        sign = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        same = sign(nxt) == sign(flow)
        done.clear()
        flow = nxt
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = flow.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(flow.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
