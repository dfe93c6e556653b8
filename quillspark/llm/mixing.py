"""Mixing sources to target weights by Poisson replication (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import packed, small

#: Rates above this are split into independent draws, so that exp(-rate) stays far from underflow.
PIECE = 64.0


def uniform(seed: int, *parts: Column) -> Column:
    """A double in (0, 1) from the MD5 of the seed and the parts: 52 bits, equal on every engine."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rates(docs: DataFrame, alpha: float = 0.5, weights: dict[str, float] | None = None, total: int | None = None) -> DataFrame:
    """Per source: ``q_source, n_docs, weight, rate``.

    Weights default to ``n_docs ** alpha`` (temperature smoothing) and are normalised to sum to 1; the rate is
    the mean number of copies a document of the source needs, ``weight * total / n_docs``, total defaulting
    to the number of documents. A null source is a source of its own. Sources missing in ``weights`` get 0.
    """
    counts = docs.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("q_source"), F.col("source").isNull().alias("q_none")).agg(F.count("*").alias("n_docs"))
    raw = F.pow(F.col("n_docs").cast("double"), F.lit(alpha))
    if weights is not None:
        raw = F.lit(0.0)
        for name, w in weights.items():
            raw = F.when((F.col("q_source") == name) & ~F.col("q_none"), F.lit(float(w))).otherwise(raw)
    sized = counts.withColumn("raw", raw)
    sums = sized.agg(F.sum("raw").alias("raw_sum"), F.sum("n_docs").alias("all_docs")).first()  # one row
    target = float(total if total is not None else sums["all_docs"] or 0)
    weight = F.col("raw") / F.lit(float(sums["raw_sum"])) if sums["raw_sum"] else F.lit(0.0)
    return sized.select("q_source", "q_none", "n_docs", weight.alias("weight"), (weight * F.lit(target) / F.col("n_docs")).alias("rate"))


def _cdf(rate: Column) -> Column:
    """Cumulative Poisson probabilities for 0, 1, ... until the tail is below double precision."""
    most = F.ceil(rate + 10 * F.sqrt(rate) + 25).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("f"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["f"] + p).alias("f"), F.concat(acc["all"], F.array(acc["f"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda acc: acc["all"])


def replicate(docs: DataFrame, alpha: float = 0.5, weights: dict[str, float] | None = None, total: int | None = None, seed: int = 20) -> DataFrame:
    """Each document, repeated a Poisson number of times with its source's mean rate, in shuffled order.

    The draw inverts the Poisson distribution at a uniform seeded by the document's id, so a document gets
    the same count on every run and repeated rows get equal counts. Adds ``copy_no`` (from 1), ``n_copies``
    and ``shuffle_key``; all other columns pass unchanged (columns of those three names are replaced). Null ids
    share one draw; a null source is its own source; empty input gives empty output. The only exchange of texts
    is the final shuffle: rows are dealt by a hash of the shuffle key (no source or copy can be hot, since the
    key differs for each copy) and sorted by it inside partitions.
    """
    kept = [c for c in docs.columns if c.lower() not in ("copy_no", "n_copies", "shuffle_key")]
    table = rates(docs, alpha, weights, total).select("q_source", "q_none", F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE)).cast("int").alias("pieces"), "rate")
    table = table.select("q_source", "q_none", "pieces", _cdf(F.col("rate") / F.col("pieces")).alias("cdf"))
    rows = packed(docs, id=F.col("doc_id").cast("string"), q_source=F.coalesce(F.col("source"), F.lit("")), q_none=F.col("source").isNull())
    id_ = F.col("id")
    inverse = lambda j: F.size(F.filter("cdf", lambda c: c < uniform(seed, id_, j)))
    n = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("pieces")), inverse), F.lit(0), lambda a, b: a + b)
    drawn = rows.join(small(table, 50_000), ["q_source", "q_none"]).select("row", "id", n.cast("long").alias("n_copies")).where("n_copies > 0")
    each = drawn.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    key = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.coalesce(id_, F.lit("~")), F.col("copy_no").cast("string")))
    dealt = each.select("row", "copy_no", "n_copies", key.alias("shuffle_key")).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return dealt.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "copy_no", "n_copies", "shuffle_key")
