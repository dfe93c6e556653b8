"""Quality rules: text statistics, base rules, and robust multivariate outliers by minimum covariance determinant."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import kernels
from quillspark.llm.shared import Scratch, packed, small, stash

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Share of a group's documents that its estimate keeps; documents by which the wider group's estimate counts beside it.
KEEP, PRIOR = 0.75, 50
#: Concentration steps of all starts, and of the best one at most; it ends when no group's log determinant falls by more.
FIRST_STEPS, LAST_STEPS, SETTLED = 2, 6, 0.01
#: Squared distance beyond which a document is an outlier: the chi-square quantile of 5 degrees of freedom at 1 - 1e-6.
CUT = 35.9
#: Least standard deviation of each transformed statistic, so that statistics that hardly vary reject nothing by noise.
FLOORS = np.array([1.0, 0.12, 0.35, 0.5, 0.6])
#: Histogram bins for each unit of the log of the squared distance, and of a transformed statistic.
BINS, FINE = 24, 64
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True  # fixed values of the contract


def text_stats(column: pa.Array) -> np.ndarray:
    """Rows of STATS for each text; null counts as empty."""
    out = []
    for _, _, data, offsets in kernels.texts(column):
        hashes, starts, solid = kernels.words(data, offsets, lower=False)
        n = len(offsets) - 1
        total = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        span = lambda sums, at: sums[at[1:]] - sums[at[:-1]]
        chars = span(total(solid & ((data & 0xC0) != 0x80)), offsets)
        symbols = span(total(SYMBOL[data]), offsets)
        # words in windows that occur more than once in their text
        grams, at = kernels.windows(hashes, starts)
        owner = np.repeat(np.arange(n), np.diff(at))
        repeats = np.zeros(n, np.int64)
        if len(grams):
            _, inverse, counts = np.unique(kernels.mix(grams + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
            first = np.flatnonzero(counts[inverse] > 1)
            first = first + (starts[:-1] - at[:-1])[owner[first]]
            edges = np.bincount(first, minlength=len(hashes) + 6)[: len(hashes) + 1] - np.bincount(first + 5, minlength=len(hashes) + 6)[: len(hashes) + 1]
            repeats = span(total(np.cumsum(edges) > 0), starts)
        # lines
        breaks = np.flatnonzero(data == 10) + 1
        begin = np.unique(np.concatenate([breaks, offsets[:-1]]))
        begin = begin[begin < len(data)]
        doubles = np.zeros(n, np.int64)
        if len(begin):
            end = np.concatenate([begin[1:], [len(data)]])
            words_before = np.searchsorted(np.flatnonzero(solid), np.stack([begin, end]))
            has_word = words_before[1] > words_before[0]
            end = end - ((end > begin) & (data[end - 1] == 10))
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(kernels.BYTE_CODES[data] * kernels.powers(len(data)), out=sums[1:])
            line = kernels.mix((sums[end] - sums[begin]) * kernels.powers(len(data), True)[begin] + (end - begin).astype(np.uint64))
            doc = np.searchsorted(offsets, begin, side="right") - 1
            line, doc = line[has_word], doc[has_word]
            _, where = np.unique(kernels.mix(line + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
            doubles = np.bincount(doc, minlength=n) - np.bincount(doc[where], minlength=n)
        out.append(np.stack([np.diff(starts), chars, symbols, doubles, repeats], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 5), np.int64)


def transformed(counts: np.ndarray) -> np.ndarray:
    """The statistics on scales where clean texts are close to elliptical: logs of size, word length and rates."""
    n = np.maximum(counts[:, 0], 1).astype(float)
    return np.stack([np.log(n), np.log(np.maximum(counts[:, 1], 1) / n), *[np.log1p(100.0 * counts[:, k] / n) for k in (2, 3, 4)]], axis=1)


def with_stats(rows: DataFrame, text: str = "text", keep: bool = False) -> DataFrame:
    """``rows`` with the statistics of the column ``text`` in its place (behind it, to ``keep`` it), and ``x``, these
    transformed: a map over rows."""
    fields = [*[T.StructField(c, T.LongType()) for c in STATS], T.StructField("x", T.ArrayType(T.DoubleType()))]
    others = [c for c in rows.columns if keep or c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_stats(batch.column(text))
            x = pa.ListArray.from_arrays(pa.array(np.arange(0, 5 * len(found) + 1, 5), pa.int32()), pa.array(transformed(found).ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], *[pa.array(found[:, k]) for k in range(5)], x], names=[*others, *STATS, "x"])

    return rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in others], *fields]))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _keys() -> list[Column]:
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    return [F.concat(F.lit("2|"), part("lang"), F.lit("|"), part("source")), F.concat(F.lit("1|"), part("lang")), F.lit("0|")]


def _chi_square(x: float, degrees: int) -> float:
    """Share of the chi-square distribution up to ``x``, by the series of the incomplete gamma function."""
    a, x = degrees / 2, x / 2
    term = total = math.exp(a * math.log(x) - x - math.lgamma(a + 1)) if x > 0 else 0.0
    while term > 1e-17 * total:
        a += 1
        term *= x / a
        total += term
    return total


def consistency(keep: float, degrees: int = len(STATS)) -> float:
    """The factor that makes the scatter of the nearest ``keep`` of normal data that of all."""
    if keep >= 1:
        return 1.0
    low, high = 0.0, 400.0
    for _ in range(80):
        edge = (low + high) / 2
        low, high = (edge, high) if _chi_square(edge, degrees) < keep else (low, edge)
    return keep / _chi_square(edge, degrees + 2)


#: The products of two statistics that a scatter needs.
_HALF = [(i, j) for i in range(5) for j in range(i, 5)]


def _invert(moments: DataFrame, scale: float) -> DataFrame:
    """Location, inverse scatter and the scatter's log determinant from sums; the scatter is floored along each statistic."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, start, n, total, squares in zip(f["key"], f["start"], f["n"], f["sums"], f["squares"], strict=True):
                mean, cov = np.asarray(total, float) / n, np.zeros((5, 5))
                for (i, j), value in zip(_HALF, squares, strict=True):
                    cov[i, j] = cov[j, i] = value / n - mean[i] * mean[j]
                cov *= scale
                cov += np.diag(np.maximum(FLOORS**2 - np.diag(cov), 0) + 1e-9)
                rows.append((key, start, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
            yield pd.DataFrame(rows, columns=["key", "start", "loc", "inv", "det"])

    return moments.mapInPandas(run, "key string, start int, loc array<double>, inv array<double>, det double")


def squared_distance(x: Column, loc: Column, inv: Column) -> Column:
    """Null where there is no estimate; rounding may leave it a little below zero."""
    d = [x[i] - loc[i] for i in range(5)]
    total = None
    for i in range(5):
        for j in range(i, 5):
            term = d[i] * d[j] * inv[5 * i + j] * (1.0 if i == j else 2.0)
            total = term if total is None else total + term
    return total


def _medians(values: DataFrame) -> DataFrame:
    """``key, m``: medians along each statistic of ``key, x``, to the width of a bin. Counts by bin are combined before the
    shuffle and dealt out by bin too, so the size of a group does not matter."""
    binned = values.select("key", F.posexplode(F.transform("x", lambda v: F.floor(v * FINE).cast("int"))).alias("axis", "bin"))
    counts = binned.groupBy("key", "axis", "bin").agg(F.count("*").alias("c"))
    group = Window.partitionBy("key", "axis")
    running = counts.withColumn("run", F.sum("c").over(group.orderBy("bin"))).withColumn("all", F.sum("c").over(group))
    middle = running.where(F.col("run") >= 0.5 * F.col("all")).groupBy("key", "axis").agg(((F.min("bin") + 0.5) / FINE).alias("v"))
    return middle.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "v"))), lambda s: s["v"]).alias("m"))  # five values


def _moments(rows: DataFrame) -> DataFrame:
    x = [F.col("x")[i] for i in range(5)]
    return rows.groupBy("key", "start").agg(F.count("*").alias("n"), F.array(*[F.sum(a) for a in x]).alias("sums"), F.array(*[F.sum(x[i] * x[j]) for i, j in _HALF]).alias("squares"))


def _concentrated(points: DataFrame, now: DataFrame, keep: float, scratch: Scratch) -> DataFrame:
    """One concentration step: the ``keep`` share of each group's documents that is nearest under each estimate gives the
    next. The share's edge is found by a histogram of log distances, so no group is ever gathered."""
    # Never null to the optimiser: else it would test the whole distance for null once more in the join below.
    at = F.coalesce(F.floor(F.log(F.greatest(squared_distance(F.col("x"), F.col("loc"), F.col("inv")), F.lit(0.0)) + 1e-9) * BINS).cast("int"), F.lit(0))
    binned = points.join(small(now), "key").select("key", "start", "x", at.alias("bin"))
    counts = binned.groupBy("key", "start", "bin").agg(F.count("*").alias("c"))
    group = Window.partitionBy("key", "start")
    running = counts.withColumn("run", F.sum("c").over(group.orderBy("bin"))).withColumn("all", F.sum("c").over(group))
    edge = scratch.put(running.where(F.col("run") >= keep * F.col("all")).groupBy("key", "start").agg(F.min("bin").alias("edge")), "mcd")
    inner = binned.join(small(edge), ["key", "start"]).where("bin <= edge")
    return scratch.put(_invert(_moments(inner), consistency(keep)), "mcd")


def blended(n: int, own: tuple[np.ndarray, np.ndarray] | None, wide: tuple[np.ndarray, np.ndarray], prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """Location and scatter of a group of ``n`` documents, drawn toward those of the wider group by ``prior / (n + prior)``."""
    if own is None:
        return wide
    share = n / (n + prior)
    return share * own[0] + (1 - share) * wide[0], share * own[1] + (1 - share) * wide[1]


def _blend(base: DataFrame, groups: DataFrame) -> DataFrame:
    """Each group's own estimate drawn toward that of its language, and this one toward that of all documents."""
    top = base.where("key = '0|'").first()
    if top is None:
        return base

    def read(loc: object, inv: object) -> tuple[np.ndarray, np.ndarray] | None:
        return None if loc is None else (np.asarray(loc, float), np.linalg.inv(np.asarray(inv, float).reshape(5, 5)))

    whole = read(top["loc"], top["inv"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, n, loc, inv, n_wide, loc_wide, inv_wide in f.itertuples(index=False):
                wide = blended(n_wide, read(loc_wide, inv_wide), whole)
                loc, cov = blended(n, read(loc, inv), wide)
                rows.append((key, n, loc.tolist(), np.linalg.inv(cov).ravel().tolist()))
            yield pd.DataFrame(rows, columns=["key", "n", "loc", "inv"])

    table = lambda key, end: small(base.select(F.col("key").alias(key), *[F.col(c).alias(c + end) for c in ("n", "loc", "inv")]))
    met = groups.join(table("fine", ""), "fine", "left").join(table("wide", "_wide"), "wide", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return met.select("fine", zero("n"), "loc", "inv", zero("n_wide"), "loc_wide", "inv_wide").mapInPandas(run, "key string, n long, loc array<double>, inv array<double>").unionByName(base.where("key = '0|'"))


def fit(stats: DataFrame, keep: float = KEEP) -> DataFrame:
    """Estimates ``key, n, loc, inv`` for each language and source, and for all documents together.

    Every language and source has its own estimate, whatever its size, drawn toward that of its language with a weight that
    falls as it grows (``blended``); a group of which no document passes the base rules has its language's.
    ``stats`` (materialised) has ``lang, source``, the statistics and ``x``. Four starts for each group: the medians with the
    median absolute deviations, the moments of all its documents, and those of its shorter and of its longer half. Each is
    concentrated FIRST_STEPS times, the one with the smallest determinant until it falls no more. A step is two
    map-side combined aggregations over all documents; estimates are written to the shared folder after each step.
    """
    scratch = Scratch(stats.sparkSession)
    points = stats.where(~base_failed()).select(F.explode(F.array(*_keys())).alias("key"), "x")
    middle = scratch.put(_medians(points), "mcd")
    centred = points.join(small(middle), "key")
    spread = scratch.put(_medians(centred.select("key", F.zip_with("x", "m", lambda x, m: F.abs(x - m)).alias("x"))).withColumnRenamed("m", "s").join(small(middle), "key"), "mcd")
    deviation = [F.greatest(1.4826 * F.col("s")[i], F.lit(float(FLOORS[i]))) for i in range(5)]
    plain = spread.select("key", F.lit(0).alias("start"), F.col("m").alias("loc"), F.array(*[1 / (deviation[i] * deviation[i]) if i == j else F.lit(0.0) for i in range(5) for j in range(5)]).alias("inv"))
    parts = centred.select("key", "x", F.explode(F.array(F.lit(1), F.when(F.col("x")[0] <= F.col("m")[0], 2).otherwise(3))).alias("start"))
    now = scratch.put(_invert(_moments(parts), 1.0).drop("det").unionByName(plain), "mcd")
    for _ in range(FIRST_STEPS):
        now = _concentrated(points, now, keep, scratch)
    best = now = scratch.put(now.groupBy("key").agg(F.min(F.struct("det", "start", "loc", "inv")).alias("b")).select("key", "b.*"), "mcd")
    for _ in range(LAST_STEPS):
        now = _concentrated(points, now, keep, scratch)
        met = best.alias("old").join(now.alias("new"), "key")
        fall = met.agg(F.max(F.col("old.det") - F.col("new.det"))).first()[0]
        best = scratch.put(met.select("key", F.least(*[F.struct(*[F.col(f"{t}.{c}") for c in ("det", "start", "loc", "inv")]) for t in ("old", "new")]).alias("b")).select("key", "b.*"), "mcd")
        if fall is None or fall < SETTLED:
            break
    sizes = points.groupBy("key").agg(F.count("*").alias("n"))
    fine, wide, _ = _keys()
    base = scratch.put(best.join(sizes, "key").select("key", "n", "loc", "inv"), "mcd")
    found = stash(_blend(base, stats.select(fine.alias("fine"), wide.alias("wide")).distinct()), "estimates")
    scratch.clear()
    return found


def judged(rows: DataFrame, estimates: DataFrame, cut: float = CUT) -> DataFrame:
    """``rows`` (with the statistics and ``x``) and ``base_failed``, ``distance`` and ``kept``.

    Each document is measured by the estimate of its language and source. Where no document at all passes the base rules,
    these alone decide.
    """
    table = estimates.where("key like '2|%'").select(F.col("key").alias("key_"), "loc", "inv")
    met = rows.withColumn("key", _keys()[0]).join(small(table), F.col("key") == F.col("key_"), "left")
    distance = F.greatest(F.coalesce(squared_distance(F.col("x"), F.col("loc"), F.col("inv")), F.lit(0.0)), F.lit(0.0))
    out = met.withColumn("distance", distance).drop("key", "key_", "loc", "inv")
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= cut))


def _rows(docs: DataFrame) -> DataFrame:
    return packed(docs, text=F.col("text").cast("string"), lang=F.col("lang").cast("string"), source=F.col("source").cast("string"))


def verdicts(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance`` of each row.

    Texts are read whole; null texts have no words and fail. Null languages and sources are groups of their own.
    Repeated rows count as often as they occur. An empty table gives an empty result. Other columns are ignored.
    """
    stats = stash(with_stats(_rows(docs.select("doc_id", "text", "lang", "source")).withColumn("row", F.struct("row.doc_id"))), "stats")
    return judged(stats, fit(stats)).select("row.doc_id", *STATS, "base_failed", "kept", "distance")


def passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, columns unchanged whatever their names."""
    stats = stash(with_stats(_rows(docs).drop("row")), "stats")
    # Texts go through Python and back, in flat columns named by place: cheaper than in a struct, and no name clashes.
    places = [f"c{i}" for i in range(len(docs.columns))]
    of = lambda name: next(p for p, c in zip(places, docs.columns, strict=True) if c.lower() == name)
    flat = docs.toDF(*places)
    flat = flat.select("*", *[F.col(of(c)).cast("string").alias(c) for c in ("lang", "source")])
    return judged(with_stats(flat, of("text"), keep=True), fit(stats)).where("kept").select(*places).toDF(*docs.columns)
