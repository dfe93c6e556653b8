"""Source divergence audit: which sources of a language use its terms alike, and which terms set a source apart.

A count-min sketch of document frequencies is made in the tasks and merged. It never underestimates, so a term that it puts
below the least frequency is below it, and is dropped before anything is shuffled; what survives is counted exactly.
Sources are compared by the terms that both have; all other terms enter by how many there are of each count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import kernels
from quillspark.llm.shared import Scratch, small, stash

#: Documents of its language that a term needs; ranks of terms that are returned.
LEAST, TOP = 10, 10
#: Rows of the sketch, and the widths (as powers of two) that it may have; 2 MB of bits at most.
DEPTH, NARROW, WIDE = 4, 14, 22
#: Rows that a task gathers before it combines them, and combined ones beyond which it sends them on.
GATHERED, SENT = 1_000_000, 1_500_000
_CHUNK = 1 << 16
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True  # fixed values of the contract


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """Lower-cased terms of texts that lie behind each other, and the number of each one's text."""
    solid = _LETTER[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    begins[cuts] = solid[cuts]
    ends[cuts[cuts > 0] - 1] = solid[cuts[cuts > 0] - 1]
    first, final = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    at = np.concatenate([[0], np.cumsum(final - first)]).astype(np.int64)
    letters = kernels.LOWER[data[solid]]
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(at), pa.py_buffer(letters)), np.searchsorted(offsets, first, side="right") - 1


def string_hashes(values: pa.LargeStringArray) -> np.ndarray:
    """64 bits for each string, the same in all processes."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    at = np.frombuffer(values.buffers()[1], np.int64, n + 1, 8 * values.offset)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(kernels.BYTE_CODES[data] * kernels.powers(len(data)), out=sums[1:])
    back = kernels.powers(len(data) + 1, True)[at[:-1]]
    return kernels.mix((sums[at[1:]] - sums[at[:-1]]) * back + np.diff(at).astype(np.uint64))


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each key in a row of the sketch."""
    return (kernels.mix(keys + np.uint64(0xA24BAED4963EE407 * (row + 1) & (1 << 64) - 1)) >> np.uint64(64 - bits)).astype(np.int64)


def _strings(column: pa.Array) -> pa.LargeStringArray:
    return column.cast(pa.large_string())


class Run:
    """Terms of some whole texts: ``pairs`` are the distinct ones of text and term with the number of occurrences."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: pa.Array, sources: pa.Array) -> None:
        found, text = terms(data, offsets)
        coded = found.dictionary_encode()
        self.values = coded.dictionary
        self.width = max(len(self.values), 1)
        pairs, self.n = np.unique(text * self.width + np.asarray(coded.indices, np.int64), return_counts=True)
        self.text, self.term = pairs // self.width, pairs % self.width
        lang, source = _strings(langs).dictionary_encode(), _strings(sources).dictionary_encode()
        self.langs, self.sources = lang.dictionary, source.dictionary
        self.lang, self.source = np.asarray(lang.indices, np.int64)[self.text], np.asarray(source.indices, np.int64)[self.text]

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the distinct pairs of language and term, their document frequencies here, and the pair of each row."""
        pairs, which, df = np.unique(self.lang * self.width + self.term, return_inverse=True, return_counts=True)
        hashes = string_hashes(self.values)[pairs % self.width] + kernels.mix(string_hashes(self.langs))[pairs // self.width]
        return kernels.mix(hashes), df, which


def _runs(batch: pa.RecordBatch) -> Iterator[Run]:
    langs, sources = batch.column("lang"), batch.column("source")
    for lo, hi, data, offsets in kernels.texts(batch.column("text"), 1 << 21):
        yield Run(data, offsets, langs.slice(lo, hi - lo), sources.slice(lo, hi - lo))


def sketch(rows: DataFrame, least: int, bits: int) -> np.ndarray:
    """For each cell of the merged count-min sketch of document frequencies whether it reached ``least``: bits, of fixed size.

    A task sends the cells that it counted, up to ``least`` (more makes no difference); each chunk of cells is merged by itself.
    """
    chunks = max(1 << bits, _CHUNK) // _CHUNK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((DEPTH, 1 << bits), np.uint32)
        for batch in batches:
            for run in _runs(batch):
                keys, df, _ = run.keys()
                for row in range(DEPTH):
                    np.add.at(table[row], cells(keys, row, bits), df.astype(np.uint32))
        for row in range(DEPTH):
            for chunk in range(chunks):
                part = table[row, chunk * _CHUNK : (chunk + 1) * _CHUNK]
                hit = np.flatnonzero(part)
                if len(hit):
                    kept = np.minimum(part[hit], least).astype("<u4")
                    yield pa.RecordBatch.from_arrays([pa.array([row * chunks + chunk], pa.int32()), pa.array([hit.astype("<u2").tobytes()], pa.binary()), pa.array([kept.tobytes()], pa.binary())], names=["chunk", "cells", "counts"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CHUNK, np.int64)
        for batch in batches:
            for hit, counts in zip(batch.column("cells").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[np.frombuffer(hit, "<u2")] += np.frombuffer(counts, "<u4")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["chunk", "bits"])

    merged = rows.mapInArrow(count, "chunk int, cells binary, counts binary").groupBy("chunk").applyInArrow(merge, "chunk int, bits binary")
    out = np.zeros((DEPTH * chunks, _CHUNK // 8), np.uint8)
    for r in merged.toLocalIterator():
        out[r["chunk"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.reshape(DEPTH, -1)


def possible(table: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Whether the sketch lets a key be frequent: all of its cells reached the bound."""
    yes = np.ones(len(keys), bool)
    for row in range(DEPTH):
        at = cells(keys, row, bits)
        yes &= (table[row, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return yes


def _counted(rows: DataFrame, table: np.ndarray, bits: int) -> DataFrame:
    """``lang, source, term, n, df``: partial exact counts of the terms that the sketch lets pass, combined in each task."""
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def combined(parts: list[pa.Table]) -> pa.Table:
        whole = pa.concat_tables(parts).group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("df", "sum")])
        return whole.select(["group", "term", "n_sum", "df_sum"]).rename_columns(["group", "term", "n", "df"])

    def send(whole: pa.Table, groups: dict[tuple[str, str], int]) -> Iterator[pa.RecordBatch]:
        names = [pa.array([g[k] for g in groups], pa.string()) for k in range(2)]
        at = whole.column("group")
        out = pa.table([names[0].take(at), names[1].take(at), whole.column("term").cast(pa.string()), whole.column("n"), whole.column("df")], names=["lang", "source", "term", "n", "df"])
        yield from out.to_batches(50_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}  # languages with their sources, by number
        parts: list[pa.Table] = []
        new = settled = 0
        for batch in batches:
            for run in _runs(batch):
                keys, _, which = run.keys()
                keep = possible(shared.value, keys, bits)[which]
                langs, sources = run.langs.to_pylist(), run.sources.to_pylist()
                met, which_group = np.unique(run.lang[keep] * max(len(sources), 1) + run.source[keep], return_inverse=True)
                own = np.array([groups.setdefault((langs[g // len(sources)], sources[g % len(sources)]), len(groups)) for g in met.tolist()], np.int64)
                pairs, at, df = np.unique(own[which_group] * run.width + run.term[keep], return_inverse=True, return_counts=True)
                n = np.bincount(at, weights=run.n[keep], minlength=len(pairs)).astype(np.int64)
                parts.append(pa.table([pa.array((pairs // run.width).astype(np.int32)), run.values.take(pa.array(pairs % run.width)), pa.array(n), pa.array(df.astype(np.int64))], names=["group", "term", "n", "df"]))
                new += len(pairs)
                if new > max(GATHERED, settled):  # so that each row is combined a few times only
                    parts, new = [combined(parts)], 0
                    settled = len(parts[0])
                    if settled > SENT:
                        yield from send(parts.pop(), groups)
                        settled = 0
        if parts:
            yield from send(combined(parts), groups)

    return rows.mapInArrow(count, "lang string, source string, term string, n long, df long")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)) in whole numbers of any size; null where there are no terms."""
    wide = lambda c: c.cast("decimal(18,0)")
    top = F.lit(1_000_000_000).cast("decimal(10,0)") * (wide(n) + F.lit(2).cast("decimal(1,0)"))
    below = F.nullif(wide(total) + F.lit(2).cast("decimal(1,0)") * wide(terms), F.lit(0).cast("decimal(38,0)"))
    return F.call_function("div", top, below) + F.lit(1)


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, a, b, value`` for sources ``a < b`` of a language: the sum of gaps over all kept terms.

    Were no term in both, a source's own terms would meet the other's share of a term that it lacks; they enter by their
    counts' histogram. Terms in both are met by an equi-join on language and term and put this right.
    """
    side = lambda x: groups.select("lang", *[F.col(c).alias(f"{c}_{x}") for c in ("source", "p0", "own", "terms")])
    both = side("a").join(side("b"), "lang").where("source_a < source_b")
    names = [F.col("lang"), F.col("source_a").alias("a"), F.col("source_b").alias("b")]
    none = both.select(*names, (_gap(F.col("p0_a"), F.col("p0_b")) * (F.col("terms_a") - F.col("own_a") - F.col("own_b"))).alias("value"))
    bars = counts.groupBy("lang", "source", "p").agg(F.count("*").alias("bar"))
    other = small(groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q")))
    single = bars.join(other, "lang").where("source <> other").select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), (_gap(F.col("p"), F.col("q")) * F.col("bar")).alias("value"))
    half = lambda x: counts.select("lang", "term", *[F.col(c).alias(f"{c}_{x}") for c in ("source", "p", "p0")])
    met = half("a").join(half("b"), ["lang", "term"]).where("source_a < source_b")
    p = {c: F.col(c) for c in ("p_a", "p_b", "p0_a", "p0_b")}
    right = _gap(p["p_a"], p["p_b"]) - _gap(p["p_a"], p["p0_b"]) - _gap(p["p0_a"], p["p_b"]) + _gap(p["p0_a"], p["p0_b"])
    parts = none.unionByName(single).unionByName(met.select(*names, right.alias("value")))
    return parts.groupBy("lang", "a", "b").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"))


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has each other source of the language, part ``term`` the
    ``top`` terms of which the source has a larger share than the language; larger values first, ties by item.

    Null texts, languages and sources are empty ones. Terms are runs of ASCII letters and other characters, of which only A-Z
    become small. A repeated row is another document. Terms in fewer than ``least`` documents of their language count nowhere;
    a language without any gives pairs of value 0. An empty table gives no rows. Other columns are ignored. The sketch has
    about 16 cells a document, 2 ^ WIDE at most: beyond, more infrequent terms get through to the exact count, none gets lost.
    """
    scratch = Scratch(docs.sparkSession)
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(plain("lang"), plain("source"), plain("text"))
    sizes = scratch.put(rows.groupBy("lang", "source").agg(F.count("*").alias("docs")), "divergence")
    bits = min(WIDE, max(NARROW, math.ceil(math.log2(16 * (sizes.agg(F.sum("docs")).first()[0] or 1)))))
    table = sketch(rows, least, bits)
    found = scratch.put(_counted(rows, table, bits).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "divergence")
    kept = scratch.put(found.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n_all")).where(F.col("df") >= least).drop("df"), "divergence")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_all").alias("total_all"))
    counts = scratch.put(found.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_all"), "divergence")
    own = counts.groupBy("lang", "source").agg(F.count("*").alias("own"), F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = sizes.join(langs, "lang", "left").join(own, ["lang", "source"], "left").select("lang", "source", *map(zero, ["terms", "total_all", "own", "total"]))
    groups = scratch.put(joined.withColumn("p0", _share(F.lit(0), F.col("total"), F.col("terms"))), "divergence")
    shares = counts.join(small(groups.select("lang", "source", "terms", "total", "total_all", "p0")), ["lang", "source"])
    shares = scratch.put(shares.select("lang", "source", "term", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), _share(F.col("n_all"), F.col("total_all"), F.col("terms")).alias("q"), "p0"), "divergence")
    order = lambda *by: Window.partitionBy(*by).orderBy(F.col("value").desc(), F.col("item").asc())
    pairs = _pairs(shares, groups).select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"), "value")
    pairs = pairs.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value").withColumn("rank", F.row_number().over(order("lang", "source")))
    own_terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    own_terms = own_terms.withColumn("rank", F.row_number().over(order("lang", "source"))).where(F.col("rank") <= top)
    out = stash(pairs.unionByName(own_terms), "divergence")
    scratch.clear()
    return out
