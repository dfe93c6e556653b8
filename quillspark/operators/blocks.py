"""Documents of any size, cut into blocks of positions: running values, counts on axes, ancestors and descendants.

Nodes have dense numbers in document order, so a block is a range of SPAN numbers. What a block must know of those before it is
small: a running value's state, or the elements that are open where it begins (its frame), which are those whose interval
reaches over its first number. Every task takes blocks; none takes a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark.session import settled

#: Positions of a block.
SPAN = 16_384


def block_of(position: str | Column, span: int = SPAN) -> Column:
    return F.floor((F.col(position) if isinstance(position, str) else position) / span).cast("long")


def running(rows: DataFrame, part: str | list[str], order: str, span: int = SPAN, exclusive: bool = False, **folds: tuple[str, Column]) -> DataFrame:
    """``rows`` with a column for each of ``folds``: ``("sum" | "last" | "max" | "min", value)`` of all rows of the part so far,
    this one included, or without those of its own ``order`` if ``exclusive``; ``last`` is the last value that is not null.
    ``order`` is a whole number; rows that share one come in no fixed order.

    A segmented scan: each block folds its own rows, a window over the blocks' results (one row a block) gives the state
    before each, and one join hands it down. A null order is its part's first block.
    """
    part = [part] if isinstance(part, str) else part
    plain = {"sum": F.sum, "max": F.max, "min": F.min}
    fold = lambda kind, c, w: F.last(c, ignorenulls=True).over(w) if kind == "last" else plain[kind](c).over(w)
    whole = rows.withColumn("block_", F.coalesce(block_of(order, span), F.lit(-(1 << 62))))
    inside = Window.partitionBy(*part, "block_").orderBy(order)
    so_far, earlier = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow), inside.rangeBetween(Window.unboundedPreceding, -1)
    here = whole.select("*", *[fold(kind, value, so_far).alias(f"{name}_here_") for name, (kind, value) in folds.items()], *[fold(kind, value, earlier if exclusive else so_far).alias(f"{name}_own_") for name, (kind, value) in folds.items()], (F.lead(F.lit(1)).over(inside)).isNull().alias("final_"))
    before = Window.partitionBy(*part).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    state = here.where("final_").select(*part, "block_", *[fold(kind, F.col(f"{name}_here_"), before).alias(f"{name}_before_") for name, (kind, _) in folds.items()])
    state = state.select(*[F.col(p).alias(f"{p}_state_") for p in part], F.col("block_").alias("block_state_"), *[f"{n}_before_" for n in folds])
    same = F.col("block_") == F.col("block_state_")
    for p in part:
        same &= F.col(p).eqNullSafe(F.col(f"{p}_state_"))
    met = here.join(state, same)
    both = {"sum": lambda a, b: F.coalesce(a + b, a, b), "last": lambda a, b: F.coalesce(b, a), "max": F.greatest, "min": F.least}
    return met.select(*[F.col(c) for c in rows.columns if c not in folds], *[both[kind](F.col(f"{name}_before_"), F.col(f"{name}_own_")).alias(name) for name, (kind, _) in folds.items()])


def ranked(rows: DataFrame, part: str, order: str, name: str, parts: int | None = None) -> DataFrame:
    """``rows``, settled, with their number from 0 in their part by ``order``, of any type: ranges of part and order are
    sorted by themselves, and a window over the ranges' sizes (one row a range and part) gives where each begins."""
    keys = [F.col(part).asc_nulls_first(), F.col(order).asc_nulls_first()]
    ranges = rows.repartitionByRange(*([parts] if parts else []), *keys).sortWithinPartitions(*keys)
    numbered = settled(ranges.withColumn("at_", F.monotonically_increasing_id()))
    place = F.shiftright("at_", 33)
    sizes = numbered.groupBy(part, place.alias("range_")).agg(F.count("*").alias("size_"), F.min("at_").alias("first_"))
    before = Window.partitionBy(part).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(part).alias("part_"), "range_", "first_", F.coalesce(F.sum("size_").over(before), F.lit(0)).alias("start_"))
    met = numbered.withColumn("range_own_", place).join(starts, F.col(part).eqNullSafe(F.col("part_")) & (F.col("range_own_") == F.col("range_")))
    return met.select(*rows.columns, (F.col("at_") - F.col("first_") + F.col("start_")).alias(name))


def framed(nodes: DataFrame, span: int = SPAN) -> DataFrame:
    """``nodes`` with ``block``, each in its own block and in all those that begin inside it: at most one row a level and block
    more than there are nodes."""
    return nodes.withColumn("block", F.explode(F.sequence(block_of("node_id", span), block_of("end_id", span))))


def walked(rows: DataFrame, keys: list[str], each: Callable[[tuple, list[tuple]], Iterable[tuple]], schema: T.StructType) -> DataFrame:
    """The tuples that ``each`` makes of a key and its rows, for all keys: for groups that are no larger than a block, but may
    be many and tiny. Partitions are sorted by key and walked once, so a group costs nothing beside its rows."""
    n, types = len(keys), to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), types, strict=True)], schema=types)

        key, held, out = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:n] != key:
                    out += each(key, held)
                    held = []
                    if len(out) > 20_000:
                        yield packed(out)
                        out = []
                key = row[:n]
                held.append(row[n:])
        if held:
            out += each(key, held)
        if out:
            yield packed(out)

    others = [c for c in rows.columns if c not in keys]
    return rows.select(*keys, *others).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _stacked(lower: pa.Table, upper: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``lower`` with rows of ``upper`` whose interval holds them: one merge in document order over a stack of open
    intervals, so the cost is the rows and the pairs."""
    own = np.asarray(lower.column("node_id").combine_chunks())
    first, last = (np.asarray(upper.column(c).combine_chunks()) for c in ("node_id", "end_id"))
    low, up = np.argsort(own, kind="stable"), np.lexsort((-last, first))
    stack: list[int] = []
    pairs_low, pairs_up, k = [], [], 0
    for c in low:
        at = own[c]
        while k < len(up) and first[up[k]] < at:
            while stack and last[stack[-1]] < first[up[k]]:
                stack.pop()
            stack.append(up[k])
            k += 1
        while stack and last[stack[-1]] < at:
            stack.pop()
        pairs_low += [c] * len(stack)
        pairs_up += stack
    return np.array(pairs_low, np.int64), np.array(pairs_up, np.int64)


def holding(context: DataFrame, nodes: DataFrame, axis: str, span: int = SPAN) -> DataFrame:
    """``context_id`` and the nodes on its axis ``ancestor`` or ``descendant``: a structural merge join.

    Both sides meet block by block. Intervals that are open where a block begins are its frame, so no document's nodes meet
    as a whole, and no pair is made that isn't one.
    """
    up, low = (nodes, context) if axis == "ancestor" else (context, nodes)
    keep = "upper" if axis == "ancestor" else "lower"
    names = nodes.columns
    lower = (low if keep == "lower" else low.select("doc_id", "node_id")).withColumn("block_", block_of("node_id", span))
    upper = framed((up if keep == "upper" else up.select("doc_id", "node_id", "end_id")).where("end_id > node_id"), span).withColumnRenamed("block", "block_")
    upper = upper.select(*[F.col(c).alias(c) for c in upper.columns])  # both sides may be one table: columns of its own
    schema = T.StructType([T.StructField("context_id", context.schema["node_id"].dataType), *nodes.schema.fields])
    empty = to_arrow_schema(schema).empty_table()

    def run(below: pa.Table, above: pa.Table) -> pa.Table:
        if not below.num_rows or not above.num_rows:
            return empty
        a, b = _stacked(below, above)
        source, taken, other, met = (above, b, below, a) if keep == "upper" else (below, a, above, b)
        return pa.table([other.column("node_id").take(pa.array(met)), *[source.column(c).take(pa.array(taken)) for c in names]], names=["context_id", *names])

    return lower.groupBy("doc_id", "block_").cogroup(upper.groupBy("doc_id", "block_")).applyInArrow(run, schema)


def counts(context: DataFrame, nodes: DataFrame, axis: str, span: int = SPAN) -> DataFrame:
    """``doc_id, context_id, n``: how many nodes are on an axis of each context node, without making pairs.

    On ``descendant`` they are the starts in its interval, on ``following`` those behind it, on ``preceding`` the ends
    before it: differences of running counts, which come with one scan over nodes and contexts together.
    """
    if axis not in ("descendant", "following", "preceding"):
        raise ValueError(axis)
    c = context.select("doc_id", F.col("node_id").alias("context_id"), "end_id")
    mark = F.col("end_id") if axis == "preceding" else F.col("node_id")
    none = F.lit(None).cast("long")
    items = nodes.select("doc_id", (mark.cast("long") * 2).alias("at_"), F.lit(1).alias("n_"), none.alias("context_id"), F.lit(0).alias("sign_"))
    # A question stands behind all items of its number, or before them.
    ask = lambda place, sign: c.select("doc_id", place.cast("long").alias("at_"), F.lit(0).alias("n_"), F.col("context_id").cast("long"), F.lit(sign).alias("sign_"))
    asked = {"descendant": [(F.col("context_id") * 2 + 1, -1), (F.col("end_id") * 2 + 1, 1)], "following": [(F.col("end_id") * 2 + 1, -1)], "preceding": [(F.col("context_id") * 2 - 1, 1)]}[axis]
    rows = items
    for place, sign in asked:
        rows = rows.unionByName(ask(place, sign))
    merged = rows.groupBy("doc_id", "at_").agg(F.sum("n_").alias("n_"), F.collect_list(F.when(F.col("sign_") != 0, F.struct("context_id", "sign_"))).alias("asked_"))
    found = running(merged, "doc_id", "at_", 2 * span, upto_=("sum", F.col("n_")))
    parts = found.select("doc_id", F.explode("asked_").alias("a_"), "upto_").select("doc_id", F.col("a_.context_id").alias("context_id"), (F.col("upto_") * F.col("a_.sign_")).alias("n"))
    if axis == "following":
        parts = parts.unionByName(nodes.groupBy("doc_id").agg(F.count("*").alias("n")).join(c, "doc_id").select("doc_id", F.col("context_id").cast("long"), "n"))
    return parts.groupBy("doc_id", "context_id").agg(F.sum("n").alias("n"))
