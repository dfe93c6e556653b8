"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first, with calibrated leaf visits."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.shared import stash

#: Vectors the tree is fitted on; vectors a leaf should hold; leaves at most; children of a node.
SAMPLE, LEAF, MOST_LEAVES, BRANCH = 80_000, 400, 8192, 8
#: Rows of a block, the unit of search: small leaves share one, a leaf with more rows has several.
BLOCK = 4096
#: Queries that one task answers for a block: a block that more queries visit is copied for each lot of them.
LOT = 8192
#: Pairs of a query and a row whose products are summed at a time.
PAIRS = 1 << 15
#: Queries that calibrate the number of leaves to visit, and the recall they must reach.
PROBES, RECALL = 200, 0.97
FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


@dataclass
class Tree:
    """Nodes of a k-means tree: centre, largest distance of its rows from it, children; leaves are numbered."""

    centre: list[np.ndarray] = field(default_factory=list)
    radius: list[float] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            c = np.stack([self.centre[k] for k in self.children[node]])
            near = (x[rows] @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
            todo += [(k, rows[near == j]) for j, k in enumerate(self.children[node]) if (near == j).any()]
        return out

    def best_first(self, q: np.ndarray) -> Iterator[int]:
        """Leaves by the largest inner product their ball allows, from one priority queue over all depths."""
        size = float(np.linalg.norm(q))
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
                continue
            for k in self.children[node]:
                heapq.heappush(heap, (-(float(q @ self.centre[k]) + 0.5 * size * self.radius[k]), k))


def _split(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray | None:
    """k-means labels, or None if all rows are equal."""
    unique = np.unique(x[rng.permutation(len(x))[:2000]], axis=0)
    if len(unique) < 2:
        return None
    c = unique[rng.permutation(len(unique))[: min(k, len(unique))]]
    for _ in range(8):
        near = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        c = np.stack([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
    return near if len(np.unique(near)) > 1 else None


def grow(x: np.ndarray, leaves: int, seed: int = 5) -> Tree:
    """A tree over the sample: the largest node is split next, until there are enough leaves."""
    rng = np.random.default_rng(seed)
    tree = Tree()

    def add(rows: np.ndarray) -> int:
        c = x[rows].mean(axis=0)
        tree.centre.append(c)
        tree.radius.append(float(np.quantile(np.linalg.norm(x[rows] - c, axis=1), 0.9)))
        tree.children.append([])
        tree.leaf.append(-1)
        return len(tree.centre) - 1

    heap = [(-len(x), add(np.arange(len(x))), np.arange(len(x)))]
    done = []
    while heap:
        size, node, rows = heapq.heappop(heap)
        if len(heap) + len(done) + 1 >= leaves or -size < 2 * BRANCH or (near := _split(x[rows], BRANCH, rng)) is None:
            done.append(node)
            continue
        for j in np.unique(near):
            k = add(rows[near == j])
            tree.children[node].append(k)
            heapq.heappush(heap, (-int((near == j).sum()), k, rows[near == j]))
    for number, node in enumerate(done):
        tree.leaf[node] = number
    tree.leaves = len(done)
    return tree


def usable(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, v`` of rows with an id whose vector is not null, zero or holding null or non-finite components."""
    fine = ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("v", lambda e: e != 0)
    return vectors.select(F.col(id_).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def _nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, allowed: np.ndarray | None = None, leaf: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """The k best rows for each query: largest product first, ties to the smaller id, never the query's own id.

    ``allowed`` (queries by leaves) says which rows count for a query by the number of their ``leaf``. A matrix product
    rounds by a row's place, so that it only narrows: all within its rounding of the k-th are summed again in one
    order, which gives equal vectors equal scores in every block.
    """
    rounding = 4 * np.finfo(np.float64).eps * x.shape[1] ** 2 * np.abs(q).max(axis=1, initial=0) * np.abs(x).max(initial=0)
    for at in range(0, len(q), 256):
        scores = q[at : at + 256] @ x.T
        scores[q_ids[at : at + 256, None] == ids[None, :]] = -np.inf
        if allowed is not None:
            scores[~allowed[at : at + 256][:, leaf]] = -np.inf
        least = np.partition(scores, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(scores), -np.inf)
        row, col = np.nonzero((scores >= (least - rounding[at : at + 256])[:, None]) & np.isfinite(scores))
        found = np.concatenate([np.zeros(0), *[(q[at + row[i : i + PAIRS]] * x[col[i : i + PAIRS]]).sum(axis=1) for i in range(0, len(row), PAIRS)]])
        order = np.lexsort((ids[col], -found, row))
        row, col, found = row[order], col[order], found[order]
        first = np.searchsorted(row, row)
        best = np.arange(len(row)) - first < k
        yield pd.DataFrame({"query_id": q_ids[at + row[best]], "vec_id": ids[col[best]], "score": found[best]})


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, every: int = 20, k: int = 20, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows by inner product of each row whose id is divisible by ``every``.

    The tree is fitted on a bounded sample (the rows with the smallest id hashes), every row is indexed. The number of
    leaves to visit is calibrated: probe queries are compared with all rows, and leaves are added, best bin first,
    until the wanted share of their true neighbours lies in them. A query also goes on until its leaves hold k rows
    besides its own. Leaves with many rows (a vector that many rows repeat) fall into blocks by id hash, small leaves share a
    block; each block gives a query the k best of its visited leaves, so no task holds a whole hot leaf and nothing is capped.
    Scores are float64 products of the stored vectors, equal for equal vectors. Ids are distinct rows' names: of rows repeating an id with
    another vector each is a candidate of its own, and equal (id, score) pairs count once. Vectors of another length
    than the commonest take no part. Two vectors under one query id share one list of the k nearest. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == lengths[0]["n"]).distinct()
    total = lengths[0]["count"]
    by_hash = F.xxhash64("vec_id")
    sample = rows.orderBy(by_hash, "vec_id").limit(SAMPLE).toPandas()  # at most SAMPLE rows
    sample = sample.sort_values("vec_id", kind="stable")
    tree = grow(_matrix(sample["v"]), int(min(MOST_LEAVES, max(1, total // LEAF))))
    shared = spark.sparkContext.broadcast(tree)  # at most MOST_LEAVES leaves

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["leaf"] = shared.value.leaf_of(_matrix(f["v"])) if len(f) else []
            yield f

    indexed = stash(rows.mapInPandas(index, "vec_id long, v array<double>, leaf long"), "ann")
    sizes = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}  # at most MOST_LEAVES rows
    # Neighbouring small leaves share a block, a leaf with more rows than a block has several.
    bundles, held_rows, number = {}, 0, 0
    for leaf in range(tree.leaves):
        n = sizes.get(leaf, 0)
        if held_rows and held_rows + n > BLOCK:
            number, held_rows = number + 1, 0
        bundles[leaf] = number
        held_rows += n
    queries = indexed.where(F.col("vec_id") % every == 0)

    # Probes against all rows, in blocks, and the rank of each true neighbour's leaf in best-bin-first order.
    probes = queries.orderBy(by_hash, "vec_id").limit(PROBES).toPandas()
    if not len(probes):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    probe = spark.sparkContext.broadcast((probes["vec_id"].to_numpy(), _matrix(probes["v"])))

    def brute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for found in _nearest(*probe.value, f["vec_id"].to_numpy(), _matrix(f["v"]), k) if len(f) else ():
                yield found.merge(f[["vec_id", "leaf"]].drop_duplicates("vec_id"), on="vec_id")

    truth = _top(indexed.mapInPandas(brute, "query_id long, vec_id long, score double, leaf long"), k).select("query_id", "leaf").collect()  # at most PROBES * k rows
    order = {int(i): {leaf: n for n, leaf in enumerate(tree.best_first(v))} for i, v in zip(probes["vec_id"], _matrix(probes["v"]), strict=True)}
    ranks = sorted(order[r["query_id"]][r["leaf"]] for r in truth)
    visits = ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))] + 1 if ranks else 1
    plan = spark.sparkContext.broadcast((sizes, bundles))

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes, bundles = plan.value
        for f in frames:
            out = []
            for i, v in zip(f["vec_id"], f["v"], strict=True):
                seen = 0
                mine: dict[int, list[int]] = {}
                for n, leaf in enumerate(shared.value.best_first(np.asarray(v, np.float64))):
                    if n >= visits and seen > k:
                        break
                    seen += sizes.get(leaf, 0)
                    mine.setdefault(bundles[leaf], []).append(leaf)
                out += [(i, v, bundle, leaves) for bundle, leaves in mine.items()]
            yield pd.DataFrame(out, columns=["query_id", "q", "bundle", "leaves"])

    visited = stash(queries.mapInPandas(visit, "query_id long, q array<double>, bundle long, leaves array<long>"), "ann")
    calls = {r["bundle"]: r["count"] for r in visited.groupBy("bundle").count().collect()}  # at most MOST_LEAVES rows
    rows_of: dict[int, int] = {}
    for leaf, bundle in bundles.items():
        rows_of[bundle] = rows_of.get(bundle, 0) + sizes.get(leaf, 0)
    table = [(leaf, bundle, max(1, -(-rows_of[bundle] // BLOCK)), -(-calls[bundle] // LOT)) for leaf, bundle in bundles.items() if bundle in calls]
    by_leaf = F.broadcast(spark.createDataFrame(table, "leaf long, bundle long, n_blocks long, n_lots long"))  # at most MOST_LEAVES rows
    by_bundle = F.broadcast(spark.createDataFrame(sorted({t[1:] for t in table}), "bundle long, n_blocks long, n_lots long"))
    whole = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    probing = visited.join(by_bundle, "bundle").withColumn("lot", F.pmod(F.xxhash64("query_id"), F.col("n_lots"))).withColumn("block", whole("n_blocks")).select("bundle", "block", "lot", "query_id", "q", "leaves")
    held = indexed.join(by_leaf, "leaf").withColumn("block", F.pmod(by_hash, F.col("n_blocks"))).withColumn("lot", whole("n_lots")).select("bundle", "block", "lot", "leaf", "vec_id", "v")

    def one_block(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        names, leaf = np.unique(right["leaf"], return_inverse=True)
        allowed = np.stack([np.isin(names, some) for some in left["leaves"]])
        return pd.concat(_nearest(left["query_id"].to_numpy(), _matrix(left["q"]), right["vec_id"].to_numpy(), _matrix(right["v"]), k, allowed, leaf))

    found = probing.groupBy("bundle", "block", "lot").cogroup(held.groupBy("bundle", "block", "lot")).applyInPandas(one_block, FOUND)
    return _top(found.distinct(), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
