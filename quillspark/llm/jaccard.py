"""N-gram Jaccard join: near-duplicate components by shingle sets, searched with R-trees over count vectors.

Shingles are hashed into groups and a document's set becomes a point of group counts. For two sets the overlap is at
most the sum of the coordinate minima, and for a set and a box of an R-tree at most that of the set and the box's
upper corner; with the sizes known, nodes and pairs that can't reach the wanted similarity are cut, and the pairs that
survive are verified on the sets.

What has to meet is found first: two sets of similarity 0.8 share one of the first ``n - ceil(0.8 n) + 1`` shingles of
each, in any order that all documents share. The order used puts frequent shingles last (a count sketch of all shingles
of all documents says which), so that a passage that many documents share brings nobody together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import kernels
from quillspark.llm.shared import components, content_keys, packed, small, stash

#: Links need ``100 * intersection >= PERCENT * union``.
PERCENT = 80
#: Groups that shingles are hashed into; children of an R-tree node.
GROUPS, FAN = 64, 32
#: Shingles a group holds on average at most.
LOAD = 8
#: Rows of a bucket up to which all pairs' bounds are cheaper than a tree.
FEW = 32
#: Cells of the frequency sketch; a shingle is frequent if its cell counts this many times the mean.
CELLS, FREQUENT = 1 << 18, 4
#: Sets of a bucket up to which it is searched; those of a larger one go to verification as one cluster.
BUCKET = 20_000
#: Shingles that are compared with a set at a time.
SLICE = 1 << 19
#: Bytes of count vectors that are searched at a time (whole buckets).
HELD = 8 << 20
#: Bytes of sets that one task verifies; larger clusters fall into blocks.
BLOCK = 16 << 20


def needed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Least overlap of sets of sizes a and b that link: 100 o >= P (a + b - o)."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_length(n: int) -> int:
    """Shingles of a set of n of which a linked set shares at least one."""
    return n - -(-PERCENT * n // 100) + 1


def count_vector(shingles: np.ndarray) -> np.ndarray:
    """Counts of shingles by group, as bytes: GROUPS groups, doubled until a group holds few, so the bound stays sharp for long texts."""
    group = (shingles >> np.uint64(20)).astype(np.int64)
    n = GROUPS
    while len(shingles) > LOAD * n:
        n *= 2
    while True:
        counts = np.bincount(group & (n - 1), minlength=n)
        if counts.max(initial=0) < 256:
            return counts.astype(np.uint8)
        n *= 2


def folded(vector: np.ndarray, groups: int) -> np.ndarray:
    """The counts for fewer groups."""
    return vector.reshape(-1, groups).sum(axis=0, dtype=np.int32)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> int:
    groups = min(len(a), len(b))
    return int(np.minimum(folded(a, groups), folded(b, groups)).sum())


class RTree:
    """A packed R-tree over count vectors: rows sorted by size and then by their largest spread, FAN rows to a box."""

    def __init__(self, vectors: list[np.ndarray]) -> None:
        self.vectors = vectors
        self.points = points = np.stack([folded(v, GROUPS) for v in vectors])
        self.sizes = sizes = points.sum(axis=1)
        self.groups = np.array([len(v) for v in vectors])
        self.finer: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.order = self._packed(np.arange(len(points)))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        upper, least, most = points[self.order], sizes[self.order], sizes[self.order]
        while True:
            cuts = np.arange(0, len(upper), FAN)
            upper, least, most = np.maximum.reduceat(upper, cuts), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)
            self.levels.append((upper, least, most))
            if len(cuts) == 1:
                break

    def _packed(self, rows: np.ndarray) -> np.ndarray:
        """Rows in an order in which neighbours are near: halved along the coordinate that spreads most."""
        out, todo = [], [rows[np.argsort(self.sizes[rows], kind="stable")]]
        while todo:
            some = todo.pop()
            if len(some) <= FAN:
                out.append(some)
                continue
            p = self.points[some]
            axis = int((p.max(axis=0) - p.min(axis=0)).argmax())
            half = -(-len(some) // 2 // FAN) * FAN or FAN
            split = some[np.argsort(p[:, axis], kind="stable")]
            todo += [split[half:], split[:half]]
        return np.concatenate(out)

    def reach(self, i: int, wanted: np.ndarray) -> np.ndarray:
        """Rows among ``wanted`` (a mask) that may link with row i by the bound on their overlap."""
        q, n = self.points[i], int(self.sizes[i])
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, least, most = self.levels[depth]
            near = (100 * most[nodes] >= PERCENT * n) & (PERCENT * least[nodes] <= 100 * n)
            nodes = nodes[near]
            if len(nodes):
                nodes = nodes[np.minimum(upper[nodes], q).sum(axis=1) >= needed(np.maximum(least[nodes], -(-PERCENT * n // 100)), n)]
            below = len(self.levels[depth - 1][0]) if depth else len(self.order)
            nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
            nodes = nodes[nodes < below]
        rows = self.order[nodes]
        rows = rows[wanted[rows]]
        rows = rows[np.minimum(self.points[rows], q).sum(axis=1) >= needed(self.sizes[rows], n)]
        if self.groups[i] == GROUPS or not len(rows):
            return rows
        common = np.minimum(self.groups[rows], self.groups[i])
        return np.concatenate([rows[common == g][self._overlaps(i, rows[common == g], g) >= needed(self.sizes[rows[common == g]], n)] for g in np.unique(common)])

    def _overlaps(self, i: int, rows: np.ndarray, groups: int) -> np.ndarray:
        """Bounds on row i's overlaps from vectors of so many groups, which are folded once for all rows that have them."""
        if groups == GROUPS:
            return np.minimum(self.points[rows], self.points[i]).sum(axis=1)
        if groups not in self.finer:
            have = np.flatnonzero(self.groups >= groups)
            place = np.full(len(self.groups), -1)
            place[have] = np.arange(len(have))
            self.finer[groups] = place, np.stack([folded(self.vectors[r], groups) for r in have]).astype(np.int16 if LOAD * 16 * self.groups.max() / groups < 30_000 else np.int32)
        place, matrix = self.finer[groups]
        return np.minimum(matrix[place[rows]], matrix[place[i]]).sum(axis=1, dtype=np.int64)


def reachable(tree: RTree) -> np.ndarray:
    """Components of the graph of pairs that the bound lets pass: each row once searched, among rows not yet reached."""
    label = np.full(len(tree.points), -1)
    free = np.ones(len(tree.points), bool)
    for seed in range(len(label)):
        if not free[seed]:
            continue
        free[seed] = False
        label[seed], todo = seed, [seed]
        while todo and free.any():
            found = tree.reach(todo.pop(), free)
            free[found] = False
            label[found] = seed
            todo += found.tolist()
    return label


def few(vectors: list[np.ndarray]) -> np.ndarray:
    """The same for so few rows that a tree would be one box."""
    points = np.stack([folded(v, GROUPS) for v in vectors])
    sizes = points.sum(axis=1)
    near = np.minimum(points[:, None], points[None]).sum(axis=2) >= needed(sizes[:, None], sizes[None])
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        if min(len(vectors[i]), len(vectors[j])) > GROUPS:
            near[i, j] = near[j, i] = overlap_bound(vectors[i], vectors[j]) >= needed(sizes[i], sizes[j])
    np.fill_diagonal(near, True)
    label = np.arange(len(points))
    while True:
        least = np.where(near, label[None], len(points)).min(axis=1)
        if (least == label).all():
            return label
        label = least


def linked(sets: list[np.ndarray], tree: RTree, across: np.ndarray | None = None) -> np.ndarray:
    """Components of verified links; pairs that are connected already are not verified. ``across``: only pairs of different sides."""
    part = np.arange(len(sets))  # each row's component so far
    sizes = np.array([len(s) for s in sets])
    later = np.ones(len(sets), bool)
    for i in range(len(sets)):
        later[i] = False
        wanted = later & (part != part[i])
        if across is not None:
            wanted &= across != across[i]
        if not wanted.any():
            continue
        rows = tree.reach(i, wanted)
        while len(rows):  # in slices of bounded size; what a slice connects is not verified again
            some = max(1, int(np.searchsorted(np.cumsum(sizes[rows]), SLICE)))
            rows, rest = rows[:some], rows[some:]
            joined = np.concatenate([sets[r] for r in rows])
            at = np.searchsorted(sets[i], joined)
            same = sets[i][np.minimum(at, len(sets[i]) - 1)] == joined
            starts = np.concatenate([[0], np.cumsum(sizes[rows])[:-1]])
            overlap = np.add.reduceat(same.astype(np.int64), starts)
            met = np.unique(part[rows[overlap >= needed(sizes[rows], sizes[i])]])
            if len(met):
                met = np.append(met, part[i])
                part[np.isin(part, met)] = met.min()
            rows = rest[part[rest] != part[i]]
    return part


# ---------------------------------------------------------------- stages

def _sketch(docs: DataFrame) -> np.ndarray:
    """Counts of all shingles of all documents by hash cell: one fixed-size array per task, summed in pieces."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, _, data, offsets in kernels.texts(batch.column("text")):
                hashes, starts, _ = kernels.words(data, offsets, lower=True)
                grams, _ = kernels.windows(hashes, starts)
                total += np.bincount((grams >> np.uint64(40)).astype(np.int64) & (CELLS - 1), minlength=CELLS)
        pieces = total.reshape(64, -1)
        yield pa.RecordBatch.from_pydict({"piece": list(range(64)), "counts": [p.tolist() for p in pieces]})

    def add(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"piece": [key[0]], "counts": [np.sum(np.stack(f["counts"]), axis=0)]})

    parts = docs.mapInArrow(count, "piece long, counts array<long>")
    summed = parts.groupBy("piece").applyInPandas(add, "piece long, counts array<long>").collect()  # CELLS numbers in all
    return np.concatenate([np.asarray(r["counts"]) for r in sorted(summed, key=lambda r: r["piece"])]) if summed else np.zeros(CELLS, np.int64)


def _profiles(docs: DataFrame) -> DataFrame:
    """Per row: content keys, set size, set fingerprint (two longs, the first one names the set), prefix tokens and count vector."""
    spark = docs.sparkSession
    counts = _sketch(docs.select("text"))
    often = counts > FREQUENT * max(1.0, counts.mean())
    shared = spark.sparkContext.broadcast(np.packbits(often))  # CELLS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            n, f1, f2, tokens, vector = [], [], [], [], []
            for _, _, data, offsets in kernels.texts(batch.column("text")):
                for s in kernels.shingle_sets(data, offsets):
                    n.append(len(s))
                    f1.append(int((kernels.mix(s + np.uint64(1)).sum(dtype=np.uint64) + np.uint64(len(s))).astype(np.int64)))
                    f2.append(int(kernels.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                    if len(s):
                        rank = (s >> np.uint64(1)) | (late[(s >> np.uint64(40)).astype(np.int64) & (CELLS - 1)].astype(np.uint64) << np.uint64(63))
                        k = prefix_length(len(s))
                        first = s if k >= len(s) else s[np.argpartition(rank, k - 1)[:k]]
                        tokens.append(np.unique((first & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)))
                        vector.append(count_vector(s).tobytes())
                    else:
                        tokens.append(np.zeros(0, np.int32))
                        vector.append(None)
            keep = [batch.column(c) for c in ("doc_id", "k1", "k2")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(tokens, pa.list_(pa.int32())), pa.array(vector, pa.binary())], names=["doc_id", "k1", "k2", "n", "f1", "f2", "tokens", "vector"])

    return stash(docs.mapInArrow(run, "doc_id long, k1 long, k2 long, n long, f1 long, f2 long, tokens array<int>, vector binary"), "profiles")


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    return zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def _clusters(profiles: DataFrame) -> DataFrame:
    """``node, root`` of candidate clusters: sets that the bound connects inside some shared prefix token.

    A bucket of more than BUCKET sets (a large group of near copies) is one cluster as it is: its sets hang on the least
    of them, so no task gets a hot token, and the trees of the verifying stage do its search.
    """
    sets = profiles.where("n > 0").groupBy("f1").agg(F.first("tokens").alias("tokens"), F.first("vector").alias("vector"))
    sets = stash(sets, "sets")
    pairs = sets.select(F.explode("tokens").alias("token"), "f1")
    # Buckets of the same members give the same pairs: of those the one with the smallest token is searched.
    buckets = pairs.groupBy("token").agg(F.count("*").alias("c"), F.min("f1").alias("least"), F.bit_xor(F.xxhash64("f1")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(7), "f1")).alias("x2")).where("c > 1")
    shared = stash(buckets.groupBy("c", "x1", "x2").agg(F.min(F.struct("token", "least")).alias("t")).select("t.token", "t.least", "c"), "buckets")
    # Rows of fixed size; beyond the bound the pairs are dealt out by token once more.
    hot, usual = small(shared.where(F.col("c") > BUCKET), 300_000), small(shared.where(F.col("c") <= BUCKET).select("token"), 500_000)
    stars = pairs.join(hot, "token").select(F.col("f1").alias("a"), F.col("least").alias("b"))
    members = pairs.join(usual, "token").join(sets.select("f1", "vector"), "f1").select("token", "f1", "vector")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
            token = table.column("token").to_numpy()
            end = len(token) if last else int(np.searchsorted(token, token[-1]))
            node = table.column("f1").to_numpy()
            raw = table.column("vector").to_pylist()
            a, b = [], []
            for lo, hi in _runs(token[:end]) if end else ():
                if hi - lo < 2:
                    continue
                vectors = [np.frombuffer(v, np.uint8) for v in raw[lo:hi]]
                label = few(vectors) if hi - lo <= FEW else reachable(RTree(vectors))
                rest = np.flatnonzero(label != np.arange(hi - lo))
                a += node[lo + rest].tolist()
                b += node[lo + label[rest]].tolist()
            made = pd.DataFrame({"a": a, "b": b}, dtype="int64").drop_duplicates()
            return (pa.RecordBatch.from_pandas(made, preserve_index=False) if len(made) else None), table.slice(end)

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= HELD:
                out, rest = flush(pa.Table.from_batches(held), False)
                if out is not None:
                    yield out
                held, size = rest.combine_chunks().to_batches(), rest.nbytes
        if held:
            out, _ = flush(pa.Table.from_batches(held), True)
            if out is not None:
                yield out

    edges = members.repartition("token").sortWithinPartitions("token").mapInArrow(search, "a long, b long")
    return components(edges.unionByName(stars))


def _linked_in(rows: DataFrame, key: list[str], side: str | None = None) -> DataFrame:
    """``a, b``: verified links that connect the sets of each group of ``key``; with ``side``, links across sides only."""

    def verify(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("node", kind="stable")
        found = [np.frombuffer(g, np.uint64) for g in f["grams"]]
        across = f[side].to_numpy() if side and f[side].nunique() > 1 else None
        if side and across is None and not key[-1]:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        label = linked(found, RTree([count_vector(s) for s in found]), across)
        nodes = f["node"].to_numpy()
        rest = label != np.arange(len(label))
        return pd.DataFrame({"a": nodes[rest], "b": nodes[label[rest]]})

    return rows.groupBy(*key).applyInPandas(verify, "a long, b long")


def _verified(docs: DataFrame, profiles: DataFrame, clusters: DataFrame) -> DataFrame:
    """``node, root`` of components of verified links.

    A cluster of at most BLOCK bytes is one group. In a larger one each block meets itself and the first block; what
    these links leave outside the cluster's largest component then meets all blocks. Pairs inside one component need no
    look, so a group of near copies costs as many tasks as it has blocks.
    """
    weights = profiles.where("n > 0").groupBy("f1").agg(F.first("n").alias("n"), F.min(F.struct("k1", "k2")).alias("k"))
    clusters = stash(clusters.join(weights, F.col("f1") == F.col("node")).select("node", "root", "n", "k.k1", "k.k2"), "clusters")
    sizes = clusters.groupBy("root").agg(F.ceil(F.sum("n") * 8 / BLOCK).cast("int").alias("blocks"))
    wanted = stash(clusters.join(sizes, "root").drop("n"), "wanted")
    texts = docs.join(small(wanted, 500_000), ["k1", "k2"]).dropDuplicates(["node"]).select("text", "root", "node", "blocks")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for _, _, data, offsets in kernels.texts(batch.column("text")) for s in kernels.shingle_sets(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column("root"), batch.column("node"), batch.column("blocks"), kernels.binary(found)], names=["root", "node", "blocks", "grams"])

    rows = texts.mapInArrow(sets, "root long, node long, blocks int, grams binary")
    if not (large := sizes.where("blocks > 1").select("root")).isEmpty():
        rows = stash(rows, "sets")
    mine = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meets = F.when(F.col("mine") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("mine", F.lit(-1)))
    dealt = mine.withColumn("other", F.explode(meets)).withColumn("block", F.when(F.col("other") < 0, F.col("mine")).otherwise(F.col("other")))
    # A block's own group has its sets alone; the group where it meets the first block has both as sides.
    dealt = dealt.withColumn("own", (F.col("other") == F.col("mine")))
    first = components(_linked_in(dealt.select("root", "block", "own", "node", "grams", "mine"), ["root", "block", "own"], "mine"))
    if large.isEmpty():
        return first
    first = stash(first, "first")
    part = F.coalesce(F.col("part"), F.col("node"))
    named = stash(clusters.join(large, "root").join(first.withColumnRenamed("root", "part"), "node", "left").select("root", "node", "n", part.alias("part")), "named")
    largest = named.groupBy("root", "part").agg(F.count("*").alias("c")).groupBy("root").agg(F.max_by("part", F.struct("c", "part")).alias("part"))
    outside = named.join(largest, ["root", "part"], "left_anti")
    lots = outside.groupBy("root").agg(F.ceil(F.sum("n") * 8 / BLOCK).cast("int").alias("lots"))
    whole = mine.join(lots, "root").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).select("root", F.col("mine").alias("block"), "lot", F.lit(1).alias("side"), "node", "grams")
    alone = mine.join(lots, "root").join(outside.select("node"), "node", "left_semi").withColumn("lot", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("lots")).cast("int"))
    alone = alone.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("root", "block", "lot", F.lit(0).alias("side"), "node", "grams")
    second = _linked_in(whole.unionByName(alone).withColumn("own", F.lit(False)), ["root", "block", "lot", "own"], "side")
    return components(second.unionByName(first.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row, its content keys ``k1, k2`` and a name ``root`` of its component.

    Documents with equal sets are one node from the start, whatever their number. Null and empty texts, and texts
    without a word, have an empty set and stand alone; so does a row without doc_id only if nothing links it (its
    own component id is then null). Repeated rows fall into one component. Extra columns are ignored.
    """
    k1, k2 = content_keys()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), k1.alias("k1"), k2.alias("k2"))
    profiles = _profiles(rows)
    found = _verified(rows.select("text", "k1", "k2"), profiles, _clusters(profiles))
    nodes = profiles.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("least"))
    named = nodes.join(found, F.col("f1") == F.col("node"), "left").withColumn("root", F.coalesce("root", "f1"))
    lowest = stash(named.groupBy("root").agg(F.min("least").alias("component_id")), "lowest")
    table = stash(named.join(lowest, "root").select("f1", "f2", "component_id", "root"), "named")
    rest = profiles.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "k1", "k2", F.lit(None).cast("long").alias("root"))
    return profiles.where("n > 0").join(table, ["f1", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "k1", "k2", "root").unionByName(rest)


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay if one document of each component stays: the one with the smallest doc_id.

    Of repeated rows of that document one stays. Rows without a set stay. Columns are unchanged, whatever their names.
    """
    k1, k2 = content_keys()
    found = near_duplicates(docs)
    kept = found.where((F.col("n_shingles") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id")))
    least = kept.where("n_shingles > 0").groupBy("doc_id", "root").agg(F.min(F.struct("k1", "k2")).alias("k"), F.count("*").alias("n"))
    least = stash(least.select(F.col("doc_id").alias("least_id"), "k.k1", "k.k2", "n"), "kept")
    words = F.regexp_like(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]"))
    rows = packed(docs, k1=k1, k2=k2, id=F.col("doc_id").cast("long"), words=words)
    full = rows.where("words").join(small(least, 2_000_000), ["k1", "k2"]).where(F.col("id").eqNullSafe(F.col("least_id")))
    several = full.where("n > 1").dropDuplicates(["id", "k1", "k2"])
    return full.where("n = 1").select("row").unionByName(several.select("row")).unionByName(rows.where("not words").select("row")).select("row.*")


__all__ = ["RTree", "near_duplicates", "representatives", "linked", "reachable"]
