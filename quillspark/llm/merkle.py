"""Merkle manifest of a dataset: a tree of digests for each source, a tree over their roots, proofs, and audits of copies.

Leaves of a tree are numbered across range partitions. Each partition runs a stack of unfinished runs over its leaves: a
run that is full is hashed and carried to the level above, as a digit is carried in base FANOUT. What a partition can't
finish, because a run reaches beyond its edge, is merged with that of its neighbours, MERGED partitions at a time, until
nothing is open. A last run is hashed as short as it is, without padding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import Scratch, small

#: Children of a node, leaves of a partition, partitions that one task of a merging round takes.
FANOUT, PART_ROWS, MERGED = 3, 200_000, 64
#: The parts of a leaf, in order.
PARTS = ["doc_id", "source", "lang", "n_chars", "text"]
_RECORD = "tree string, leaves long, level int, idx long, digest binary, kind string, part long"
_SHIFT = 33  # bits of a row's place in its partition, as monotonically_increasing_id has them


def joined(digests: list[bytes]) -> bytes:
    """The digest of digests: SHA-256 of their hexadecimal texts, concatenated."""
    return hashlib.sha256("".join([d.hex() for d in digests]).encode()).digest()


def leaf_digest(values: dict[str, Column] | None = None) -> Column:
    """SHA-256 of PARTS, each as ``-`` if null, else as its bytes' number, a colon and itself; ``values`` replaces some."""
    pieces = []
    for name in PARTS:
        value = (values or {}).get(name, F.col(name)).cast("string")
        pieces.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*pieces), 256))


def sizes(leaves: int, fanout: int) -> list[int]:
    """Nodes of each level, leaves first; the last is the root."""
    out = [leaves]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


class Range:
    """The stack of one tree in one partition, or in several that are merged.

    Nodes are pushed from left to right. ``waiting[level]`` holds the run that is not finished yet at a level.
    """

    def __init__(self, leaves: int, fanout: int) -> None:
        self.sizes, self.fanout = sizes(leaves, fanout), fanout
        self.waiting: list[list[tuple[int, bytes]]] = [[] for _ in self.sizes]
        self.made: dict[tuple[int, int], bytes] = {}
        self.open: set[tuple[int, int]] = set()
        self.edges: list[tuple[int, int, bytes]] = []
        self.root: bytes | None = None

    def push(self, level: int, idx: int, digest: bytes) -> None:
        while True:
            size = self.sizes[level]
            if size == 1:
                self.root = digest
                return
            run = self.waiting[level]
            if run and run[0][0] // self.fanout != idx // self.fanout:
                self.leave(level)
            run.append((idx, digest))
            first = idx - idx % self.fanout
            last = min(first + self.fanout, size) - 1
            if idx < last:
                return
            if len(run) <= last - first:  # it began in a partition to the left
                self.leave(level)
                return
            digest = joined([d for _, d in run])
            run.clear()
            level, idx = level + 1, idx // self.fanout
            self.made[level, idx] = digest

    def leave(self, level: int) -> None:
        self.edges += [(level, idx, d) for idx, d in self.waiting[level]]
        self.waiting[level].clear()

    def close(self) -> None:
        for level in range(len(self.sizes)):
            self.leave(level)
        self.open = {(level, idx) for level, idx, _ in self.edges}


def _slices(keys: list) -> Iterator[tuple[int, int]]:
    start = 0
    for k in range(1, len(keys) + 1):
        if k == len(keys) or keys[k] != keys[start]:
            yield start, k
            start = k


def _grown(fanout: int, part_of=lambda part: part // MERGED):
    """Records of one partition (or of a group of them): nodes made, open edges, and roots of trees that are finished."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_pylist() for c in ("tree", "leaves", "level", "idx", "digest")}
        trees, level, idx = columns["tree"], columns["level"], columns["idx"]
        order = sorted(range(len(idx)), key=lambda k: (trees[k] is not None, trees[k] or "", idx[k] * fanout ** level[k]))
        trees = [trees[k] for k in order]
        out: list[tuple] = []
        part = part_of(key[0].as_py())
        for lo, hi in _slices(trees):
            rows = order[lo:hi]
            leaves = columns["leaves"][rows[0]]
            stack = Range(leaves, fanout)
            for k in rows:
                stack.push(level[k], idx[k], columns["digest"][k])
            stack.close()
            out += [(trees[lo], leaves, lv, i, d, "made", part) for (lv, i), d in stack.made.items()]
            out += [(trees[lo], leaves, lv, i, d, "edge", part) for lv, i, d in stack.edges]
            if stack.root is not None:
                out.append((trees[lo], leaves, len(stack.sizes) - 1, 0, stack.root, "root", part))
        types = [("tree", pa.string()), ("leaves", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.binary()), ("kind", pa.string()), ("part", pa.int64())]
        parts = list(zip(*out, strict=True)) or [()] * 7
        return pa.table([pa.array(v, t) for v, (_, t) in zip(parts, types, strict=True)], names=[n for n, _ in types])

    return run


class Forest:
    """Trees over the rows of a table ``tree, place, digest`` and others: one for each value of ``tree`` (null is one).

    Leaves ascend by ``place`` (nulls first), equal places by digest; repeated rows are leaves each. ``leaves`` has them with
    ``part, idx``; ``runs`` the stretch of each tree in each partition; ``nodes`` all inner nodes; ``roots`` a row for each tree.
    """

    def __init__(self, rows: DataFrame, scratch: Scratch, fanout: int = FANOUT, part_rows: int = PART_ROWS) -> None:
        spark = rows.sparkSession
        self.fanout, self.scratch = fanout, scratch
        parts = max(2 * spark.sparkContext.defaultParallelism, rows.count() // part_rows + 1)
        # Rows that are equal in all else are told apart by where they are read, so that they can be divided.
        keys = [F.col("tree").asc_nulls_first(), F.col("place").asc_nulls_first(), F.col("digest").asc(), F.col("read_at").asc()]
        ranged = rows.withColumn("read_at", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("read_at")
        numbered = ranged.withColumn("n", F.monotonically_increasing_id())
        leaves = scratch.put(numbered.withColumn("part", F.shiftright("n", _SHIFT)).withColumn("n", F.col("n").bitwiseAND((1 << _SHIFT) - 1)), "merkle-leaves")
        here = leaves.groupBy("part", "tree").agg(F.count("*").alias("here"), F.min("n").alias("first"))
        tree = Window.partitionBy("tree")
        before = F.sum("here").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        self.runs = scratch.put(here.select("part", "tree", "here", F.coalesce(before, F.lit(0)).alias("start"), F.sum("here").over(tree).alias("leaves"), "first"), "merkle-runs")
        run = small(self.runs.select(F.col("part").alias("p"), F.col("tree").alias("t"), "start", "leaves", "first"))
        self.leaves = leaves.join(run, (F.col("part") == F.col("p")) & F.col("tree").eqNullSafe(F.col("t"))).withColumn("idx", F.col("start") + F.col("n") - F.col("first")).drop("p", "t", "n", "first", "start")
        flat = self.leaves.select("part", "tree", "leaves", F.lit(0).alias("level"), "idx", "digest")
        found = [scratch.put(flat.groupBy("part").applyInArrow(_grown(fanout), _RECORD), "merkle-records")]
        groups = (self.runs.agg(F.max("part")).first()[0] or 0) + 1  # a session may deal out to more partitions than asked
        while groups > 1:  # ``part`` of a record is the group that merges it
            groups = -(-groups // MERGED)
            found.append(scratch.put(found[-1].where("kind = 'edge'").groupBy("part").applyInArrow(_grown(fanout), _RECORD), "merkle-records"))
        records = found[0]
        for more in found[1:]:
            records = records.unionByName(more)
        self.nodes = records.where("kind = 'made'").select("tree", "level", "idx", "digest")
        self.roots = records.where("kind = 'root'").select("tree", "leaves", "digest")
        # Nodes that other partitions may ask for: what the first round left open, and what later rounds made.
        self.seams = found[0].where("kind = 'edge'").select("tree", "level", "idx", "digest")
        for more in found[1:]:
            self.seams = self.seams.unionByName(more.where("kind = 'made'").select("tree", "level", "idx", "digest"))

    def frames(self) -> DataFrame:
        """``part, tree, level, idx, digest``: nodes beyond its edges that a partition needs for its leaves' proofs; at most
        two runs a level and tree."""
        fanout = self.fanout

        def asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = []
                for part, tree, start, here, leaves in zip(f["part"], f["tree"], f["start"], f["here"], f["leaves"], strict=True):
                    low, high = int(start), int(start) + int(here) - 1
                    for level, size in enumerate(sizes(int(leaves), fanout)[:-1]):
                        for run in {low // fanout, high // fanout}:
                            rows += [(part, tree, level, idx) for idx in range(run * fanout, min(run * fanout + fanout, size))]
                        low, high = low // fanout, high // fanout
                yield pd.DataFrame(rows, columns=["part", "tree", "level", "idx"])

        wanted = self.runs.mapInPandas(asked, "part long, tree string, level int, idx long")
        s = self.seams.select(F.coalesce(F.concat(F.lit("="), "tree"), F.lit("-")).alias("t"), "level", "idx", "digest")
        return wanted.withColumn("t", F.coalesce(F.concat(F.lit("="), "tree"), F.lit("-"))).join(s, ["t", "level", "idx"]).select("part", "tree", "level", "idx", "digest")


def _paths(leaves: pa.Table, frame: pa.Table, fanout: int) -> Iterator[tuple[str | None, int, list[tuple[str, str]]]]:
    """For each leaf of a partition, in the table's order of ``tree, idx``: its tree, its row, and the siblings to the left
    and to the right on each level, as hexadecimal text."""
    trees, numbers, counts, digests = (leaves.column(c).to_pylist() for c in ("tree", "idx", "leaves", "digest"))
    known: dict[str | None, dict[tuple[int, int], bytes]] = {}
    for tree, level, idx, digest in zip(*(frame.column(c).to_pylist() for c in ("tree", "level", "idx", "digest")), strict=True):
        known.setdefault(tree, {})[level, idx] = digest
    for lo, hi in _slices(trees):
        stack = Range(counts[lo], fanout)
        for k in range(lo, hi):
            stack.push(0, numbers[k], digests[k])
        nodes = known.get(trees[lo], {})
        nodes.update(stack.made)
        nodes.update(((0, numbers[k]), digests[k]) for k in range(lo, hi))
        above: dict[int, tuple[int, list[tuple[str, str]]]] = {}

        def path(level: int, idx: int, nodes=nodes, levels=stack.sizes, above=above) -> list[tuple[str, str]]:
            if level == len(levels) - 1:
                return []
            first = idx - idx % fanout
            own = ("".join(nodes[level, i].hex() for i in range(first, idx)), "".join(nodes[level, i].hex() for i in range(idx + 1, min(first + fanout, levels[level]))))
            if above.get(level, (-1,))[0] != first:  # neighbours share what is above them
                above[level] = (first, path(level + 1, idx // fanout))
            return [own, *above[level][1]]

        for k in range(lo, hi):
            yield trees[lo], k, path(0, numbers[k])


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by([("tree", "ascending"), ("idx", "ascending")])


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = hashlib.sha256((left + leaf + right).encode()).hexdigest()
    return leaf


def _crown(subroots: DataFrame, scratch: Scratch, fanout: int, part_rows: int) -> DataFrame:
    """``tree, subroot, root, lefts, rights`` for each source: the tree over all sources' roots, in order of the sources."""
    top = Forest(subroots.select(F.lit("all").alias("tree"), F.col("tree").alias("place"), "digest"), scratch, fanout, part_rows)

    def run(leaves: pa.Table, frame: pa.Table) -> pa.Table:
        leaves = _sorted(leaves)
        paths = [path for _, _, path in _paths(leaves, frame, fanout)]
        side = lambda k: pa.array([[level[k] for level in path] for path in paths], pa.list_(pa.string()))
        return pa.table([leaves.column("place"), leaves.column("digest"), side(0), side(1)], names=["tree", "subroot", "lefts", "rights"])

    found = top.leaves.select("part", "tree", "place", "idx", "leaves", "digest").groupBy("part").cogroup(top.frames().groupBy("part")).applyInArrow(run, "tree string, subroot binary, lefts array<string>, rights array<string>")
    root = top.roots.first()  # one row
    return scratch.put(found.withColumn("root", F.lit(None if root is None else bytes(root["digest"])).cast("binary")), "merkle-crown")


def manifest(docs: DataFrame, fanout: int = FANOUT, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """The manifest itself: all digests ``source, level, idx, digest`` (hexadecimal; level 0 are the leaves), and each
    source's root and the root of all, ``source, leaves, subroot, root``. See ``audited`` for order, nulls and repeats."""
    scratch = Scratch(docs.sparkSession)
    leaves = scratch.put(docs.select(F.col("source").cast("string").alias("tree"), F.col("doc_id").alias("place"), leaf_digest().alias("digest")), "merkle-rows")
    forest = Forest(leaves, scratch, fanout, part_rows)
    nodes = forest.leaves.select("tree", F.lit(0).alias("level"), "idx", "digest").unionByName(forest.nodes)
    crown = _crown(forest.roots, scratch, fanout, part_rows)
    counted = forest.roots.select(F.col("tree").alias("t"), "leaves")
    tops = crown.join(counted, F.col("tree").eqNullSafe(F.col("t")))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return nodes.select(F.col("tree").alias("source"), "level", "idx", text("digest")), tops.select(F.col("tree").alias("source"), "leaves", text("subroot"), text("root"))


def audited(docs: DataFrame, received: Column | None = None, fanout: int = FANOUT, part_rows: int = PART_ROWS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row of ``docs``.

    ``received`` is the text as it came back (by default the text itself): its leaf, folded with the original siblings, must
    give the root. ``proof_sha256`` is the digest of these siblings, level by level, from left to right.

    A null is a part of its own, unlike an empty text; a null source is a source, and its tree comes first. Rows of one
    source ascend by doc_id, nulls first; those of one doc_id by leaf, and equal rows are leaves each. An empty table gives
    no rows. Other columns are ignored. Texts are read once, each row is one of some 150 bytes from there on. A source of any
    size is divided across partitions; a partition needs at most two runs a level of nodes beyond its edges.
    """
    scratch = Scratch(docs.sparkSession)
    got = leaf_digest({"text": F.col("text").cast("string") if received is None else received})
    leaves = scratch.put(docs.select(F.col("source").cast("string").alias("tree"), F.col("doc_id").alias("place"), leaf_digest().alias("digest"), got.alias("received")), "merkle-rows")
    forest = Forest(leaves, scratch, fanout, part_rows)
    crown = _crown(forest.roots, scratch, fanout, part_rows)
    stretch = forest.runs.select("part", F.col("tree").alias("t"))
    above = stretch.join(small(crown), F.col("t").eqNullSafe(F.col("tree"))).select("part", "tree", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("idx"), F.col("subroot").alias("digest"), "root", "lefts", "rights")
    none = {"root": F.lit(None).cast("binary"), "lefts": F.lit(None).cast("array<string>"), "rights": F.lit(None).cast("array<string>")}
    frame = forest.frames().select("*", *[c.alias(n) for n, c in none.items()]).unionByName(above)

    def run(rows: pa.Table, frame: pa.Table) -> pa.Table:
        rows = _sorted(rows)
        tops, level = {}, frame.column("level").to_pylist()
        for top in frame.filter(pa.array([v == -1 for v in level], pa.bool_())).to_pylist():
            tops[top["tree"]] = (top["digest"].hex(), top["root"].hex(), list(zip(top["lefts"], top["rights"], strict=True)))
        frame = frame.filter(pa.array([v != -1 for v in level], pa.bool_()))
        digests, received = rows.column("digest").to_pylist(), rows.column("received").to_pylist()
        out: list[tuple] = []
        for tree, k, path in _paths(rows, frame, fanout):
            subroot, root, upper = tops[tree]
            path = path + upper
            proof = hashlib.sha256("".join([left + right for left, right in path]).encode()).hexdigest()
            found = folded(received[k].hex(), path)
            out.append((digests[k].hex(), subroot, root, proof, found, found == root))
        names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
        parts = list(zip(*out, strict=True)) or [()] * 6
        return pa.table([rows.column("place"), *[pa.array(p, pa.string()) for p in parts[:5]], pa.array(parts[5], pa.bool_())], names=["doc_id", *names, "verified"])

    kind = dict(docs.dtypes)[next(c for c in docs.columns if c.lower() == "doc_id")]
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    rows = forest.leaves.select("part", "tree", "place", "idx", "leaves", "digest", "received")
    return rows.groupBy("part").cogroup(frame.groupBy("part")).applyInArrow(run, schema)


def without_line_feeds() -> Column:
    """Texts as they come back where every second document (by the checksum of its id) has lost its line feeds."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return F.when(hit, F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))).otherwise(F.col("text").cast("string"))
