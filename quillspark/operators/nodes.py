"""Axes of interval-encoded trees, hierarchies from flat tables, outline numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import blocks
from quillspark.session import settled

_STEPS = {
    "child": "x.parent_id = c.node_id",
    "parent": "x.node_id = c.parent_id",
    "following-sibling": "x.parent_id = c.parent_id AND x.node_id > c.node_id",
    "preceding-sibling": "x.parent_id = c.parent_id AND x.node_id < c.node_id",
    "self": "x.node_id = c.node_id",
}


def axis(context: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """``context_id`` and the nodes on an axis of each context node.

    Axes of one step are equi-joins on document and parent or node; ``ancestor`` and ``descendant`` (``-or-self``) are
    structural merge joins by blocks. ``following`` and ``preceding`` pair almost all nodes of a document with each other:
    ``blocks.counts`` counts them without pairs.
    """
    if name in _STEPS:
        return context.alias("c").join(nodes.alias("x"), F.expr(f"x.doc_id = c.doc_id AND {_STEPS[name]}")).select(F.col("c.node_id").alias("context_id"), "x.*")
    way, _, too = name.partition("-or-")
    if way not in ("ancestor", "descendant"):
        raise ValueError(f"{name}: count with blocks.counts")
    found = blocks.holding(context, nodes, way)
    return found.unionByName(axis(context, nodes, "self")) if too else found


def siblings(nodes: DataFrame) -> DataFrame:
    """Neighbours under the same parent by window, without a join: ``prev_id, next_id``."""
    w = Window.partitionBy("doc_id", "parent_id").orderBy("node_id")
    return nodes.withColumn("prev_id", F.lag("node_id").over(w)).withColumn("next_id", F.lead("node_id").over(w))


def encode(edges: DataFrame) -> DataFrame:
    """Preorder intervals of a forest given as ``doc_id, path`` (array of sort keys from the root).

    A node's number is its rank by path, which ranges of paths find each for itself; its end is that number and those of the
    paths that begin with its own, counted once for each prefix; its parent has the path without the last key. All three are
    settled, so nothing is worked out twice. A repeated path is an error, since both would be one node.
    """
    ranked = settled(blocks.ranked(edges, "doc_id", "path", "node_id").withColumn("depth", F.size("path") - 1))
    if twice := ranked.groupBy("doc_id", "path").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect():
        raise ValueError(f"repeated path {twice[0]['path']} in {twice[0]['doc_id']}")
    prefixes = ranked.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))).alias("path"))
    sizes = prefixes.groupBy("doc_id", "path").agg((F.count("*") - 1).alias("below"))
    up = F.when(F.size("path") > 1, F.slice("path", F.lit(1), F.size("path") - 1))
    parents = ranked.select("doc_id", F.col("path").alias("up"), F.col("node_id").alias("parent_id"))
    out = ranked.join(sizes, ["doc_id", "path"]).withColumn("end_id", F.col("node_id") + F.col("below")).drop("below")
    return settled(out.withColumn("up", up).join(parents, ["doc_id", "up"], "left").drop("up"))


def outline_numbers(nodes: DataFrame) -> DataFrame:
    """Dotted numbers ``1.2.3``: each node's ordinal among its siblings behind those of its ancestors.

    A round numbers the children of the nodes numbered last by an equi-join on document and parent, so each node meets
    its parent only; numbering begins at nodes whose parent is not among ``nodes``. Each round is checkpointed.
    """
    w = Window.partitionBy("doc_id", "parent_id").orderBy("node_id")
    own = settled(nodes.select("doc_id", "node_id", "parent_id").withColumn("n", F.row_number().over(w).cast("string")))
    ids = own.select("doc_id", F.col("node_id").alias("parent_id"))
    level = out = settled(own.join(ids, ["doc_id", "parent_id"], "left_anti").select("doc_id", F.col("node_id").alias("context_id"), F.col("n").alias("outline")))
    while not level.isEmpty():
        above = level.select("doc_id", F.col("context_id").alias("parent_id"), F.col("outline").alias("up"))
        level = settled(own.join(above, ["doc_id", "parent_id"]).select("doc_id", F.col("node_id").alias("context_id"), F.concat_ws(".", "up", "n").alias("outline")))
        out = out.unionByName(level)
    return out


def depth_chunks(nodes: DataFrame, most: int, content: Column | None = None) -> DataFrame:
    """Nodes not deeper than ``most`` that are leaves at that depth; a parent with content before its first child also
    gives an intro: ``chunk_start, chunk_stop, synthetic``. Rows: the leaf or intro node. ``content`` says of a node whether
    it has content of its own there; by default every node has."""
    shallow = nodes.where(F.col("depth") <= most)
    first_child = shallow.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.min("node_id").alias("first_child"))
    marked = shallow.withColumn("own", F.lit(True) if content is None else content).join(first_child, ["doc_id", "node_id"], "left")
    leaf = F.col("first_child").isNull()
    return marked.where(leaf | F.col("own")).select("doc_id", "node_id", F.col("node_id").alias("chunk_start"), F.when(leaf, F.col("end_id")).otherwise(F.col("first_child") - 1).alias("chunk_stop"), (~leaf).alias("synthetic"))


def page_of(nodes: DataFrame, milestone: str = "pb") -> DataFrame:
    """The page of each node: a running count of page breaks, from 1 before the first counted break."""
    return blocks.running(nodes, "doc_id", "node_id", page=("sum", F.when(F.col("tag") == milestone, 1).otherwise(0)))
