"""Paths of several steps with branches over node tables: a holistic twig join.

A twig is a path whose steps have a test, an axis and branches that must exist below them: ``item[q/@unit='R']`` or
``//a//b[c]/d``. All its steps are matched in one walk over the nodes that some step names, in document order, with a stack of
open ancestors; nothing is paired that isn't a match. The walk goes by blocks. Elements that reach over a block's edge are few
(its frame): what the blocks find below them is brought together, and each block then knows which of them match.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators import blocks
from quillspark.session import settled

#: Rows of blocks and matches that a task keeps, for blocks with equal rows.
KEPT_ROWS = 500_000


@dataclass(frozen=True)
class Step:
    """One step: the element's name (``None``: any), a condition on the node's own columns, and how it hangs below the step
    before: as a ``child`` or ``descendant``. ``branches`` must each have a match below it."""

    tag: str | None = None
    where: str | None = None
    axis: str = "descendant"
    branches: tuple[Step, ...] = field(default=())

    def having(self, *branches: Step) -> Step:
        return replace(self, branches=(*self.branches, *branches))

    def test(self) -> Column:
        named = F.lit(True) if self.tag is None else F.col("tag") == self.tag
        return F.coalesce((F.col("kind") == "e") & named & (F.lit(True) if self.where is None else F.expr(self.where)), F.lit(False))


def child(tag: str | None = None, where: str | None = None) -> Step:
    return Step(tag, where, "child")


def below(tag: str | None = None, where: str | None = None) -> Step:
    return Step(tag, where, "descendant")


@dataclass
class _Flat:
    """The steps of twigs in one list: each one's path first to last, its branches behind. ``need`` has each step's branches,
    ``paths`` the places of each twig's path."""

    steps: list[Step] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    need: list[int] = field(default_factory=list)
    paths: list[list[int]] = field(default_factory=list)

    @classmethod
    def of(cls, *paths: list[Step]) -> _Flat:
        flat = cls()
        for path in paths:
            own = list(range(len(flat.steps), len(flat.steps) + len(path)))
            flat.paths.append(own)
            flat.steps += path
            flat.parent += [-1, *own[:-1]]
            flat.need += [0] * len(path)
            todo = [(k, b) for k, s in zip(own, path, strict=True) for b in s.branches]
            while todo:
                k, step = todo.pop()
                flat.need[k] |= 1 << len(flat.steps)
                todo += [(len(flat.steps), b) for b in step.branches]
                flat.steps.append(step)
                flat.parent.append(k)
                flat.need.append(0)
        if len(flat.steps) > 63:
            raise ValueError(f"{len(flat.steps)} steps are too many for one walk")
        return flat

    def branches(self) -> int:
        """The steps on no path, as bits."""
        return ~sum(1 << k for own in self.paths for k in own)

    def children(self) -> int:
        """The steps that hang on their parents as children, as bits."""
        return sum(1 << k for k, s in enumerate(self.steps) if s.axis == "child")


def _satisfied(flat: _Flat, rows: list[tuple], known: dict[int, int], got: dict[int, list[int]], within: tuple[float, float]) -> tuple[dict[int, int], dict[int, list[int]]]:
    """Which steps each node satisfies with what is below it, as bits, and what was found below every node.

    ``rows`` are ``node_id, end_id, parent_id, mask`` in document order; ``known`` has the bits of nodes decided before,
    ``got`` what blocks found below nodes: branches matched by children, and by descendants. Only nodes that lie ``within`` are
    decided here; those that reach over an edge have more below them.
    """
    direct, sat, stack = flat.children(), {}, []
    branches = flat.branches()

    def close() -> None:
        node, end, parent, mask = stack.pop()
        by_child, by_any = got.setdefault(node, [0, 0])
        if node in known:
            sat[node] = known[node]
        elif within[0] <= node and end <= within[1]:
            have = (by_child & direct) | (by_any & ~direct)
            sat[node] = sum(1 << k for k in range(len(flat.steps)) if mask >> k & 1 and flat.need[k] & have == flat.need[k])
        own = sat.get(node, 0) & branches
        if stack:
            above = got.setdefault(stack[-1][0], [0, 0])
            above[1] |= own | by_any
            if stack[-1][0] == parent:
                above[0] |= own

    for row in rows:
        while stack and stack[-1][1] < row[0]:
            close()
        stack.append(row)
    while stack:
        close()
    return sat, got


def matches(nodes: DataFrame, path: list[Step], bind: int | None = None, span: int = blocks.SPAN) -> DataFrame:
    """``doc_id, node_id`` of the nodes that the last step of ``path`` matches, each once, or with ``context_id`` for each node
    that step number ``bind`` takes on the way there.

    ``nodes`` is a node table (``doc_id, node_id, end_id, parent_id, kind, tag`` and what conditions ask for), read twice. A
    first step that is a child is a root. Steps name elements; a node without a match gives no row.
    """
    return several(nodes, [(path, bind)], span).select("doc_id", "node_id", *([] if bind is None else ["context_id"]))


def several(nodes: DataFrame, twigs: list[tuple[list[Step], int | None]], span: int = blocks.SPAN) -> DataFrame:
    """``doc_id, node_id, twig, context_id``: what ``matches`` gives for each of several paths with their ``bind``, by number,
    from one walk. ``context_id`` is null where nothing is bound."""
    flat = _Flat.of(*[path for path, _ in twigs])
    mask = F.lit(0).cast("long")
    for k, step in enumerate(flat.steps):
        mask = mask.bitwiseOR(F.when(step.test(), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    named = nodes.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("node_id", "end_id", "parent_id")], mask.alias("mask")).where("mask <> 0")
    over_edge = blocks.block_of("node_id", span) != blocks.block_of("end_id", span)
    whole = named.where(over_edge).isEmpty()  # then each block decides alone
    dealt = blocks.framed(named, span).select("doc_id", "block", "node_id", "end_id", "parent_id", "mask")
    dealt = dealt if whole else settled(dealt)
    numbers = lambda block: (block * span, (block + 1) * span - 1)

    def first(key: tuple, rows: list[tuple]) -> list[tuple]:
        rows.sort()
        _, got = _satisfied(flat, rows, {}, {}, numbers(key[1]))
        return [(key[0], *r, *got[r[0]]) for r in rows if r[0] // span != r[1] // span]

    kind = nodes.schema["doc_id"].dataType
    long = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    out = lambda *names: T.StructType([T.StructField("doc_id", kind), *long(*names)])
    # Only documents that have nodes over an edge take part; the nodes that lie in one block decide alone.
    over = dealt.join(dealt.where(over_edge).select("doc_id").distinct(), "doc_id", "left_semi")
    found = blocks.walked(over, ["doc_id", "block"], first, out("node_id", "end_id", "parent_id", "mask", "by_child", "by_any")).groupBy("doc_id", "node_id").agg(*[F.max(c).alias(c) for c in ("end_id", "parent_id", "mask")], *[F.bit_or(c).alias(c) for c in ("by_child", "by_any")])

    def across(key: tuple, rows: list[tuple]) -> list[tuple]:
        nodes_ = sorted(r[:4] for r in rows)
        sat, _ = _satisfied(flat, nodes_, {}, {r[0]: list(r[4:]) for r in rows}, (float("-inf"), float("inf")))
        return [(key[0], r[0], sat[r[0]]) for r in nodes_]

    if whole:
        met = dealt.withColumn("sat", F.lit(None).cast("long"))
    else:
        decided = settled(blocks.walked(found.select("doc_id", "node_id", "end_id", "parent_id", "mask", "by_child", "by_any"), ["doc_id"], across, out("node_id", "sat")))
        met = dealt.join(decided.select(F.col("doc_id").alias("d_"), F.col("node_id").alias("n_"), "sat"), F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("node_id") == F.col("n_")), "left").drop("d_", "n_")

    kept: dict[tuple, list[tuple]] = {}
    held = [0]

    def second(key: tuple, found: list[tuple]) -> list[tuple]:
        """The matches of a block. They follow from its rows, so blocks with equal rows (documents of one shape) are walked once."""
        doc, block = key
        found.sort()
        mark = (block, *found)
        made = kept.get(mark)
        if made is None:
            made = walk(block, found)
            if held[0] < KEPT_ROWS:
                held[0] += len(found) + len(made)
                kept[mark] = made
        return [(doc, *m) for m in made]

    def walk(block: int, found: list[tuple]) -> list[tuple]:
        rows, known = [r[:4] for r in found], {r[0]: r[4] for r in found if r[4] is not None}
        sat, _ = _satisfied(flat, rows, known, {}, numbers(block))
        made = []
        stack: list[tuple[int, int, int, int, dict[int, list[int]]]] = []  # node, end, steps reached, those of ancestors too, contexts
        for node, end, parent, _ in rows:
            while stack and stack[-1][1] < node:
                stack.pop()
            top = stack[-1] if stack else None
            reached, ways, own = 0, {}, sat.get(node, 0)
            for twig, (path, (_, bind)) in enumerate(zip(flat.paths, twigs, strict=True)):
                for at, k in enumerate(path):
                    if not own >> k & 1:
                        continue
                    up = flat.parent[k]
                    if up < 0:
                        if flat.steps[k].axis == "child" and parent is not None:
                            continue
                    elif top is None or not (top[2] >> up & 1 and top[0] == parent if flat.steps[k].axis == "child" else top[3] >> up & 1):
                        continue
                    reached |= 1 << k
                    if bind is not None and at >= bind:
                        if at == bind:
                            ways[k] = [node]
                        elif flat.steps[k].axis == "child":
                            ways[k] = top[4].get(up, [])
                        else:
                            ways[k] = sorted({c for entry in stack for c in entry[4].get(up, [])})
                if reached >> path[-1] & 1 and node // span == block:
                    made += [(node, twig, None)] if bind is None else [(node, twig, c) for c in ways[path[-1]]]
            stack.append((node, end, reached, reached | (top[3] if top else 0), ways))
        return made

    return blocks.walked(met.select("doc_id", "block", "node_id", "end_id", "parent_id", "mask", "sat"), ["doc_id", "block"], second, out("node_id", "twig", "context_id"))


def picked(found: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Matches with columns of their nodes. Both sides grow with the nodes, so neither is ever sent to all tasks: by its
    compressed bytes Spark would take a table of some hundred MB for a small one."""
    own = nodes.select(F.col("doc_id").alias("d_"), F.col("node_id").cast("long").alias("n_"), *columns)
    return found.hint("merge").join(own, (F.col("doc_id") == F.col("d_")) & (F.col("node_id") == F.col("n_"))).drop("d_", "n_")


def placed(found: DataFrame) -> DataFrame:
    """Matches (with ``parent_id``) with ``pos`` and ``size``: their place among the matches under one parent, as positions in
    predicates count, and how many there are."""
    under = Window.partitionBy("doc_id", "parent_id")
    return found.withColumn("pos", F.row_number().over(under.orderBy("node_id"))).withColumn("size", F.count("*").over(under))
