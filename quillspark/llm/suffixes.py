"""Suffix-array deduplication: removal of every byte that lies in a string of 400 bytes which starts more than once.

What can repeat is narrowed first. Every 400-byte window has an anchor, the 32 bytes in it whose hash is least
(leftmost if equal), so equal windows have equal anchors at equal places. Windows with one anchor are consecutive: their
bytes are a context. Only contexts of anchors that occur again are kept, equal contexts are merged with their
number, and contexts of one anchor meet in one block. A block's repeats come from a Burrows-Wheeler transform: breadth
first, backward extension by one byte turns the boundaries between suffixes with common prefixes of length l into
those of length l + 1, until 400; what is then undivided repeats.

Contexts of an anchor that occurs too often for one block are divided across tasks: by how far their windows start
before the anchor, and then by the bytes that all these windows share. Equal windows stay together, and groups that are
still too large are divided again, down to single windows, which are all equal. So a group always fits in a block.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import kernels
from quillspark.llm.shared import Scratch, at_most, content_keys, packed, row_text, small, stash

#: Bytes of a repeated string, and of an anchor.
LENGTH, ANCHOR = 400, 32
#: Bytes of a block, and the most that one transform takes (positions have 20 bits).
BLOCK, MOST = 1 << 19, (1 << 20) - 2
#: Ways in which a group that is too large for a block is divided by the distance of its windows from the anchor.
WAYS = 8
#: Bytes of cuts that are broadcast at most.
CUT_BYTES = 24 << 20
_PLACE = np.uint64((1 << 28) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: text number, first and last start, anchor place; and the anchors' hashes, all over one run of texts."""
    n, none = len(data), np.zeros(0, np.int64)
    width = length - ANCHOR + 1
    if n < length:
        return none, none, none, none, np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(kernels.BYTE_CODES[data] * kernels.powers(n), out=sums[1:])
    hashes = kernels.mix((sums[ANCHOR:] - sums[:-ANCHOR]) * kernels.powers(n, True)[: n - ANCHOR + 1])
    packed = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        packed = np.minimum(packed[:-span], packed[span:])
        span *= 2
    least = np.minimum(packed[: len(packed) - (width - span)], packed[width - span :]) if width > span else packed
    place = (least & _PLACE).astype(np.int64)  # of the window starting at each byte
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
    first = np.concatenate([[0], np.cumsum(np.maximum(sizes - length + 1, 0))])
    starts = np.arange(len(owner)) + (offsets[:-1] - first[:-1])[owner]
    if not len(starts):
        return none, none, none, none, np.zeros(0, np.uint64)
    at = place[starts]
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]))
    end = np.concatenate([cut[1:], [len(starts)]]) - 1
    return owner[cut], starts[cut], starts[end], at[cut], hashes[at[cut]]


def suffix_order(text: np.ndarray, length: int) -> np.ndarray:
    """Positions of ``text`` (small ints, the last one unique and least) ordered by their first ``length`` or more symbols."""
    n = len(text)
    index = np.arange(n, dtype=np.uint64)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(4, np.uint64)])
    key = (padded[:n] << np.uint64(27)) | (padded[1 : n + 1] << np.uint64(18)) | (padded[2 : n + 2] << np.uint64(9)) | padded[3 : n + 3]
    low = np.uint64((1 << 20) - 1)
    size = 4
    while True:
        packed = np.sort((key << np.uint64(20)) | index)
        order = (packed & low).astype(np.int64)
        group = packed >> np.uint64(20)
        rank_sorted = np.cumsum(np.concatenate([[True], group[1:] != group[:-1]])).astype(np.uint64)  # from 1
        if size >= length or rank_sorted[-1] == n:
            return order
        rank = np.zeros(n + size, np.uint64)
        rank[order] = rank_sorted
        key = (rank[:n] << np.uint64(20)) | rank[size : size + n]
        size *= 2


def repeated(data: np.ndarray, valid: np.ndarray, weight: np.ndarray, length: int = LENGTH, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """For each byte of a block, whether the string of ``length`` bytes from it starts at least twice by weight.

    ``valid`` marks bytes that start such a string of their own text; ``weight`` is how often their text counts. With
    ``rank``, the bytes' order, the second result marks those of them that come after an equal string.
    """
    text = np.concatenate([data.astype(np.int64) + 1, [0]])
    n = len(text)
    order = suffix_order(text, length)
    before = text[order - 1]  # the transform; position 0 is preceded by the last symbol
    by_symbol = np.argsort(before.astype(np.uint16), kind="stable")
    to = np.empty(n, np.int64)
    to[by_symbol] = np.arange(n)
    previous = np.full(n, -1, np.int64)
    same = before[by_symbol[1:]] == before[by_symbol[:-1]]
    previous[by_symbol[1:][same]] = by_symbol[:-1][same]
    boundary = np.zeros(n + 1, bool)
    boundary[n] = boundary[0] = True
    first = text[order]
    boundary[1:n] = first[1:] != first[:-1]
    frontier = np.flatnonzero(boundary[:n])
    for _ in range(1, length):
        if not len(frontier):
            break
        edges = np.flatnonzero(boundary)
        end = edges[np.searchsorted(edges, frontier) + 1]
        wide = end - frontier
        at = np.repeat(frontier - np.concatenate([[0], np.cumsum(wide)[:-1]]), wide) + np.arange(wide.sum())
        at = at[previous[at] < np.repeat(frontier, wide)]  # the first of each symbol in its interval
        reached = to[at]
        frontier = np.sort(reached[~boundary[reached]])
        boundary[frontier] = True
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(boundary[:n]) - 1
    group = group[:-1]
    total = np.bincount(group, weights=np.where(valid, weight, 0).astype(np.float64))
    again = (total[group] >= 2) & valid
    if rank is None:
        return again, None
    least = np.full(len(total), np.iinfo(np.int64).max)
    np.minimum.at(least, group[again], rank[again])
    return again, again & (rank > least[group])


def ranges(mask: np.ndarray) -> list[int]:
    """First and last index of each run of true, flat."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    edge[1::2] -= 1
    return edge.tolist()


def narrowed(contexts: list[tuple], length: int = LENGTH) -> list[tuple]:
    """Contexts ``(name, bytes, weight, lead)`` of whole groups that hold a window whose hash occurs again, cut to the windows between the
    first and the last such one, with the bytes cut off before. Equal windows have equal hashes, so nothing that repeats is lost."""
    data = np.frombuffer(b"".join(c[1] for c in contexts), np.uint8)
    n, sizes = len(data), np.array([len(c[1]) for c in contexts])
    at = np.cumsum(sizes) - sizes
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(kernels.BYTE_CODES[data] * kernels.powers(n), out=sums[1:])
    owner = np.repeat(np.arange(len(sizes)), sizes - length + 1)
    start = np.arange(len(owner)) + np.arange(len(sizes))[owner] * (length - 1)
    hashes = kernels.mix((sums[start + length] - sums[start]) * kernels.powers(n, True)[start])
    low = np.uint64((1 << 20) - 1)
    packed = np.sort((hashes & ~low) | np.arange(len(owner), dtype=np.uint64))
    same = (packed[1:] ^ packed[:-1]) <= low
    index = (packed & low).astype(np.int64)
    again = np.repeat(np.array([c[2] for c in contexts]) >= 2, sizes - length + 1)
    again[index[1:][same]] = again[index[:-1][same]] = True
    found = np.flatnonzero(again)
    if not len(found):
        return []
    of = owner[found]
    new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    which, first, last = of[new], start[found[new]], start[found[np.concatenate([new[1:], [len(found)]]) - 1]]
    return [(*contexts[k][:1], contexts[k][1][a : b + length], *contexts[k][2:], a) for k, a, b in zip(which.tolist(), (first - at[which]).tolist(), (last - at[which]).tolist(), strict=True)]


class Blocks:
    """Collects groups of contexts and finds the starts in them that repeat.

    A context is ``(name, bytes, weight, lead)``: ``lead`` is its first place as ``(id, k1, k2, start)``. ``found`` gets
    for each name the runs of starts that repeat, and those runs without the first place of each string. Groups are narrowed
    some at a time to what may repeat; what is left of them fills the blocks that are transformed.
    """

    def __init__(self, length: int = LENGTH, first: bool = False) -> None:
        self.length, self.first, self.open, self.size = length, first, [], 0
        self.waiting: list[list[tuple]] = []
        self.held = 0
        self.found: list[tuple] = []

    def add(self, group: list[tuple]) -> None:
        """All distinct contexts of one group; a single one that counts once has no repeats across groups or inside."""
        if len(group) == 1 and not self.first and group[0][2] >= 2:
            runs = [0, len(group[0][1]) - self.length]
            self.found.append((group[0][0], runs, runs))
            return
        if len(group) == 1 and group[0][2] < 2:
            return
        size = sum(len(c[1]) for c in group)
        if self.held + size > BLOCK and self.waiting:
            self._narrow()
        self.waiting.append(group)
        self.held += size
        if self.held > BLOCK:
            self._narrow()

    def _narrow(self) -> None:
        """Waiting groups, narrowed, go to the block; what is left of them fits in one, and none is divided."""
        left = narrowed([c for group in self.waiting for c in group], self.length) if self.waiting else []
        self.waiting, self.held = [], 0
        size = sum(len(c[1]) for c in left)
        if self.size + size > BLOCK and self.open:
            self._transform()
        self.open += left
        self.size += size
        if self.size > BLOCK:
            self._transform()

    def close(self) -> None:
        self._narrow()
        self._transform()

    def _transform(self) -> None:
        if not self.open:
            return
        data = np.frombuffer(b"".join(c[1] for c in self.open), np.uint8)
        sizes = np.array([len(c[1]) for c in self.open])
        at = np.concatenate([[0], np.cumsum(sizes)])
        starts = sizes - self.length + 1
        inside = np.arange(len(data)) - np.repeat(at[:-1], sizes)
        valid = inside < np.repeat(starts, sizes)
        weight = np.repeat(np.array([c[2] for c in self.open]), sizes)
        rank = None
        if self.first:
            texts = {t: k for k, t in enumerate(sorted({c[3][:3] for c in self.open}))}
            rank = np.repeat(np.array([(texts[c[3][:3]] << 36) + c[3][3] + c[4] for c in self.open]), sizes) + inside
        mask, later = repeated(data, valid, weight, self.length, rank)
        for c, lo, n in zip(self.open, at, starts, strict=False):
            runs = [r + c[4] for r in ranges(mask[lo : lo + n])]
            if runs:
                self.found.append((c[0], runs, [r + c[4] for r in ranges(later[lo : lo + n])] if self.first else runs))
        self.open, self.size = [], 0


# ---------------------------------------------------------------- stages

def _anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """The distinct anchors of each text and how often each occurs in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in kernels.texts(batch.column("text")):
                owner, _, _, _, h = anchors(data, offsets, length)
                order = np.lexsort((h, owner))
                owner, h = owner[order], h[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])) if len(h) else np.zeros(0, np.int64)
                times = np.diff(np.concatenate([new, [len(h)]]))
                cuts = pa.array(np.searchsorted(owner[new], np.arange(hi - lo + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (h[new].view(np.int64), times)]
                yield pa.RecordBatch.from_arrays([batch.column("k1").slice(lo, hi - lo), batch.column("k2").slice(lo, hi - lo), *lists], names=["k1", "k2", "anchors", "times"])

    return texts.mapInArrow(run, "k1 long, k2 long, anchors array<long>, times array<long>")


_PIECE = [("k1", "long"), ("k2", "long"), ("id", "long"), ("copies", "long"), ("g1", "long"), ("g2", "long"), ("c1", "long"), ("c2", "long"), ("start", "long"), ("distance", "long"), ("low", "int"), ("high", "int"), ("context", "binary")]
_PIECES = ", ".join(" ".join(p) for p in _PIECE)
_ARROW = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in _PIECE])


def _names(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two longs for each of some byte strings."""
    named = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in parts]), np.int64).reshape(-1, 2)
    return named[:, 0], named[:, 1]


class _Pieces:
    """Rows of the pieces table, built in lists and given out as batches."""

    def __init__(self, length: int) -> None:
        self.length, self.rows, self.keys, self.whole = length, [], [], []

    def whole_context(self, text: tuple, anchor: int, start: int, distance: int, context: bytes) -> None:
        """All windows of an anchor at one place; their group is the anchor."""
        self._add(text, anchor.to_bytes(8, "big", signed=True), start, distance, 0, self.length, context)

    def divided(self, text: tuple, anchor: bytes, start: int, distance: int, low: int, high: int, context: bytes) -> None:
        """The windows that start between ``low`` and ``high`` bytes before the anchor, dealt out by distance and shared bytes."""
        step = -(-(high - low + 1) // WAYS)
        starts = len(context) - self.length + 1
        for a in range(low, high + 1, step):
            b = min(high, a + step - 1)
            lo, hi = max(0, distance - b), min(starts - 1, distance - a)
            if lo <= hi:
                core = context[distance - a : distance - b + self.length]
                self._add(text, anchor + a.to_bytes(4, "big") + b.to_bytes(4, "big") + core, start + lo, distance - lo, a, b, context[lo : hi + self.length])

    def _add(self, text: tuple, key: bytes, start: int, distance: int, low: int, high: int, context: bytes) -> None:
        self.rows.append((*text, start, distance, low, high, context))
        self.keys.append(key)
        self.whole.append(distance.to_bytes(4, "big") + context)

    def batch(self) -> pa.RecordBatch:
        k1, k2, id_, copies, start, distance, low, high, context = zip(*self.rows, strict=True)
        arrays = [k1, k2, id_, copies, *_names(self.keys), *_names(self.whole), start, distance, low, high, context]
        self.rows, self.keys, self.whole = [], [], []
        return pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, _ARROW, strict=True)], schema=_ARROW)


def _contexts(texts: DataFrame, length: int) -> DataFrame:
    """Pieces of the texts (``k1, k2, id, copies, text, wanted, hot``): contexts of wanted anchors, those of hot ones divided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = list(zip(*[batch.column(c).to_pylist() for c in ("k1", "k2", "id", "copies")], strict=True))
            out = _Pieces(length)
            for lo, hi, data, offsets in kernels.texts(batch.column("text")):
                owner, first, last, place, h = anchors(data, offsets, length)
                raw = data.tobytes()
                at = np.searchsorted(owner, np.arange(hi - lo + 1))
                for k in range(hi - lo):
                    mine = slice(at[k], at[k + 1])
                    wanted, hot = (set(batch.column(c)[lo + k].as_py()) for c in ("wanted", "hot"))
                    for a, b, p, anchor in zip(first[mine].tolist(), last[mine].tolist(), place[mine].tolist(), h[mine].view(np.int64).tolist(), strict=True):
                        if anchor in hot:
                            out.divided(named[lo + k], anchor.to_bytes(8, "big", signed=True), a - int(offsets[k]), p - a, 0, length - ANCHOR, raw[a : b + length])
                        elif anchor in wanted:
                            out.whole_context(named[lo + k], anchor, a - int(offsets[k]), p - a, raw[a : b + length])
                        if len(out.rows) >= 4000:
                            yield out.batch()
            if out.rows:
                yield out.batch()

    return texts.mapInArrow(run, _PIECES)


def _divided(pieces: DataFrame, length: int) -> DataFrame:
    """Pieces of groups that are too large, divided further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Pieces(length)
            columns = [batch.column(c).to_pylist() for c in ("k1", "k2", "id", "copies", "g1", "g2", "start", "distance", "low", "high", "context")]
            for k1, k2, id_, copies, g1, g2, start, distance, low, high, context in zip(*columns, strict=True):
                out.divided((k1, k2, id_, copies), g1.to_bytes(8, "big", signed=True) + g2.to_bytes(8, "big", signed=True), start, distance, low, high, context)
                if len(out.rows) >= 4000:
                    yield out.batch()
            if out.rows:
                yield out.batch()

    return pieces.mapInArrow(run, _PIECES)


def _repeats(pieces: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """``g1, g2, c1, c2, runs, later, lead`` of distinct contexts with starts that repeat: flat first and last start of each run."""
    schema = "g1 long, g2 long, c1 long, c2 long, runs array<long>, later array<long>, lead struct<id: long, k1: long, k2: long, start: long>"
    lead_type = pa.struct([(n, pa.int64()) for n in ("id", "k1", "k2", "start")])
    arrow = pa.schema([(n, pa.int64()) for n in ("g1", "g2", "c1", "c2")] + [(n, pa.list_(pa.int64())) for n in ("runs", "later")] + [("lead", lead_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(length, keep_first)
        group: list[tuple] = []

        def out() -> pa.RecordBatch | None:
            rows = [(*name, runs, later, dict(zip(("id", "k1", "k2", "start"), lead, strict=True))) for (name, lead), runs, later in blocks.found]
            blocks.found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow) if rows else None

        last = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("g1", "g2", "c1", "c2", "context", "copies", "lead")]
            for g1, g2, c1, c2, context, copies, lead in zip(*columns, strict=True):
                if group and last != (g1, g2):
                    blocks.add(group)
                    group = []
                    if len(blocks.found) > 2000 and (made := out()) is not None:
                        yield made
                last, lead = (g1, g2), tuple(lead.values())
                group.append((((g1, g2, c1, c2), lead), context, copies, lead))
        if group:
            blocks.add(group)
        blocks.close()
        if (made := out()) is not None:
            yield made

    distinct = pieces.groupBy("g1", "g2", "c1", "c2").agg(F.first("context").alias("context"), F.sum("copies").alias("copies"), F.min(F.struct("id", "k1", "k2", "start")).alias("lead"))
    return distinct.repartition("g1", "g2").sortWithinPartitions("g1", "g2", "c1", "c2").mapInArrow(run, schema)


def _merged(runs: DataFrame, length: int) -> DataFrame:
    """``k1, k2, cuts, later``: for each text, flat starts and ends of the maximal byte runs that its windows cover."""
    arrow = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("cuts", pa.list_(pa.int64())), ("later", pa.list_(pa.int64()))])

    def united(column: pa.Array, text: np.ndarray, n: int) -> pa.Array:
        pairs = column.flatten().to_numpy().reshape(-1, 2)
        of = np.repeat(text, pc.list_value_length(column).to_numpy() // 2) << 36
        a, b = of + pairs[:, 0], of + pairs[:, 1] + length
        order = np.argsort(a, kind="stable")
        a, reach = a[order], np.maximum.accumulate(b[order])
        new = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]])) if len(a) else np.zeros(0, np.int64)
        flat = np.stack([a[new], reach[np.concatenate([new[1:], [len(a)]]) - 1]], axis=1) if len(a) else np.zeros((0, 2), np.int64)
        at = np.searchsorted(flat[:, 0] >> 36, np.arange(n + 1)) * 2
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array((flat & ((1 << 36) - 1)).ravel()))

    def made(table: pa.Table) -> pa.RecordBatch:
        k1, k2 = (table.column(c).to_numpy() for c in ("k1", "k2"))
        new = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        text, at = np.cumsum(new) - 1, np.flatnonzero(new)
        lists = [united(table.column(c).combine_chunks(), text, len(at)) for c in ("runs", "later")]
        return pa.RecordBatch.from_arrays([pa.array(k1[at]), pa.array(k2[at]), *lists], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if len(held) >= 20_000:
                k1, k2 = (held.column(c).to_numpy() for c in ("k1", "k2"))
                end = int(np.flatnonzero((k1 != k1[-1]) | (k2 != k2[-1]))[-1]) + 1 if ((k1 != k1[-1]) | (k2 != k2[-1])).any() else 0
                if end:
                    yield made(held.slice(0, end))
                    held = held.slice(end)
        if held is not None and len(held):
            yield made(held)

    dealt = runs.repartition("k1", "k2").sortWithinPartitions("k1", "k2")
    return dealt.mapInArrow(run, "k1 long, k2 long, cuts array<long>, later array<long>")


def removals(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, members: int | None = None) -> DataFrame:
    """``k1, k2, least, cuts, later`` for each text with something to remove: flat starts and ends of byte runs.

    ``cuts`` are all bytes of strings that start more than once; ``later`` leaves out the first place of each string,
    in order of id, text and position, and is what the row with the text's ``least`` id loses if that place stays.
    ``members`` is the number of contexts that a block takes.
    """
    members = members or MOST // (2 * length)
    early, scratch = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    k1, k2 = content_keys()
    id_ = F.coalesce(F.col("doc_id").try_cast("long"), F.lit((1 << 63) - 1)) if keep_first else F.lit(0).cast("long")
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), id_.alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") >= length)
    found = early.put(_anchor_rows(texts.select("k1", "k2", "text"), length).groupBy("k1", "k2").agg(F.first("anchors").alias("anchors"), F.first("times").alias("times"), F.count("*").alias("copies")), "anchors")
    each = found.select("k1", "k2", "copies", F.explode(F.arrays_zip("anchors", "times")).alias("a")).select("k1", "k2", F.col("a.anchors").alias("anchor"), (F.col("a.times") * F.col("copies")).alias("n"))
    again = early.put(each.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", (F.col("n") > members).alias("hot")), "again")
    # Both sides are read from tables, so that the join is free to divide an anchor that many texts have.
    wanted = each.select("k1", "k2", "anchor").join(again, "anchor").groupBy("k1", "k2").agg(F.collect_set(F.when(~F.col("hot"), F.col("anchor"))).alias("wanted"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    wanted = scratch.put(wanted, "wanted")
    # Keys are two longs, so a bound on rows is one on bytes; beyond it all texts are dealt out by their keys.
    early.clear()
    keys = wanted.select("k1", "k2")
    some = texts.join(F.broadcast(keys), ["k1", "k2"], "left_semi") if at_most(keys, 300_000) else texts
    once = some.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("text").alias("text"))
    pieces = scratch.put(_contexts(once.join(wanted, ["k1", "k2"]), length), "pieces")
    parts = [pieces]
    while True:  # each round divides the distances of a large group by WAYS, so rounds are few
        counts = parts[-1].where(F.col("high") - F.col("low") < length - ANCHOR).select("g1", "g2", "c1", "c2").distinct().groupBy("g1", "g2").agg(F.count("*").alias("n"))
        large = scratch.put(counts.where(F.col("n") > members).select("g1", "g2"), "large")
        if large.isEmpty():
            break
        large, whole = small(large, 300_000), parts.pop()
        parts += [whole.join(large, ["g1", "g2"], "left_anti"), scratch.put(_divided(whole.join(large, ["g1", "g2"], "left_semi"), length), "pieces")]
    pieces = parts[0]
    for p in parts[1:]:
        pieces = pieces.unionByName(p)
    repeats = scratch.put(_repeats(pieces, length, keep_first), "repeats")
    places = pieces.select("k1", "k2", "g1", "g2", "c1", "c2", "start")
    met = places.join(repeats, ["g1", "g2", "c1", "c2"])
    moved = lambda c: F.transform(c, lambda r: r + F.col("start"))
    leads = (F.col("lead.k1") == F.col("k1")) & (F.col("lead.k2") == F.col("k2")) & (F.col("lead.start") == F.col("start"))
    shifted = met.select("k1", "k2", moved("runs").alias("runs"), (F.when(leads, moved("later")).otherwise(moved("runs")) if keep_first else F.array().cast("array<long>")).alias("later"))
    merged = _merged(shifted, length)
    if keep_first:
        cuts = stash(merged.join(texts.groupBy("k1", "k2").agg(F.min("id").alias("least")), ["k1", "k2"]), "cuts")
    else:
        cuts = stash(merged.withColumn("least", F.lit(None).cast("long")), "cuts")
    scratch.clear()
    return cuts


def cut(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, members: int | None = None) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``), ``n_bytes, n_removed, n_spans, kept_sha256, kept_text`` for each row.

    A text is its UTF-8 bytes, null is empty. Removed are all bytes of all occurrences of strings of ``length``
    bytes that start more than once anywhere, also in one text and in equal texts; overlaps count, and strings are
    judged on the input. With ``keep_first`` the first occurrence of each string stays, in order of doc_id (null last),
    text and position. Where removal splits a character its rest is dropped from ``kept_text`` (not from the digest);
    ``kept_text`` of a null text is null. Repeated rows are copies (with ``keep_first``, rows that repeat an id with its
    text lose the same). An empty table gives an empty result. Other columns pass unchanged, whatever their names.
    """
    k1, k2 = content_keys()
    cuts = removals(docs, length, keep_first, members)
    size = cuts.agg(F.sum(32 + 8 * (F.size("cuts") + F.size("later")))).first()[0] or 0
    cuts = F.broadcast(cuts) if size <= CUT_BYTES else cuts
    id_ = F.coalesce(F.col("doc_id").try_cast("long"), F.lit((1 << 63) - 1)) if keep_first else F.lit(0).cast("long")
    rows = packed(docs, k1=k1, k2=k2, id=id_).join(cuts, ["k1", "k2"], "left")
    rows = rows.select("row", (F.when(F.col("id") == F.col("least"), F.col("later")).otherwise(F.col("cuts")) if keep_first else F.col("cuts")).alias("cuts"))
    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, digests, left = [], [], [], [], []
            for t, c in zip(row_text(batch), batch.column("cuts"), strict=True):
                value = t.as_py()
                raw = (value or "").encode("utf-8", "surrogatepass")
                gone = c.as_py() if c.is_valid else []
                kept = b"".join([raw[a:b] for a, b in zip([0, *gone[1::2]], [*gone[::2], len(raw)], strict=True)]) if gone else raw
                sizes.append(len(raw))
                removed.append(len(raw) - len(kept))
                spans.append(len(gone) // 2)
                digests.append(hashlib.sha256(kept).hexdigest())
                left.append(kept.decode("utf-8", "ignore") if gone else value)
            columns = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], names=["row", *[f.name for f in added]])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *added]))


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``text``, what is left of the text, for each row."""
    out = cut(docs.select("doc_id", F.col("text").cast("string").alias("text")), length)
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept_text").alias("text"))
