"""Passages for retrieval: boundaries to units, greedy packing, stable ids, facets, page chunks and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import blocks


def runs_of_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, line``: non-empty lines of each text, whitespace cleaned; numbers count all lines."""
    split = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return split.select("doc_id", (F.col("line_no") + 1).cast("long").alias("line_no"), text.clean(F.col("raw")).alias("line")).where("line <> ''")


def islands(runs: DataFrame, boundary: Column, part: str = "doc_id", order: str = "line_no") -> DataFrame:
    """``unit_no`` of each run: the number of boundaries so far; runs before the first one are unit 0."""
    return blocks.running(runs, part, order, unit_no=("sum", F.when(boundary, 1).otherwise(0)))


def units(runs: DataFrame, value: str = "line", part: str = "doc_id", order: str = "line_no") -> DataFrame:
    """``doc_id, unit_no, parts, document``: each unit's runs in order and their text, joined by a space."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(value).alias("t"))))
    grouped = runs.groupBy(part, "unit_no").agg(parts.alias("parts"))
    return grouped.select(part, "unit_no", F.transform("parts", lambda p: p["t"]).alias("parts"), F.transform("parts", lambda p: p["at"]).alias("ats")).withColumn("document", F.array_join("parts", " "))


def pack(parts: Column, most: int = 1500, overlap: int = 1) -> Column:
    """Greedy packing of an array of texts: arrays of parts per piece.

    Parts of ``most`` characters together (joined by one space) are one piece. Else a piece closes when the next part would
    take it over ``most``, each part counting one more character; its last ``overlap`` parts are carried on and not
    checked again; a single long part is never cut. The fold keeps places only, so its state stays small.
    """
    weigh = lambda a, n: F.aggregate(F.slice(parts, a, n), F.lit(0), lambda t, p: t + F.length(p) + 1)
    start = F.struct(F.lit(1).alias("first"), F.lit(0).alias("size"), F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("cuts"))

    def step(acc: Column, i: Column) -> Column:
        more = F.length(F.element_at(parts, i)) + 1
        close = (i > acc["first"]) & (acc["size"] + more > most)
        first = F.greatest(acc["first"], i - overlap)
        return F.when(close, F.struct(first.alias("first"), (weigh(first, i - first) + more).alias("size"), F.concat(acc["cuts"], F.array(F.struct(acc["first"].alias("a"), (i - 1).alias("b")))).alias("cuts"))).otherwise(F.struct(acc["first"].alias("first"), (acc["size"] + more).alias("size"), acc["cuts"].alias("cuts")))

    n = F.size(parts)
    cuts = F.aggregate(F.sequence(F.lit(1), n), start, step, lambda acc: F.concat(acc["cuts"], F.array(F.struct(acc["first"].alias("a"), n.alias("b")))))
    divided = F.transform(cuts, lambda c: F.slice(parts, c["a"], c["b"] - c["a"] + 1))
    return F.when(n == 0, F.expr("cast(array() as array<array<string>>)")).when(F.length(F.array_join(parts, " ")) <= most, F.array(parts)).otherwise(divided)


def pieces(unit_rows: DataFrame, most: int = 1500, least: int = 40, overlap: int = 1, part: str = "doc_id") -> DataFrame:
    """Pieces of units that reach ``least`` characters, numbered after short ones went: ``part, n_parts, chars, hash``."""
    split = unit_rows.select(part, "unit_no", F.posexplode(pack(F.col("parts"), most, overlap)).alias("piece_no", "piece")).withColumn("document", F.array_join("piece", " "))
    kept = split.where(F.length("document") >= least)
    w = Window.partitionBy(part, "unit_no")
    return kept.select(part, "unit_no", (F.row_number().over(w.orderBy("piece_no")) - 1).cast("long").alias("part"), F.count("*").over(w).alias("n_parts"), F.length("document").cast("long").alias("chars"), text.content_hash(F.col("document")).alias("hash"), "document")


def with_suffixes(rows: DataFrame, id_: str, order: list[str], within: list[str]) -> DataFrame:
    """Repeats of an id get ``~1, ~2, ...`` in emission order."""
    w = Window.partitionBy(*within, id_).orderBy(*order)
    k = F.row_number().over(w) - 1
    return rows.withColumn("k", k).withColumn(id_, F.when(F.col("k") > 0, F.concat(id_, F.lit("~"), F.col("k").cast("string"))).otherwise(F.col(id_))).drop("k")


def navigation(chunks: DataFrame, part: str, order: str, file: str) -> DataFrame:
    """``prev, next``: the neighbouring chunk's file."""
    w = Window.partitionBy(part).orderBy(order)
    return chunks.withColumn("prev", F.lag(file).over(w)).withColumn("next", F.lead(file).over(w))


def carry(rows: DataFrame, value: str, part: str, order: str, name: str) -> DataFrame:
    """The last non-null value seen so far."""
    return blocks.running(rows, part, order, **{name: ("last", F.col(value))})


def ordered_facets(rows: DataFrame, key: str, value: str, order: str, name: str) -> DataFrame:
    """Distinct values of each key, in order of first occurrence."""
    first = rows.groupBy(key, value).agg(F.min(order).alias("at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda s: s[value]).alias(name))


def anchor_map(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """``doc_id, anchor, file``: the first chunk that holds an id. Chunks are intervals that do not overlap, so a node's is
    the last one that began before it, if that reaches it: one scan over both."""
    none = F.lit(None)
    starts = chunks.select("doc_id", F.col("chunk_start").alias("at"), F.lit(0).alias("step"), F.struct(F.col("file"), F.col("chunk_start").alias("a"), F.col("chunk_stop").alias("b")).alias("chunk"), none.cast("string").alias("anchor"))
    held = nodes.where("xml_id is not null").select("doc_id", F.col("node_id").alias("at"), F.lit(1).alias("step"), none.cast(starts.schema["chunk"].dataType).alias("chunk"), F.col("xml_id").alias("anchor"))
    both = starts.unionByName(held).withColumn("place", F.col("at") * 2 + F.col("step"))
    met = blocks.running(both, "doc_id", "place", here=("last", F.col("chunk"))).where("anchor is not null and here.b >= at")
    return met.groupBy("doc_id", "anchor").agg(F.min_by("here.file", "here.a").alias("file"))


def rewrite_links(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """``href`` of ``#anchor`` links seen from ``from_file``: the same file keeps ``#a``, a file named like the anchor is
    linked alone, another file gets ``file#a``, unknown anchors stay unchanged."""
    joined = links.withColumn("anchor", F.regexp_replace("target", "^#", "")).join(anchors, ["doc_id", "anchor"], "left")
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    href = F.when(F.col("file").isNull(), F.col("target")).when(F.col("file") == F.col("from_file"), F.concat(F.lit("#"), "anchor")).when(stem == F.col("anchor"), F.col("file")).otherwise(F.concat("file", F.lit("#"), "anchor"))
    return joined.withColumn("href", href)


def page_chunks(nodes: DataFrame, milestone: str = "pb") -> DataFrame:
    """Pages by milestones: ``page_no, chunk_start, chunk_stop, page_id`` over the intervals between page breaks."""
    w = Window.partitionBy("doc_id").orderBy("node_id")
    breaks = nodes.where(F.col("tag") == milestone)
    last = nodes.groupBy("doc_id").agg(F.max("node_id").alias("last_id"))
    page_id = F.coalesce("xml_id", F.concat(F.lit("page-"), text.safe_id(F.try_element_at("attrs", F.lit("n")))), F.concat(F.lit("page-"), F.row_number().over(w).cast("string")))
    pages = breaks.join(last, "doc_id").select("doc_id", F.row_number().over(w).alias("page_no"), F.col("node_id").alias("chunk_start"), (F.coalesce(F.lead("node_id").over(w), F.col("last_id") + 1) - 1).alias("chunk_stop"), page_id.alias("page_id"), "node_id")
    return with_suffixes(pages, "page_id", ["node_id"], ["doc_id"]).drop("node_id")


def hash_diff(old: DataFrame, new: DataFrame, key: str = "id", hash_: str = "hash") -> DataFrame:
    """``key, action`` of an upsert: new, changed, unchanged or gone; one full outer join."""
    a, b = old.select(key, F.col(hash_).alias("old_hash")), new.select(key, F.col(hash_).alias("new_hash"))
    action = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "gone").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, action.alias("action"))
