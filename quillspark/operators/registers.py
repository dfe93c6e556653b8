"""Lookups between documents and registers of any size, as joins on ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import settled

#: References to one id that one task joins; those to an id with more are divided.
HOT = 50_000


def holders(register: DataFrame) -> DataFrame:
    """``uri, xml_id`` and the element that an id names: in each register document the first one that has it."""
    others = [c for c in register.columns if c not in ("uri", "xml_id")]
    return register.where("xml_id is not null").groupBy("uri", "xml_id").agg(F.min_by(F.struct(*others), "node_id").alias("found")).select("uri", "xml_id", "found.*")


def by_id(refs: DataFrame, register: DataFrame, uri: Column | None = None, collections: DataFrame | None = None, hot: int = HOT) -> DataFrame:
    """The elements that references name: rows of ``refs`` (with ``ref_no`` and ``ref``, ids between spaces) by elements.

    ``register`` has ``uri, node_id, xml_id`` and what is wanted of an element. A reference looks in the document ``uri``,
    or in all documents of the collection of that name where ``collections`` (``uri, member``) are given. An element is found
    once by a reference however often this names it, and elements come in document order as ``found_no``. References
    without a hit give no row. Both sides are joined on ids, so neither has to be small. References to an id that very many
    name, whether an element has it or not, are dealt out to several tasks, and its element goes to each of them.
    """
    wanted = refs.withColumn("xml_id", F.explode(F.array_distinct(F.split(F.trim(F.regexp_replace("ref", r"\s+", " ")), " ")))).where("xml_id <> ''").withColumn("uri", uri if uri is not None else F.col("uri"))
    if collections is not None:
        wanted = wanted.join(collections, "uri").drop("uri").withColumnRenamed("member", "uri")
    many = settled(wanted.groupBy("uri", "xml_id").agg(F.ceil(F.count("*") / hot).cast("int").alias("pieces_")).where("pieces_ > 1"))
    dealt = wanted.join(F.broadcast(many), ["uri", "xml_id"], "left").withColumn("piece_", F.coalesce(F.pmod(F.xxhash64("ref_no"), F.col("pieces_")).cast("int"), F.lit(0))).drop("pieces_")
    held = holders(register).join(F.broadcast(many), ["uri", "xml_id"], "left").withColumn("piece_", F.explode(F.sequence(F.lit(0), F.coalesce("pieces_", F.lit(1)) - 1))).drop("pieces_")
    met = dealt.join(held, ["uri", "xml_id", "piece_"]).drop("piece_")
    order = Window.partitionBy("ref_no").orderBy("uri", "node_id")
    return met.withColumn("found_no", F.row_number().over(order))


def or_self(rows: DataFrame, found: DataFrame, key: str, value: str, own: Column) -> DataFrame:
    """Each row with what was found for it, or with itself where nothing was."""
    first = found.where("found_no = 1").select(key, F.col(value).alias("found_value"))
    return rows.join(first, key, "left").withColumn(value, F.coalesce("found_value", own)).drop("found_value")


def targets(nodes: DataFrame, attribute: str = "target") -> DataFrame:
    """``doc_id, node_id, target_id``: elements that point to another one of their document, by an id behind ``#``."""
    point = F.when(F.col("kind") == "e", F.regexp_replace(F.try_element_at("attrs", F.lit(attribute)), "^#", ""))
    none = F.lit(None).cast(nodes.schema["node_id"].dataType)
    # Nodes come from parsing, so they are read once: pointers and ids meet in one table.
    both = F.array(F.struct(point.alias("xml_id"), F.col("node_id"), none.alias("own_")), F.struct(F.col("xml_id"), none.alias("node_id"), F.col("node_id").alias("own_")))
    rows = nodes.select("doc_id", F.inline(both)).where("xml_id is not null")
    met = rows.withColumn("target_id", F.min("own_").over(Window.partitionBy("doc_id", "xml_id")))
    return met.where("node_id is not null and target_id is not null").select("doc_id", "xml_id", "node_id", "target_id")


def pointing_note(anchors: DataFrame, notes: DataFrame) -> DataFrame:
    """Each anchor with the first note of its document that points to it: ``doc_id, anchor, note_id`` (null without one)."""
    first = notes.groupBy("doc_id", "anchor").agg(F.min("note_id").alias("note_id"))
    return anchors.join(first, ["doc_id", "anchor"], "left")


def regions(lines: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Lines with the picture region of their letter and number."""
    return lines.join(surfaces, ["letter", "line"], "left")
