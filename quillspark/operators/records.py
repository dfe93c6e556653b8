"""Classification of nodes by rules: decision records, suppression, footnotes, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import blocks
from quillspark.plans.rules import SUPPRESSED, RuleSet


def with_context(nodes: DataFrame) -> DataFrame:
    """Element nodes. Their ``string_value`` and ``parent_attrs`` come from shredding, so nothing is joined."""
    return nodes.where("kind = 'e'")


def dispatch(nodes: DataFrame, rules: RuleSet, variables: dict[str, object] | None = None) -> DataFrame:
    """One record per (element, winning rule): ``rule_key, behaviour, params, template, seq_no, suppressed``.

    An element of the home namespace without a winning rule gives a record with a null behaviour.
    """
    facts = with_context(nodes).withColumn("rule_element", rules.dispatch_key())
    won = facts.withColumn("won", rules.winners(variables))
    rows = won.select("*", F.posexplode_outer("won").alias("seq_no", "w")).drop("won")
    behaviour = F.col("w.behaviour")
    return rows.select("*", F.col("w.rule_key").alias("rule_key"), behaviour.alias("behaviour"), F.col("w.params").alias("params"), F.col("w.template").alias("template"), F.coalesce(behaviour.isin(*SUPPRESSED), F.lit(False)).alias("suppressed")).drop("w")


def covered(rows: DataFrame, cover: str) -> DataFrame:
    """``rows`` of nodes with ``inside``: whether a node lies below one for which ``cover`` holds. Intervals nest, so it does
    if the furthest end of such nodes before it reaches it: one scan by blocks."""
    found = blocks.running(rows, "doc_id", "node_id", exclusive=True, furthest_=("max", F.when(F.expr(cover), F.col("end_id"))))
    return found.withColumn("inside", F.coalesce(F.col("furthest_") >= F.col("node_id"), F.lit(False))).drop("furthest_")


def pruned(records: DataFrame) -> DataFrame:
    """Records outside the subtrees of suppressed ones (the suppressed records themselves stay, childless)."""
    return covered(records, "suppressed").where("not inside").drop("inside")


def selected(records: DataFrame, behaviours=(), elements=(), models=()) -> DataFrame:
    """Records that any of the three sets names."""
    return records.where(F.coalesce(F.col("behaviour").isin(*behaviours), F.lit(False)) | F.col("tag").isin(*elements) | F.coalesce(F.col("rule_key").isin(*models), F.lit(False)))


def running_numbers(rows: DataFrame, label: Column, part: str = "doc_id", order: str = "node_id") -> DataFrame:
    """``label`` and ``note_no``: the running number counts unlabelled rows only."""
    return blocks.running(rows.withColumn("label", label), part, order, note_no=("sum", F.when(F.col("label").isNull(), 1).otherwise(0)))


def notes(records: DataFrame, label: str = "label") -> DataFrame:
    """Footnotes in order: the running number counts unlabelled notes only; labelled ones keep their mark."""
    mark = F.try_element_at("params", F.lit(label))
    found = running_numbers(records.where("behaviour = 'note' and not suppressed"), F.when(mark != "", mark))
    return found.withColumn("marker", F.coalesce("label", F.col("note_no").cast("string"))).select("doc_id", "node_id", "note_no", "label", "marker", F.coalesce(F.try_element_at("params", F.lit("place")), F.lit("bottom")).alias("place"), text.clean(F.col("string_value")).alias("body"))


def labelled_first(notes_: DataFrame) -> DataFrame:
    """A stable order with marks that aren't numbers first: ``note_order`` from 1."""
    w = Window.partitionBy("doc_id").orderBy(F.regexp_like("marker", F.lit(r"^\d+$")), "note_no", "node_id")
    return notes_.withColumn("note_order", F.row_number().over(w))


def by_place(notes_: DataFrame) -> DataFrame:
    rank = F.when(F.col("place") == "foot", 0).when(F.col("place") == "end", 1).otherwise(2)
    return notes_.withColumn("note_order", F.row_number().over(Window.partitionBy("doc_id").orderBy(rank, "note_no", "node_id")))


# ---------------------------------------------------------------- coverage

def behaviour_counts(records: DataFrame) -> DataFrame:
    return records.groupBy(F.coalesce("behaviour", F.lit("unmatched")).alias("behaviour")).agg(F.count("*").alias("n"))


def rule_hits(records: DataFrame) -> DataFrame:
    return records.where("rule_key is not null").groupBy("rule_key").agg(F.count("*").alias("hits"))


def occurrences(nodes: DataFrame) -> DataFrame:
    """Elements: count and first place."""
    return nodes.where("kind = 'e'").groupBy("tag").agg(F.count("*").alias("n"), F.min_by(F.struct("doc_id", "xpath", "line"), F.struct("doc_id", "node_id")).alias("first"))


def unmatched(records: DataFrame) -> DataFrame:
    return records.where("behaviour is null and rule_element is not null").groupBy("tag").agg(F.count("*").alias("n"))


def dropped(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """Outermost elements without a record that are not inside a suppressed subtree."""
    keys = ["doc_id", "node_id"]
    shown = records.groupBy(*keys).agg(F.max("suppressed").alias("suppressed"))
    marked = nodes.where("kind = 'e'").select(*keys, "end_id", "parent_id", "tag", "xpath").join(shown, keys, "left")
    return covered(marked, "suppressed is null or suppressed").where("suppressed is null and not inside").drop("inside", "suppressed")


def unused_rules(table: DataFrame, records: DataFrame, nodes: DataFrame) -> DataFrame:
    """Reachable local rules that no record names, of elements that occur."""
    present = nodes.where("kind = 'e'").select(F.col("tag").alias("element")).distinct()
    return table.where("local and unreachable is null and behaviour is not null").join(rule_hits(records), "rule_key", "left_anti").join(present, "element", "left_semi")


def summary(records: DataFrame, table: DataFrame) -> DataFrame:
    """One row of totals."""
    facts = records.agg(F.count("*").alias("records"), F.count_if("suppressed").alias("suppressed"), F.count_if(F.col("behaviour").isNull()).alias("unmatched"), F.countDistinct("rule_key").alias("rules_fired"), F.countDistinct("tag").alias("elements"))
    rules = table.agg(F.count("*").alias("rules"), F.count_if("local").alias("local_rules"), F.count_if(F.col("unreachable").isNotNull()).alias("unreachable"))
    return facts.join(F.broadcast(rules))  # one row each
