"""Preference formatting of chosen and rejected conversations (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _render(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def _join(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _spans(turns: Column, trained: str) -> Column:
    """Loss spans ``(start, length)`` in characters of the rendered text: bodies and end marks of the trained role."""
    init = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        head = F.length(turn["role"]).cast("long") + 5
        body = F.length(turn["text"]).cast("long") + 7
        span = F.array(F.struct((acc["at"] + head).alias("start"), body.alias("length")))
        return F.struct((acc["at"] + head + body + 1).alias("at"), F.when(turn["role"] == trained, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, init, step, lambda acc: acc["spans"])


def conversations_as_arrays(turns: DataFrame) -> DataFrame:
    """``conv_id, turns`` with turns an array of ``(turn, role, text)`` in order; ties go by role, then text.

    Null roles and texts become empty strings, a null turn number sorts first, rows without conv_id are
    no conversation and are left out. One array holds one conversation. Repeated rows are turns of their own; other
    columns are left out, whatever their names.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))


def format_preferences(pairs: DataFrame, trained: str = "assistant") -> DataFrame:
    """Prompt, completions and loss spans for each pair of conversations.

    ``pairs`` has arrays ``chosen`` and ``rejected`` of structs with ``role`` and ``text`` (null arrays count as
    empty). The longest common prefix of equal turns is rendered once as ``prompt``; what follows on each side is
    a completion, whose loss mask covers only the bodies and end marks of ``trained`` turns. If one side is a
    prefix of the other its completion is empty. Other columns pass unchanged.
    """
    empty = F.expr("cast(array() as array<struct<turn:bigint,role:string,text:string>>)")
    sides = pairs.withColumn("chosen", F.coalesce("chosen", empty)).withColumn("rejected", F.coalesce("rejected", empty))
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first_other = F.array_position(same, F.lit(False))
    n = F.when(first_other > 0, F.least(first_other - 1, shorter.cast("long"))).otherwise(shorter.cast("long"))
    out = sides.withColumn("n_common", n)
    rest = lambda c: F.slice(c, F.col("n_common").cast("int") + 1, F.greatest(F.size(c), F.lit(1)))
    for side in ("chosen", "rejected"):
        out = out.withColumn(f"{side}_text", _join(rest(side))).withColumn(f"{side}_spans", _spans(rest(side), trained))
    return out.withColumn("prompt", _join(F.slice("chosen", F.lit(1), F.col("n_common").cast("int")))).drop("chosen", "rejected")


def swapped_replies(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """Preference pairs from plain conversations: ``conv_id, paired, chosen, rejected``.

    Chosen is the conversation; rejected is the same with its last trained reply replaced by that of the partner
    conversation (the id with its lowest bit flipped). Without an own or a partner reply, ``paired`` is false and
    rejected is empty. Every conversation gives one row.
    """
    arrays = conversations_as_arrays(turns)
    replies = F.filter(F.transform("turns", lambda t, i: F.struct(i.alias("i"), t["role"].alias("role"), t["text"].alias("text"))), lambda t: t["role"] == trained)
    own = arrays.withColumn("reply", F.try_element_at(replies, F.lit(-1)))
    other = own.where("reply is not null").select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.col("reply.text").alias("other"))
    both = own.join(other, "conv_id", "left")
    swap = F.transform("turns", lambda t, i: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.when(i == F.col("reply.i"), F.col("other")).otherwise(t["text"]).alias("text")))
    paired = F.col("reply").isNotNull() & F.col("other").isNotNull()
    return both.select("conv_id", paired.alias("paired"), F.col("turns").alias("chosen"), F.when(paired, swap).alias("rejected"))
