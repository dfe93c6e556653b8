"""Schema graphs: closures over classes, content relations, module selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import settled


def closure(edges: DataFrame) -> DataFrame:
    """``src, dst`` of all nodes reachable in one step or more; cycles end, since known pairs are not followed again.

    A round joins the pairs found last to all known ones, so path lengths double and any chain settles after as many
    rounds as its length has binary digits; each round's new pairs are checkpointed in the session's shared folder, once.
    """
    new = settled(edges.select("src", "dst").distinct())
    rounds = [new]
    while True:
        seen = rounds[0]
        for r in rounds[1:]:
            seen = seen.unionByName(r)
        step = new.select("src", F.col("dst").alias("via")).join(seen.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()
        new = settled(step.join(seen, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return seen
        rounds.append(new)


def may_contain(content: DataFrame, members: DataFrame) -> DataFrame:
    """``ident, child``: elements an element may hold, directly or through (nested) classes.

    ``content(ident, kind, key)`` with kind ``element`` or ``class``; ``members(ident, class_key)``.
    """
    below = closure(members.select(F.col("class_key").alias("src"), F.col("ident").alias("dst")))
    direct = content.where("kind = 'element'").select("ident", F.col("key").alias("child"))
    through = content.where("kind = 'class'").join(below, F.col("key") == F.col("src")).select("ident", F.col("dst").alias("child"))
    classes = members.select(F.col("class_key").alias("child")).distinct()
    return direct.unionByName(through).distinct().join(classes, "child", "left_anti").select("ident", "child")


def contained_by(content: DataFrame, members: DataFrame) -> DataFrame:
    return may_contain(content, members).where("ident <> child").select(F.col("child").alias("ident"), F.col("ident").alias("parent"))


def used_by(content: DataFrame, members: DataFrame) -> DataFrame:
    """``key, user``: specs that name a class or element in their content, or belong to the class."""
    return content.select("key", F.col("ident").alias("user")).unionByName(members.select(F.col("class_key").alias("key"), F.col("ident").alias("user"))).distinct()


def select_modules(specs: DataFrame, refs: DataFrame) -> DataFrame:
    """Specs of the referenced modules: ``refs(module, include, except_)`` with arrays; an empty ``include`` takes none,
    a null one all."""
    joined = specs.join(F.broadcast(refs), "module")  # a schema's module list
    take = F.col("include").isNull() | F.array_contains("include", F.col("ident"))
    drop = F.coalesce(F.array_contains("except_", F.col("ident")), F.lit(False))
    return joined.where(take & ~drop).select(*specs.columns)


def overlay(base: DataFrame, local: DataFrame) -> DataFrame:
    """Specs after local changes: ``local(ident, mode, ...)`` deletes, replaces or adds whole specs."""
    b, c = base.alias("b"), local.alias("c")
    columns = [F.when(F.col("c.ident").isNotNull(), F.col(f"c.{n}")).otherwise(F.col(f"b.{n}")).alias(n) for n in base.columns]
    return b.join(c, F.col("b.ident") == F.col("c.ident"), "full").where("c.mode is null or c.mode <> 'delete'").select(*columns)


def catalogue(specs: DataFrame, letter) -> DataFrame:
    return specs.groupBy(letter.alias("letter")).agg(F.array_sort(F.collect_list("ident")).alias("idents"))
