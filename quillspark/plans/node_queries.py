"""Expressions over node tables by twig joins: what ``xml_xpath`` and ``page_links`` work out in trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import passages
from quillspark.operators.twigs import below, child, matches, picked, placed, several
from quillspark.plans import corpus_queries, document_queries
from quillspark.plans.catalogue import _SQL, query
from quillspark.session import settled
from quillspark.sources.markup import shred


def _attribute(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def _numbered(found: DataFrame, name: str, value: Column) -> DataFrame:
    """A sequence: a row for each item, in document order."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("node_id"))
    return found.where(value.isNotNull()).select("doc_id", F.lit(name).alias("name"), place.alias("item_no"), value.alias("value"))


#: The paths of ``xml_xpath``'s expressions, with the step whose node is wanted beside the match.
_TWIGS = {
    "root": ([child()], None), "item": ([below("item")], None), "q": ([below("item"), child("q")], 0), "ref": ([below("ref")], None), "plain": ([below("note", "try_element_at(attrs, 'n') is null")], None),
    "head": ([below("head")], None), "returned": ([below("item").having(child("q", "try_element_at(attrs, 'unit') = 'R'"))], None),
}


@query(_SQL["xml_xpath"])
def node_xpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps, branches, positions, siblings, ids and aggregates over the orders' node table: all paths in one walk, all values
    of a document in one aggregation. No side of a join is sent to all tasks."""
    table = settled(shred(document_queries._orders(spark, sf_dir), columns=["doc_id", "node_id", "end_id", "parent_id", "kind", "tag", "attrs", "string_value", "xml_id"], kinds="e"))
    rows = settled(picked(several(table, list(_TWIGS.values())), table, "parent_id", "attrs", "string_value"))
    is_ = lambda twig: F.col("twig") == list(_TWIGS).index(twig)
    of = lambda twig: rows.where(is_(twig))
    first = F.min(F.when(is_("returned"), F.col("node_id"))).over(Window.partitionBy("doc_id", "parent_id"))
    items = settled(placed(rows.where(is_("item") | is_("returned")).withColumn("first", first).where(is_("item"))).select("doc_id", "node_id", "pos", "size", "first", _attribute("n").alias("n")))
    pairs = of("q").select("doc_id", F.col("context_id").alias("node_id"), "string_value").hint("merge").join(items.where("pos <= 2").select("doc_id", "node_id", "n"), ["doc_id", "node_id"])
    facets = passages.ordered_facets(of("q").withColumn("unit", _attribute("unit")), "doc_id", "unit", "node_id", "units")
    heads = of("head").select("doc_id", F.concat(F.lit("o"), F.substring_index("string_value", " ", -1)).alias("xml_id"))
    named = heads.hint("merge").join(table.where("xml_id is not null").select("doc_id", "xml_id", F.col("tag").alias("value")), ["doc_id", "xml_id"])

    def part(found: DataFrame, what: str, value: Column, at: str = "node_id") -> DataFrame:
        return found.select("doc_id", F.lit(what).alias("what"), F.col(at).cast("long").alias("at"), value.cast("string").alias("value"))

    parts = part(of("root"), "root", F.lit(None)).unionByName(part(items, "item", F.when(F.col("node_id") > F.col("first"), "after"))).unionByName(part(of("q"), "q", F.col("string_value"))).unionByName(part(of("ref"), "ref", _attribute("target")))
    parts = parts.unionByName(part(pairs, "pair", F.concat("n", F.lit(":"), "string_value"))).unionByName(part(facets.withColumn("node_id", F.lit(0)), "flags", F.array_join("units", "|")))
    some = lambda what, value: F.when(F.col("what") == what, value)
    joined = lambda what, mark: F.array_join(F.transform(F.array_sort(F.collect_list(some(what, F.struct("at", "value")))), lambda s: s["value"]), mark)
    number = some("q", F.col("value")).cast("long")
    values = {
        "lines": F.count(some("item", F.lit(1))), "sum": F.coalesce(F.sum(number), F.lit(0)), "most": F.max(number), "refs": joined("ref", " "), "flags": F.coalesce(F.max(some("flags", F.col("value"))), F.lit("")),
        "after": F.count(some("item", F.col("value"))), "big": F.when(F.max(number) > 49, "yes").otherwise("no"), "loop": joined("pair", ";"),
    }
    each = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(1).alias("item_no"), F.col(name).cast("string").alias("value")) for name in values])
    whole = parts.groupBy("doc_id").agg(*[value.alias(name) for name, value in values.items()]).select("doc_id", F.inline(each)).where("value is not null")
    ids = named.select("doc_id", F.lit("id").alias("name"), F.lit(1).alias("item_no"), "value")
    return whole.unionByName(_numbered(items.where("pos = size"), "last", F.col("n"))).unionByName(_numbered(of("plain"), "notes", F.col("string_value"))).unionByName(ids)


@query(_SQL["page_links"])
def node_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of links in pages, from the pages' node table."""
    table = settled(corpus_queries._page_nodes(spark, sf_dir).where("kind = 'e'").select("doc_id", "node_id", "end_id", "parent_id", "kind", "tag", "attrs"))
    return _numbered(picked(matches(table, [below("a")]), table, "attrs"), "links", _attribute("href"))
