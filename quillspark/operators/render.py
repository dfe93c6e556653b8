"""Rendering records: open and close tokens around text, ordered by position and joined per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text

# Tags of the HTML channel.
HTML = {"block": "div", "inline": "span", "paragraph": "p", "section": "section", "body": "body", "list": "ul", "list_item": "li", "table": "table", "row": "tr", "cell": "td", "figure": "figure", "cit": "blockquote", "title": "title", "match": "mark", "code": "pre", "code_inline": "code", "text": "text", "note": "span", "heading": "h1", "link": "a", "anchor": "span"}
BLOCKS = ["block", "paragraph", "section", "body", "list", "table", "figure", "cit"]


def escape(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


def _level() -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(F.try_element_at("params", F.lit("level")).try_cast("int"), F.lit(1))))


def html_tokens() -> tuple[Column, Column]:
    b = F.col("behaviour")
    tag = F.when(b == "heading", F.concat(F.lit("h"), _level().cast("string")))
    for name, element in HTML.items():
        tag = tag.when(b == name, F.lit(element))
    uri = F.coalesce(F.try_element_at("params", F.lit("uri")), F.try_element_at("attrs", F.lit("href")), F.try_element_at("attrs", F.lit("target")))
    css = F.concat_ws(" ", F.concat(F.lit("tei-"), "tag"), "rule_key")
    more = F.when((b == "link") & uri.isNotNull(), F.concat(F.lit(' href="'), escape(uri), F.lit('"'))).otherwise("")
    open_ = F.when(b == "break_", "<br/>").when(b == "break", "<br/>").when(b == "graphic", F.concat(F.lit('<img src="'), F.coalesce(F.try_element_at("params", F.lit("url")), F.lit("")), F.lit('"/>'))).when(tag.isNotNull(), F.concat(F.lit("<"), tag, F.lit(' class="'), css, F.lit('"'), more, F.lit(">")))
    return F.coalesce(open_, F.lit("")), F.coalesce(F.when(tag.isNotNull(), F.concat(F.lit("</"), tag, F.lit(">"))), F.lit(""))


def markdown_tokens() -> tuple[Column, Column]:
    b = F.col("behaviour")
    uri = F.coalesce(F.try_element_at("params", F.lit("uri")), F.try_element_at("attrs", F.lit("href")), F.try_element_at("attrs", F.lit("target")), F.lit(""))
    rend = F.coalesce(F.try_element_at("attrs", F.lit("rend")), F.lit(""))
    mark = F.when(rend.contains("bold"), "**").when(rend.contains("italic"), "_").otherwise("")
    item = F.when(F.element_at("anc_tags", -1) == "ol", F.concat(F.col("tag_ord").cast("string"), F.lit(". "))).otherwise("- ")
    open_ = (F.when(b == "heading", F.concat(F.lit("\n\n"), F.repeat(F.lit("#"), _level()), F.lit(" "))).when(b == "list_item", F.concat(F.lit("\n"), item)).when(b == "link", "[").when(b == "inline", mark)
             .when(b == "cit", "\n\n> ").when(b == "code_inline", "`").when(b == "code", "\n\n```\n").when(b == "break", "  \n").when(b == "row", "\n|").when(b == "cell", " ").when(b.isin(*BLOCKS), "\n\n").otherwise(""))
    close = (F.when(b == "link", F.concat(F.lit("]("), uri, F.lit(")"))).when(b == "inline", mark).when(b == "code_inline", "`").when(b == "code", "\n```\n").when(b == "cell", " |").when(b == "heading", "\n\n").when(b.isin(*BLOCKS), "\n\n").otherwise(""))
    return open_, close


def text_tokens() -> tuple[Column, Column]:
    gap = F.when(F.col("behaviour").isin(*BLOCKS, "heading", "list_item", "cell"), " ").otherwise("")
    return gap, gap


def render(nodes: DataFrame, records: DataFrame, channel: str = "html") -> DataFrame:
    """``doc_id, output`` of each document; suppressed subtrees give nothing.

    Opening tokens stand at a node's number, closing ones at its end, inner ones first, so one ordered aggregation
    per document writes everything and no recursion is needed. A document's tokens meet in one group, as its output does.
    """
    open_, close = {"html": html_tokens, "markdown": markdown_tokens, "text": text_tokens}[channel]()
    live = records.where("not suppressed")
    inner = F.regexp_replace("text", r"[ \t]*\r?\n\s*", " ")
    none = F.lit(None).cast("int")
    runs = nodes.where("kind = 't'").select("doc_id", "node_id", F.lit(1).alias("step"), F.lit(0).alias("deep"), (escape(F.col("text")) if channel == "html" else inner).alias("token"), none.alias("end_id"))
    opens = live.select("doc_id", "node_id", F.lit(0).alias("step"), F.col("seq_no").alias("deep"), open_.alias("token"), none.alias("end_id"))
    closes = live.select("doc_id", F.col("end_id").alias("node_id"), F.lit(2).alias("step"), (-F.col("depth") * 100 - F.col("seq_no")).alias("deep"), close.alias("token"), none.alias("end_id"))
    # Suppressed nodes are tokens without text that carry how far they hide what follows.
    hides = records.where("suppressed").select("doc_id", "node_id", F.lit(-1).alias("step"), F.lit(0).alias("deep"), F.lit("").alias("token"), F.col("end_id").cast("int").alias("end_id"))
    tokens = opens.unionByName(runs).unionByName(closes).where("token <> ''").unionByName(hides)
    so_far = Window.partitionBy("doc_id").orderBy("node_id", "step").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tokens = tokens.withColumn("hidden", F.max("end_id").over(so_far)).where("token <> '' and (hidden is null or hidden < node_id)")
    joined = tokens.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "step", "deep", "token"))), lambda s: s["token"]), "").alias("output"))
    if channel == "markdown":
        joined = joined.withColumn("output", text.strip(text.markdown_finish(F.col("output"))))
    if channel == "text":
        joined = joined.withColumn("output", text.clean(F.col("output")))
    return joined


