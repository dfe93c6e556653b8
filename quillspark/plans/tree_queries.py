"""Queries over the hierarchy of regions, nations, customers and orders, over rules, registers and schema graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import blocks, nodes, passages, specs
from quillspark.plans.catalogue import query
from quillspark.plans.rules import RuleSet


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TREE = """paths AS (
        SELECT r_regionkey AS doc_id, [] :: BIGINT[] AS path, r_name AS label FROM region
        UNION ALL SELECT n_regionkey, [n_nationkey :: BIGINT], n_name FROM nation
        UNION ALL SELECT n_regionkey, [n_nationkey :: BIGINT, c_custkey], c_name FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT n_regionkey, [n_nationkey :: BIGINT, c_custkey, o_orderkey], o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    keyed AS (SELECT *, coalesce(path[1], -1) AS k1, coalesce(path[2], -1) AS k2, coalesce(path[3], -1) AS k3, len(path) AS depth FROM paths),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k1, k2, k3) - 1 AS node_id FROM keyed),
    sized AS (
        SELECT *, CASE depth WHEN 0 THEN max(node_id) OVER (PARTITION BY doc_id) WHEN 1 THEN max(node_id) OVER (PARTITION BY doc_id, k1)
            WHEN 2 THEN max(node_id) OVER (PARTITION BY doc_id, k1, k2) ELSE node_id END AS end_id,
            CASE depth WHEN 1 THEN min(node_id) OVER (PARTITION BY doc_id) WHEN 2 THEN min(node_id) OVER (PARTITION BY doc_id, k1) WHEN 3 THEN min(node_id) OVER (PARTITION BY doc_id, k1, k2) END AS parent_id
        FROM ranked),
    t AS (SELECT doc_id :: BIGINT AS doc_id, node_id :: BIGINT AS node_id, end_id :: BIGINT AS end_id, parent_id :: BIGINT AS parent_id, depth :: BIGINT AS depth, label, k1, k2, k3 FROM sized)"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as documents; nations, their customers and these' orders below them in key order."""
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").alias("doc_id"), "n_name")
    c = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("n"), "c_name").join(n.select("n", "doc_id"), "n")
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderstatus").join(c.select("c_custkey", "n", "doc_id"), "c_custkey")
    root = F.lit(-1).cast("long")
    rows = (
        _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc_id"), F.array(root).alias("path"), F.col("r_name").alias("label"))
        .unionByName(n.select("doc_id", F.array(root, "n").alias("path"), F.col("n_name").alias("label")))
        .unionByName(c.select("doc_id", F.array(root, "n", "c_custkey").alias("path"), F.col("c_name").alias("label")))
        .unionByName(o.select("doc_id", F.array(root, "n", "c_custkey", "o_orderkey").alias("path"), F.col("o_orderstatus").alias("label")))
    )
    made = nodes.encode(rows)
    return made.select(F.col("doc_id").cast("long"), *[F.col(c_).cast("long").alias(c_) for c_ in ("node_id", "end_id", "parent_id", "depth")], "label")


@query(f"WITH {_TREE} SELECT doc_id, node_id, end_id, parent_id, depth, label FROM t")
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir)


@query(f"""WITH {_TREE}, d AS (
        SELECT doc_id, k1, k2, max(depth) AS deepest, 0 AS level FROM t WHERE FALSE GROUP BY 1, 2, 3
        UNION ALL SELECT doc_id, NULL, NULL, max(depth), 0 FROM t WHERE depth > 0 GROUP BY 1 UNION ALL SELECT doc_id, k1, NULL, max(depth), 1 FROM t WHERE depth > 1 GROUP BY 1, 2 UNION ALL SELECT doc_id, k1, k2, max(depth), 2 FROM t WHERE depth > 2 GROUP BY 1, 2, 3)
    SELECT t.doc_id, t.node_id AS context_id, t.end_id - t.node_id AS n, deepest FROM t JOIN d ON d.doc_id = t.doc_id AND level = depth AND (level < 1 OR d.k1 = t.k1) AND (level < 2 OR d.k2 = t.k2)""")
def tree_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descendants of all inner nodes, as pairs that a structural merge join finds."""
    tree = _tree(spark, sf_dir)
    below = nodes.axis(tree.where("end_id > node_id"), tree.select("doc_id", "node_id", "depth"), "descendant")
    return below.groupBy("doc_id", "context_id").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


@query(f"""WITH {_TREE} SELECT c.doc_id, c.node_id AS context_id, CASE c.depth WHEN 1 THEN r.label WHEN 2 THEN r.label || '/' || n.label ELSE r.label || '/' || n.label || '/' || k.label END AS path
    FROM t c JOIN t r ON r.doc_id = c.doc_id AND r.depth = 0 LEFT JOIN t n ON n.doc_id = c.doc_id AND n.depth = 1 AND n.k1 = c.k1 LEFT JOIN t k ON k.doc_id = c.doc_id AND k.depth = 2 AND k.k1 = c.k1 AND k.k2 = c.k2 WHERE c.depth > 0""")
def tree_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels above every node, orders too."""
    tree = _tree(spark, sf_dir)
    above = nodes.axis(tree, tree.select("doc_id", "node_id", "end_id", "depth", "label"), "ancestor")
    return above.groupBy("doc_id", "context_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "label"))), lambda s: s["label"]), "/").alias("path"))


@query(f"""WITH {_TREE}, e AS (SELECT doc_id, end_id, count(*) AS n FROM t GROUP BY 1, 2), b AS (SELECT doc_id, end_id, sum(n) OVER (PARTITION BY doc_id ORDER BY end_id) AS ended FROM e)
    SELECT t.doc_id, t.node_id AS context_id, count(*) OVER (PARTITION BY t.doc_id) - 1 - t.end_id AS following, CAST(coalesce(b.ended, 0) AS BIGINT) AS preceding
    FROM t ASOF LEFT JOIN b ON b.doc_id = t.doc_id AND t.node_id - 1 >= b.end_id""")
def tree_following(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes follow and precede every node, by running counts."""
    tree = _tree(spark, sf_dir)
    behind, before = blocks.counts(tree, tree, "following"), blocks.counts(tree, tree, "preceding")
    return behind.withColumnRenamed("n", "following").join(before.withColumnRenamed("n", "preceding"), ["doc_id", "context_id"])


@query(f"WITH {_TREE} SELECT doc_id, node_id, lag(node_id) OVER w AS prev_id, lead(node_id) OVER w AS next_id FROM t WINDOW w AS (PARTITION BY doc_id, parent_id ORDER BY node_id)")
def tree_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.siblings(_tree(spark, sf_dir)).select("doc_id", "node_id", "prev_id", "next_id")


@query(f"""WITH {_TREE}, s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY node_id) AS n FROM t)
    SELECT s.doc_id, s.node_id AS context_id, CASE s.depth WHEN 0 THEN '1' WHEN 1 THEN '1.' || s.n WHEN 2 THEN '1.' || b.n || '.' || s.n ELSE '1.' || c.n || '.' || b.n || '.' || s.n END AS outline
    FROM s LEFT JOIN s b ON s.doc_id = b.doc_id AND s.parent_id = b.node_id LEFT JOIN s c ON b.doc_id = c.doc_id AND b.parent_id = c.node_id""")
def tree_outline_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.outline_numbers(_tree(spark, sf_dir))


_CHUNKS = f"""{_TREE}, f AS (SELECT doc_id, parent_id, min(node_id) AS first_child FROM t WHERE depth BETWEEN 1 AND 2 GROUP BY 1, 2),
    k AS (SELECT t.doc_id, t.node_id, t.node_id AS chunk_start, CASE WHEN first_child IS NULL THEN end_id ELSE first_child - 1 END AS chunk_stop, first_child IS NOT NULL AS synthetic, t.label
        FROM t LEFT JOIN f ON t.doc_id = f.doc_id AND t.node_id = f.parent_id WHERE depth <= 2)"""


@query(f"WITH {_CHUNKS} SELECT doc_id, node_id, chunk_start, chunk_stop, synthetic FROM k")
def tree_depth_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.depth_chunks(_tree(spark, sf_dir), 2)


def _anchors(tree: DataFrame) -> DataFrame:
    chunks = nodes.depth_chunks(tree, 2).withColumn("file", F.concat(F.lit("c"), F.col("node_id").cast("string"), F.lit(".html")))
    ids = tree.withColumn("xml_id", F.when(F.col("node_id") % 3 == 0, F.concat(F.lit("n"), F.col("node_id").cast("string"))))
    return passages.anchor_map(chunks, ids)


_ANCHORS = f"""{_CHUNKS}, a AS (SELECT t.doc_id, 'n' || t.node_id AS anchor, arg_min('c' || k.node_id || '.html', k.chunk_start) AS file
    FROM t JOIN k ON t.doc_id = k.doc_id AND t.node_id BETWEEN k.chunk_start AND k.chunk_stop WHERE t.node_id % 3 = 0 GROUP BY 1, 2)"""


@query(f"WITH {_ANCHORS} SELECT * FROM a")
def tree_anchor_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anchors(_tree(spark, sf_dir))


@query(f"""WITH {_ANCHORS}, l AS (SELECT doc_id, node_id, '#n' || (node_id + 1) AS target, 'n' || (node_id + 1) AS anchor, 'c' || node_id || '.html' AS from_file FROM t)
    SELECT l.doc_id, node_id, CASE WHEN file IS NULL THEN target WHEN file = from_file THEN '#' || l.anchor ELSE file || '#' || l.anchor END AS href
    FROM l LEFT JOIN a ON l.doc_id = a.doc_id AND l.anchor = a.anchor""")
def tree_link_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir)
    links = tree.select("doc_id", "node_id", F.concat(F.lit("#n"), (F.col("node_id") + 1).cast("string")).alias("target"), F.concat(F.lit("c"), F.col("node_id").cast("string"), F.lit(".html")).alias("from_file"))
    return passages.rewrite_links(links, _anchors(tree)).select("doc_id", "node_id", "href")


# ---------------------------------------------------------------- rules

LINE_RULES = """<schemaSpec ns="">
  <elementSpec ident="R"><model predicate="@quantity &gt; 40" behaviour="block"/><model predicate="@discount &lt; 0.02" behaviour="paragraph"/><model behaviour="inline"/></elementSpec>
  <elementSpec ident="A"><model predicate="@mode = 'never'" behaviour="list"/><model predicate="@quantity &lt;= 5" output="print" behaviour="note"/><model predicate="@quantity &lt;= 10" output="opm-web" behaviour="cell"/></elementSpec>
  <elementSpec ident="N"><model behaviour="figure"/><model predicate="@quantity &gt; 1" behaviour="omit"/></elementSpec>
</schemaSpec>"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    attrs = F.create_map(F.lit("quantity"), F.col("l_quantity").cast("string"), F.lit("discount"), F.col("l_discount").cast("string"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("tag"), F.lit("").alias("ns"), attrs.alias("attrs"), F.lit("").alias("string_value"), *[empty.alias(c) for c in ("anc_tags", "child_tags", "before_tags", "after_tags")])


def _dispatched(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    rules = RuleSet.parse(LINE_RULES).channel(mode)
    won = F.try_element_at(rules.winners(), F.lit(1))
    return _lines(spark, sf_dir).withColumn("rule_element", rules.dispatch_key()).withColumn("w", won).select("l_orderkey", "l_linenumber", "tag", F.col("w.rule_key").alias("rule_key"), F.col("w.behaviour").alias("behaviour"))


_WEB = """w AS (SELECT l_orderkey, l_linenumber, l_returnflag AS tag,
    CASE WHEN l_returnflag = 'R' AND l_quantity > 40 THEN 'tei-R1' WHEN l_returnflag = 'R' AND l_discount < 0.02 THEN 'tei-R2' WHEN l_returnflag = 'R' THEN 'tei-R3'
        WHEN l_returnflag = 'A' AND l_quantity <= 10 THEN 'tei-A3' WHEN l_returnflag = 'N' THEN 'tei-N1' END AS rule_key FROM lineitem),
    b AS (SELECT *, CASE rule_key WHEN 'tei-R1' THEN 'block' WHEN 'tei-R2' THEN 'paragraph' WHEN 'tei-R3' THEN 'inline' WHEN 'tei-A3' THEN 'cell' WHEN 'tei-N1' THEN 'figure' END AS behaviour FROM w)"""


@query(f"WITH {_WEB} SELECT l_orderkey, l_linenumber, rule_key, behaviour FROM b")
def rule_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dispatched(spark, sf_dir, "web").select("l_orderkey", "l_linenumber", "rule_key", "behaviour")


@query("""SELECT coalesce(CASE WHEN l_returnflag = 'A' AND l_quantity <= 5 THEN 'note' WHEN l_returnflag = 'A' AND l_quantity <= 10 THEN 'cell' WHEN l_returnflag = 'R' AND l_quantity > 40 THEN 'block' WHEN l_returnflag = 'R' AND l_discount < 0.02 THEN 'paragraph'
    WHEN l_returnflag = 'R' THEN 'inline' WHEN l_returnflag = 'N' THEN 'figure' END, 'unmatched') AS behaviour, count(*) AS n FROM lineitem GROUP BY 1""")
def rule_channel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dispatched(spark, sf_dir, "print").groupBy(F.coalesce("behaviour", F.lit("unmatched")).alias("behaviour")).agg(F.count("*").alias("n"))


@query(f"WITH {_WEB} SELECT rule_key, count(*) AS hits FROM b WHERE rule_key IS NOT NULL GROUP BY 1")
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.operators import records

    return records.rule_hits(_dispatched(spark, sf_dir, "web"))


@query(f"WITH {_WEB}, r AS (SELECT * FROM (VALUES ('tei-R1'), ('tei-R2'), ('tei-R3'), ('tei-A1'), ('tei-A2'), ('tei-A3'), ('tei-N1')) v(rule_key)) SELECT rule_key FROM r WHERE rule_key NOT IN (SELECT rule_key FROM b WHERE rule_key IS NOT NULL)")
def rule_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = RuleSet.parse(LINE_RULES).table(spark)
    fired = _dispatched(spark, sf_dir, "web").select("rule_key").distinct()  # each task hands on a rule once, however many rows it won
    return table.where("local and unreachable is null").join(fired, "rule_key", "left_anti").select("rule_key")


@query("SELECT 'tei-N2' AS rule_key, 'an earlier rule without a predicate always wins' AS unreachable")
def rule_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RuleSet.parse(LINE_RULES).table(spark).where("unreachable is not null").select("rule_key", "unreachable")


ORDER_RULES = """<schemaSpec ns=""><elementSpec ident="order"><modelSequence>
  <model predicate="@status = 'F'" behaviour="heading"/><model predicate="@total &gt; 150000" behaviour="note"/><model behaviour="paragraph"/></modelSequence></elementSpec></schemaSpec>"""


@query("""SELECT o_orderkey, 'heading' AS behaviour, 1 AS ordinal FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'note', 2 FROM orders WHERE o_totalprice > 150000
    UNION ALL SELECT o_orderkey, 'paragraph', 3 FROM orders""")
def rule_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = RuleSet.parse(ORDER_RULES)
    empty = F.array().cast("array<string>")
    attrs = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("total"), F.col("o_totalprice").cast("string"))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.lit("order").alias("tag"), F.lit("order").alias("rule_element"), attrs.alias("attrs"), F.lit("").alias("string_value"), *[empty.alias(c) for c in ("anc_tags", "child_tags", "before_tags", "after_tags")])
    won = rows.select("o_orderkey", F.explode(rules.winners()).alias("w"))
    return won.select("o_orderkey", F.col("w.behaviour").alias("behaviour"), F.regexp_extract("w.rule_key", r"(\d+)$", 1).cast("int").alias("ordinal"))


_BASE = """<schemaSpec ns=""><elementSpec ident="p"><model behaviour="paragraph"/></elementSpec><elementSpec ident="hi"><model predicate="@rend" behaviour="inline"/></elementSpec><elementSpec ident="q"><model behaviour="cit"/></elementSpec></schemaSpec>"""
_CHILD = """<schemaSpec ns="" source="base"><elementSpec ident="p"><model predicate="@rend" behaviour="block"/><model behaviour="paragraph"/></elementSpec><elementSpec ident="hi"/><elementSpec ident="note"><model behaviour="note"/></elementSpec></schemaSpec>"""


@query("""SELECT * FROM (VALUES ('tei-p1', 'block', 'child'), ('tei-p2', 'paragraph', 'child'), ('tei-hi1', 'inline', 'base'), ('tei-q1', 'cit', 'base'), ('tei-note1', 'note', 'child')) v(rule_key, behaviour, source)""")
def rule_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RuleSet.parse(_CHILD, "child", {"base": _BASE}.get).table(spark).select("rule_key", "behaviour", "source")


# ---------------------------------------------------------------- registers, facets

@query("""WITH f AS (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, string_agg(l_returnflag, '|' ORDER BY pos, l_returnflag) AS flags FROM f GROUP BY 1""")
def facet_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    return passages.ordered_facets(lines, "l_orderkey", "l_returnflag", "l_linenumber", "flags").select("l_orderkey", F.array_join("flags", "|").alias("flags"))


@query("""SELECT 'o' || o_orderkey || '#' || l_linenumber AS id, 'o' || o_orderkey AS parent, 'line' AS kind, l_quantity AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def child_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = _table(spark, sf_dir, "orders").select("o_orderkey")
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    parent = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    return parents.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(parent, F.lit("#"), F.col("l_linenumber").cast("string")).alias("id"), parent.alias("parent"), F.lit("line").alias("kind"), F.col("l_quantity").alias("quantity"))


# ---------------------------------------------------------------- schema graphs

_EDGES = "e AS (SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey + n_regionkey) % 25 FROM nation)"


def _class_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("dst")).union(n.select("n_nationkey", (F.col("n_nationkey") + F.col("n_regionkey")) % 25)).distinct()


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT * FROM r")
def class_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.closure(_class_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT dst AS src, src AS dst FROM e UNION SELECT r.src, e.src FROM r JOIN e ON r.dst = e.dst) SELECT src AS ident, count(*) AS ancestors, min(dst) AS least FROM r GROUP BY 1")
def class_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = specs.closure(_class_edges(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return up.groupBy(F.col("src").alias("ident")).agg(F.count("*").alias("ancestors"), F.min("dst").alias("least"))
