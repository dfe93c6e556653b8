"""Queries over documents, pages, conversations, labels, embeddings and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import documents, passages, records, render, similarity
from quillspark.plans.catalogue import query
from quillspark.plans.rules import RuleSet
from quillspark.session import settled
from quillspark.sources.markup import shred
from quillspark.streaming import watch

_LINES = r"""lines AS (
    SELECT doc_id, CAST(i AS BIGINT) AS line_no, trim(regexp_replace(l[i], '\s+', ' ', 'g')) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(generate_series(1, len(l))) AS u(i)
    WHERE trim(regexp_replace(l[i], '\s+', ' ', 'g')) <> '')"""
_UNITS = _LINES + """,
    marked AS (SELECT *, sum(CASE WHEN length(line) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS unit_no FROM lines),
    units AS (SELECT doc_id, CAST(unit_no AS BIGINT) AS unit_no, string_agg(line, ' ' ORDER BY line_no) AS document, count(*) AS n_lines FROM marked GROUP BY 1, 2)"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = passages.runs_of_lines(_table(spark, sf_dir, "documents"))
    return passages.units(passages.islands(runs, F.length("line") < 40))


@query(f"WITH {_LINES} SELECT * FROM lines")
def doc_lines_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.runs_of_lines(_table(spark, sf_dir, "documents"))


@query(f"WITH {_LINES} SELECT doc_id, min(line_no) AS line_no, arg_min(line, line_no) AS heading FROM lines WHERE length(line) < 40 GROUP BY 1")
def doc_first_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = passages.runs_of_lines(_table(spark, sf_dir, "documents")).where(F.length("line") < 40)
    return runs.groupBy("doc_id").agg(F.min("line_no").alias("line_no"), F.min_by("line", "line_no").alias("heading"))


@query(f"WITH {_UNITS} SELECT doc_id, unit_no, n_lines, document FROM units")
def doc_passages_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, sf_dir).select("doc_id", F.col("unit_no").cast("long"), F.size("parts").cast("long").alias("n_lines"), "document")


@query(f"""WITH {_UNITS} SELECT doc_id, unit_no, row_number() OVER (PARTITION BY doc_id ORDER BY unit_no) - 1 AS part, count(*) OVER (PARTITION BY doc_id) AS n_parts,
    length(document) AS chars, substr(sha1(document), 1, 16) AS hash FROM units WHERE length(document) >= 40""")
def doc_passages_minchars(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _units(spark, sf_dir).where(F.length("document") >= 40)
    w = Window.partitionBy("doc_id")
    return kept.select("doc_id", F.col("unit_no").cast("long"), (F.row_number().over(w.orderBy("unit_no")) - 1).cast("long").alias("part"), F.count("*").over(w).alias("n_parts"), F.length("document").cast("long").alias("chars"), text.content_hash(F.col("document")).alias("hash"))


@query(rf"""WITH RECURSIVE {_LINES},
    marked AS (SELECT *, sum(CASE WHEN length(line) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS unit_no FROM lines),
    numbered AS (SELECT doc_id, unit_no, line, row_number() OVER (PARTITION BY doc_id, unit_no ORDER BY line_no) AS k, sum(length(line) + 1) OVER (PARTITION BY doc_id, unit_no) - 1 > 1500 AS long FROM marked),
    walk AS (
        SELECT doc_id, unit_no, k, line AS cur, length(line) + 1 AS size, line AS prev, 0 AS piece FROM numbered WHERE k = 1
        UNION ALL
        SELECT n.doc_id, n.unit_no, n.k, CASE WHEN long AND size + length(n.line) + 1 > 1500 THEN w.prev || ' ' || n.line ELSE w.cur || ' ' || n.line END,
            CASE WHEN long AND size + length(n.line) + 1 > 1500 THEN length(w.prev) + length(n.line) + 2 ELSE size + length(n.line) + 1 END, n.line,
            CASE WHEN long AND size + length(n.line) + 1 > 1500 THEN w.piece + 1 ELSE w.piece END
        FROM walk w JOIN numbered n ON n.doc_id = w.doc_id AND n.unit_no = w.unit_no AND n.k = w.k + 1),
    made AS (SELECT doc_id, unit_no, piece, arg_max(cur, k) AS document FROM walk GROUP BY 1, 2, 3)
    SELECT doc_id, CAST(unit_no AS BIGINT) AS unit_no, row_number() OVER (PARTITION BY doc_id, unit_no ORDER BY piece) - 1 AS part, count(*) OVER (PARTITION BY doc_id, unit_no) AS n_parts,
        length(document) AS chars, substr(sha1(document), 1, 16) AS hash FROM made WHERE length(document) >= 40""")
def doc_passages_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.pieces(_units(spark, sf_dir)).select("doc_id", F.col("unit_no").cast("long"), "part", "n_parts", "chars", "hash")


@query(f"""WITH {_UNITS}, ids AS (SELECT doc_id, unit_no, 'doc' || doc_id || '#' || substr(sha1('lines|' || substr(document, 1, 12)), 1, 12) AS id, document FROM units)
    SELECT doc_id, unit_no, CASE WHEN k > 0 THEN id || '~' || k ELSE id END AS id, substr(sha1(document), 1, 16) AS hash
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY unit_no) - 1 AS k FROM ids)""")
def doc_passage_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _units(spark, sf_dir).withColumn("id", text.stable_id(F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.lit(None).cast("string"), F.lit("lines"), F.substring("document", 1, 12)))
    return passages.with_suffixes(rows, "id", ["unit_no"], ["doc_id"]).select("doc_id", F.col("unit_no").cast("long"), "id", text.content_hash(F.col("document")).alias("hash"))


@query("""WITH old AS (SELECT doc_id, sha1(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 3),
    new AS (SELECT doc_id, sha1(text) AS h FROM documents)
    SELECT coalesce(old.doc_id, new.doc_id) AS doc_id, CASE WHEN old.h IS NULL THEN 'new' WHEN new.h IS NULL THEN 'gone' WHEN old.h = new.h THEN 'unchanged' ELSE 'changed' END AS action
    FROM old FULL JOIN new ON old.doc_id = new.doc_id""")
def doc_incremental_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    old = docs.where("doc_id % 10 <> 3").select("doc_id", F.sha1(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return passages.hash_diff(old, docs.select("doc_id", F.sha1("text").alias("hash")), "doc_id")


@query("""SELECT d.lang, l.quality, l.toxic, count(*) AS n, CAST(sum(d.n_chars) AS BIGINT) AS chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2, 3""")
def labels_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(_table(spark, sf_dir, "labels"), "doc_id").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"), F.sum("n_chars").cast("long").alias("chars"))


# ---------------------------------------------------------------- pages

# Our own rules for web pages, in the rule language of the engine.
PAGE_RULES = """<schemaSpec ns="">
  <elementSpec ident="html"><model behaviour="document"/></elementSpec>
  <elementSpec ident="head"><model behaviour="metadata"/></elementSpec>
  <elementSpec ident="title"><model behaviour="title"/></elementSpec>
  <elementSpec ident="body"><model behaviour="body"/></elementSpec>
  <elementSpec ident="article"><model behaviour="section"/></elementSpec>
  <elementSpec ident="nav"><model behaviour="omit"/></elementSpec>
  <elementSpec ident="script"><model behaviour="omit"/></elementSpec>
  <elementSpec ident="style"><model behaviour="omit"/></elementSpec>
  <elementSpec ident="div">
    <model predicate="@class = 'ad'" behaviour="omit"/>
    <model predicate="ancestor::article" behaviour="block"/>
    <model behaviour="block"/>
    <model predicate="@id" behaviour="section"/>
  </elementSpec>
  <elementSpec ident="h1"><model behaviour="heading"><param name="level" value="'1'"/></model></elementSpec>
  <elementSpec ident="p"><model predicate="not(normalize-space(.))" behaviour="omit"/><model behaviour="paragraph"/></elementSpec>
  <elementSpec ident="b"><model behaviour="inline"/></elementSpec>
  <elementSpec ident="a"><model predicate="starts-with(@href, '/')" behaviour="link"><param name="uri" value="@href"/></model></elementSpec>
  <elementSpec ident="ul"><model behaviour="list"/></elementSpec>
  <elementSpec ident="li"><model predicate="parent::ul" behaviour="listItem"/></elementSpec>
  <elementSpec ident="br"><model behaviour="break"/></elementSpec>
  <elementSpec ident="table"><model behaviour="table"/></elementSpec>
</schemaSpec>"""


def _page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred(_table(spark, sf_dir, "pages"), "page_id", "html", "html")


def _page_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, RuleSet]:
    nodes = settled(_page_nodes(spark, sf_dir))  # each page is parsed once, however often its nodes are read
    rules = RuleSet.parse(PAGE_RULES)
    return nodes, records.dispatch(nodes, rules), rules


@query("""SELECT CAST(page_id AS VARCHAR) AS doc_id, 'links' AS name, CAST(k AS INTEGER) AS item_no, h[k] AS value FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages), unnest(generate_series(1, len(h))) AS u(k)""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of links, by an expression over the parsed pages."""
    return documents.evaluated(_table(spark, sf_dir, "pages"), {"links": "//a/@href"}, documents.Setup(kind="html"), id_="page_id", raw="html")


@query("""SELECT CAST(page_id AS VARCHAR) AS doc_id, replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS title FROM pages""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.evaluated(_table(spark, sf_dir, "pages"), {"title": "string(//title)"}, documents.Setup(kind="html"), id_="page_id", raw="html")
    return found.select("doc_id", F.col("value").alias("title"))


@query()
def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_nodes(spark, sf_dir).select("doc_id", "node_id", "end_id", "parent_id", "depth", "kind", "tag", "xpath", "line", "col", "text")


@query("""WITH t AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '<\\1>', 'gs'), '<([a-z][a-z0-9]*)[ />]', 1)) AS tag FROM pages)
    SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM t GROUP BY 1""")
def page_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_nodes(spark, sf_dir).where("kind = 'e'").groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("pages"))


_SHOWN = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<head>.*?</head>', '<head>', 'gs'), '<(nav|script|style)>.*?</(nav|script|style)>', '<\\1>', 'gs'), '<div class="ad">.*?</div>', '<ad>', 'gs')"""
_HEADLESS = """regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '<\\1>', 'gs'), '<div class="ad">', '<ad>', 'g')"""
_BEHAVIOUR = """CASE tag WHEN 'html' THEN 'document' WHEN 'head' THEN 'metadata' WHEN 'title' THEN 'title' WHEN 'body' THEN 'body' WHEN 'article' THEN 'section' WHEN 'nav' THEN 'omit' WHEN 'script' THEN 'omit' WHEN 'style' THEN 'omit' WHEN 'ad' THEN 'omit' WHEN 'div' THEN 'block'
    WHEN 'h1' THEN 'heading' WHEN 'p' THEN 'paragraph' WHEN 'b' THEN 'inline' WHEN 'a' THEN 'link' WHEN 'ul' THEN 'list' WHEN 'li' THEN 'list_item' WHEN 'br' THEN 'break' WHEN 'table' THEN 'table' END"""


def _tags(source: str) -> str:
    return f"""SELECT page_id, unnest(regexp_extract_all({source}, '<([a-z][a-z0-9]*)[ />]', 1)) AS tag FROM pages"""


@query(f"""WITH t AS ({_tags(_SHOWN)}) SELECT CAST(page_id AS VARCHAR) AS doc_id, CASE tag WHEN 'ad' THEN 'div' ELSE tag END AS tag, {_BEHAVIOUR} AS behaviour, count(*) AS n FROM t GROUP BY ALL""")
def page_record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each page outside suppressed subtrees, by tag and behaviour."""
    return records.pruned(_page_records(spark, sf_dir)[1]).groupBy("doc_id", "tag", "behaviour").agg(F.count("*").alias("n"))


@query(r"""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<head>.*?</head>', '', 'gs'), '<(nav|script|style)>.*?</(nav|script|style)>', '', 'gs'), '<div class="ad">.*?</div>', '', 'gs') AS x FROM pages),
    t AS (SELECT page_id, regexp_replace(regexp_replace(x, '</?(div|p|article|body|ul|table|h1|li)( [^>]*)?>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM s)
    SELECT CAST(page_id AS VARCHAR) AS doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) AS output FROM t""")
def page_text_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, found, _ = _page_records(spark, sf_dir)
    return render.render(nodes, found, "text")


@query()
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, found, _ = _page_records(spark, sf_dir)
    return render.render(nodes, found, "markdown")


@query()
def page_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, found, _ = _page_records(spark, sf_dir)
    return render.render(nodes, found, "html")


@query()
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found, _ = _page_records(spark, sf_dir)
    return records.pruned(found).select("doc_id", "node_id", "tag", "behaviour", "rule_key", "suppressed", "xpath", "line", "col")


@query(f"""WITH t AS ({_tags(_HEADLESS)}) SELECT tag, count(*) AS n FROM t WHERE {_BEHAVIOUR} IS NULL GROUP BY 1""")
def page_coverage_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.unmatched(_page_records(spark, sf_dir)[1])


@query(f"""WITH t AS ({_tags(_SHOWN)}) SELECT tag, count(*) AS n FROM t WHERE {_BEHAVIOUR} IS NULL GROUP BY 1""")
def page_coverage_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, found, _ = _page_records(spark, sf_dir)
    return records.dropped(nodes, found.where("behaviour is not null")).groupBy("tag").agg(F.count("*").alias("n"))


@query(f"""WITH t AS ({_tags(_HEADLESS)}) SELECT coalesce({_BEHAVIOUR}, 'unmatched') AS behaviour, count(*) AS n FROM t GROUP BY 1""")
def page_coverage_behaviours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.behaviour_counts(_page_records(spark, sf_dir)[1])


@query(f"""WITH t AS (SELECT DISTINCT tag FROM ({_tags(_HEADLESS)})), r AS (SELECT * FROM (VALUES ('tei-div2', 'div', 'block'), ('tei-div3', 'div', 'block'), ('tei-div4', 'div', 'section'), ('tei-p1', 'p', 'omit')) v(rule_key, element, behaviour))
    SELECT r.* FROM r JOIN t ON t.tag = CASE element WHEN 'div' THEN 'ad' ELSE element END""")
def page_coverage_unused_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, found, rules = _page_records(spark, sf_dir)
    return records.unused_rules(rules.table(spark), found, nodes).select("rule_key", "element", "behaviour")


# ---------------------------------------------------------------- conversations

@query("""SELECT conv_id, turn, role, lag(turn) OVER w AS prev, lead(turn) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def conv_prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.navigation(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "turn").select("conv_id", "turn", "role", "prev", "next")


@query("""SELECT conv_id, count(*) AS n_turns, string_agg(role, '>' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1""")
def conv_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(turns, lambda t: t["role"]), ">").alias("roles"), F.sum(F.length("text")).cast("long").alias("chars"))


_NOTES = "SELECT conv_id, turn, CASE WHEN role = 'system' THEN role END AS label, CAST(count(*) FILTER (role <> 'system') OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS note_no FROM conversations"


def _conv_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.running_numbers(_table(spark, sf_dir, "conversations"), F.when(F.col("role") == "system", F.col("role")), "conv_id", "turn")
    return rows.select("conv_id", "turn", "label", "note_no")


@query(_NOTES)
def conv_note_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conv_notes(spark, sf_dir)


@query(f"""WITH n AS ({_NOTES}) SELECT conv_id, turn, coalesce(label, CAST(note_no AS VARCHAR)) AS marker,
    row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN label IS NULL THEN 1 ELSE 0 END, note_no, turn) AS note_order FROM n""")
def conv_notes_labelled_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _conv_notes(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("node_id"), "note_no", F.coalesce("label", F.col("note_no").cast("string")).alias("marker"))
    return records.labelled_first(marked).select(F.col("doc_id").alias("conv_id"), F.col("node_id").alias("turn"), "marker", F.col("note_order").cast("long").alias("note_order"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS anchor FROM conversations""")
def conv_running_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").withColumn("own", F.when(F.col("role") == "user", F.col("turn")))
    return passages.carry(rows, "own", "conv_id", "turn", "anchor").select("conv_id", "turn", "anchor")


# ---------------------------------------------------------------- embeddings, events

@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
    d AS (SELECT vec_id, label, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) AS distance FROM embeddings, q WHERE label IN (1, 2, 3))
    SELECT vec_id, label, round(distance, 6) AS distance FROM d ORDER BY d.distance, vec_id LIMIT 5""")
def nearest_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    first = rows.where("vec_id = 0").select("embedding").first()
    return similarity.nearest(rows, first["embedding"] if first else [1.0], 5, "label in (1, 2, 3)").select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query("""SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k, CAST(sum(length(props)) AS BIGINT) AS chars FROM events GROUP BY 1""")
def params_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.get_json_object("props", "$.k")).alias("with_k"), F.sum(F.length("props")).cast("long").alias("chars"))


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
    SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.sessions(_table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"])


@query("""SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.tumbling(_table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], total=F.round(F.sum("value"), 4))


@query("""SELECT w AS started, event_type, count(*) AS n FROM (SELECT *, unnest([date_trunc('hour', ts), CASE WHEN minute(ts) >= 30 THEN date_trunc('hour', ts) + INTERVAL 30 MINUTE ELSE date_trunc('hour', ts) - INTERVAL 30 MINUTE END]) AS w FROM events) x GROUP BY 1, 2""")
def event_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.sliding(_table(spark, sf_dir, "events"), "ts", "1 hour", "30 minutes", ["event_type"])
