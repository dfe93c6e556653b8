"""Queries that write small XML documents from the tables and put them through the engine: rules, channels, templates,
notes, XPath, pages, passages, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import documents
from quillspark.plans.catalogue import query
from quillspark.plans.rules import RuleSet
from quillspark.tree import pages, passages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(*parts: str | Column) -> Column:
    """Strings and columns in one text; a name in braces is a column."""
    return F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("{") else F.coalesce(F.col(p[1:-1]).cast("string"), F.lit("")) if isinstance(p, str) else p for p in parts])


# ---------------------------------------------------------------- one document for each order

ORDER_RULES = """<schemaSpec ns="">
  <elementSpec ident="order"><model behaviour="section"/></elementSpec>
  <elementSpec ident="meta"><model behaviour="omit"/></elementSpec>
  <elementSpec ident="head"><model behaviour="heading"><param name="level" value="count(ancestor::*) + 1"/></model></elementSpec>
  <elementSpec ident="hi"><model behaviour="inline"/></elementSpec>
  <elementSpec ident="p"><model behaviour="paragraph"/></elementSpec>
  <elementSpec ident="note"><model behaviour="note"><param name="label" value="@n"/></model></elementSpec>
  <elementSpec ident="list"><model behaviour="list"/></elementSpec>
  <elementSpec ident="item"><model behaviour="listItem"/></elementSpec>
  <elementSpec ident="ref"><model behaviour="link"><param name="uri" value="@target"/></model></elementSpec>
  <elementSpec ident="q">
    <model predicate="@unit = 'R' and not(../following-sibling::item)"><param name="place" value="../@n"/><template><b title="line [[place]]">[[content]]</b></template></model>
    <modelSequence predicate="@unit = 'A'"><model behaviour="anchor"><param name="id" value="concat('q', ../@n)"/></model><model behaviour="inline"/></modelSequence>
    <model behaviour="inline"/>
  </elementSpec>
  <elementSpec ident="choice"><model behaviour="alternate"><param name="default" value="reg"/><param name="alternate" value="orig"/></model></elementSpec>
</schemaSpec>"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, raw``: an order with its lines."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("int").alias("qty")).alias("l"))
    items = F.transform(F.array_sort(F.collect_list("l")), lambda l: F.concat(F.lit('<item n="'), l["l_linenumber"].cast("string"), F.lit('"><ref target="#p'), l["part"].cast("string"), F.lit('">part '), l["part"].cast("string"), F.lit('</ref> <q unit="'), l["flag"], F.lit('">'), l["qty"].cast("string"), F.lit("</q></item>")))
    # Narrow rows are dealt out by order, and documents are written where they are processed: their text is not shuffled.
    n = documents.spread(lines)
    grouped = lines.repartition(n, "l_orderkey").groupBy("l_orderkey").agg(F.array_join(items, "").alias("items"))
    note = F.when(F.col("o_orderstatus") == "F", "<note>done</note>").when(F.col("o_orderstatus") == "O", '<note n="a">open</note> and<note>more</note>').otherwise("")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").repartition(n, "o_orderkey")
    rows = orders.join(grouped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    raw = _joined('<order xml:id="o', "{o_orderkey}", '"><meta>', "{o_totalprice}", '</meta><head>Order <hi rend="bold">', "{o_orderkey}", "</hi></head><p>Status ", "{o_orderstatus}", note, ' <choice><orig>olde</orig><reg>old</reg></choice>.</p><list type="ordered">', "{items}", "</list></order>")
    return rows.select(F.col("o_orderkey").alias("doc_id"), raw.alias("raw"))


_LINES = """l AS (SELECT *, place = count(*) OVER (PARTITION BY k) AS final FROM (
        SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_returnflag AS f, CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR) AS q,
            row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, trunc(l_quantity)) AS place FROM lineitem))"""

_HTML = f"""{_LINES},
    i AS (SELECT k, string_agg('<li class="tei-item tei-item1"><a class="tei-ref tei-ref1" href="#p' || p || '">part ' || p || '</a> ' ||
        CASE WHEN f = 'R' AND final THEN '<b title="line ' || n || '">' || q || '</b>'
            WHEN f = 'A' THEN '<span id="q' || n || '" class="tei-q tei-q2"></span><span class="tei-q tei-q3">' || q || '</span>'
            ELSE '<span class="tei-q tei-q4">' || q || '</span>' END || '</li>', '' ORDER BY place) AS items FROM l GROUP BY 1)"""
_ALTERNATE = """'<span class="tei-choice tei-choice1 alternate"><span>old</span><span class="altcontent">olde</span></span>'"""


def _ref(number: str, mark: str, label: bool) -> str:
    data = f' data-n="{mark}"' if label else ""
    return f'<span id="fnref_{number}" style="display:inline-block" class="tei-note tei-note1"{data}><a class="note" rel="footnote" href="#fn_{number}">{mark}</a></span>'


def _foot(number: str, mark: str, text: str, label: bool) -> str:
    data = f' data-n="{mark}"' if label else ""
    return f'<dl class="footnote" id="fn_{number}"{data}><dt class="fn-number">{mark}</dt><dd class="fn-content">{text}<a class="fn-back" href="#fnref_{number}">↩</a></dd></dl>'


@query(f"""WITH {_HTML}
    SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, '<section class="tei-order tei-order1" id="o' || o_orderkey || '"><h2 class="tei-head tei-head1">Order <span class="tei-hi tei-hi1 bold">' || o_orderkey || '</span></h2><p class="tei-p tei-p1">Status ' || o_orderstatus ||
        CASE o_orderstatus WHEN 'F' THEN '{_ref("1", "1", False)}' WHEN 'O' THEN '{_ref("1", "a", True)} and{_ref("2", "1", False)}' ELSE '' END || ' ' || {_ALTERNATE} || '.</p><ol class="tei-list tei-list1">' || coalesce(items, '') || '</ol>' ||
        CASE o_orderstatus WHEN 'F' THEN '{_foot("1", "1", "done", False)}' WHEN 'O' THEN '{_foot("1", "a", "open", True)}{_foot("2", "1", "more", False)}' ELSE '' END || '</section>' AS output
    FROM orders LEFT JOIN i ON k = o_orderkey""")
def xml_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, headings, inlines, lists, links, notes with their footnotes, alternates, a template, a sequence."""
    return documents.rendered(_orders(spark, sf_dir), RuleSet.parse(ORDER_RULES)).select("doc_id", "output")


@query(f"""WITH {_HTML}
    SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, '<section class="tei-order tei-order1" id="o' || o_orderkey || '"><h2 class="tei-head tei-head1">Order <span class="tei-hi tei-hi1 bold">' || o_orderkey || '</span></h2><p class="tei-p tei-p1">Status ' || o_orderstatus ||
        CASE o_orderstatus WHEN 'F' THEN '<span class="tei-note tei-note1 footnote" id="fn_1">done</span>' WHEN 'O' THEN '<span class="tei-note tei-note1 footnote" id="fn_1" data-n="a">open</span> and<span class="tei-note tei-note1 footnote" id="fn_2">more</span>' ELSE '' END ||
        ' old<span class="tei-choice tei-choice1 footnote" id="fn_' || CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 3 ELSE 1 END || '">olde</span>.</p><ol class="tei-list tei-list1">' || coalesce(items, '') || '</ol></section>' AS output
    FROM orders LEFT JOIN i ON k = o_orderkey""")
def xml_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The print channel: notes stand where they are, alternates become notes."""
    return documents.rendered(_orders(spark, sf_dir), RuleSet.parse(ORDER_RULES), "print").select("doc_id", "output")


@query(f"""WITH {_LINES},
    i AS (SELECT k, string_agg(place || '. [part ' || p || '](#p' || p || ') ' || CASE WHEN f = 'R' AND final THEN '<b title="line ' || n || '">' || q || '</b>' WHEN f = 'A' THEN '<a id="q' || n || '"></a>' || q ELSE q END, chr(10) ORDER BY place) AS items FROM l GROUP BY 1)
    SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, '## Order **' || o_orderkey || '**' || chr(10) || chr(10) || 'Status ' || o_orderstatus || CASE o_orderstatus WHEN 'F' THEN '[^1]' WHEN 'O' THEN '[^a] and[^1]' ELSE '' END || ' old.' ||
        coalesce(chr(10) || chr(10) || items, '') || CASE o_orderstatus WHEN 'F' THEN chr(10) || chr(10) || '[^1]: done' WHEN 'O' THEN chr(10) || chr(10) || '[^a]: open' || chr(10) || chr(10) || '[^1]: more' ELSE '' END AS output
    FROM orders LEFT JOIN i ON k = o_orderkey""")
def xml_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.rendered(_orders(spark, sf_dir), RuleSet.parse(ORDER_RULES), "markdown").select("doc_id", "output")


@query(f"""WITH {_LINES},
    i AS (SELECT k, string_agg('+ #link(<p' || p || '>)[part ' || p || '] ' || CASE WHEN f = 'R' AND final THEN '<b title="line ' || n || '">' || q || '</b>' WHEN f = 'A' THEN '#metadata(none)<q' || n || '>' || q ELSE q END, chr(10) ORDER BY place) AS items FROM l GROUP BY 1)
    SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, '== Order #strong[' || o_orderkey || ']' || chr(10) || chr(10) || 'Status ' || o_orderstatus || CASE o_orderstatus WHEN 'F' THEN '#footnote[done]' WHEN 'O' THEN '#footnote[open] and#footnote[more]' ELSE '' END || ' old\\.' ||
        coalesce(chr(10) || chr(10) || items, '') AS output
    FROM orders LEFT JOIN i ON k = o_orderkey""")
def xml_typst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.rendered(_orders(spark, sf_dir), RuleSet.parse(ORDER_RULES), "typst").select("doc_id", "output")


@query(f"""WITH {_LINES}, d AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders),
    r AS (
        SELECT k, 'order' AS element, 'section' AS behaviour, 'tei-order1' AS model, 0 AS suppressed, '' AS own_text, '' AS params FROM d
        UNION ALL SELECT k, 'meta', 'omit', 'tei-meta1', 1, '', '' FROM d
        UNION ALL SELECT k, 'head', 'heading', 'tei-head1', 0, 'Order', 'level=2' FROM d
        UNION ALL SELECT k, 'hi', 'inline', 'tei-hi1', 0, CAST(k AS VARCHAR), '' FROM d
        UNION ALL SELECT k, 'p', 'paragraph', 'tei-p1', 0, 'Status ' || s || CASE WHEN s = 'O' THEN ' and' ELSE '' END || ' .', '' FROM d
        UNION ALL SELECT k, 'choice', 'alternate', 'tei-choice1', 0, '', '' FROM d
        UNION ALL SELECT k, 'reg', NULL, NULL, 0, 'old', '' FROM d
        UNION ALL SELECT k, 'note', 'note', 'tei-note1', 0, 'done', '' FROM d WHERE s = 'F'
        UNION ALL SELECT k, 'note', 'note', 'tei-note1', 0, 'open', 'label=a' FROM d WHERE s = 'O'
        UNION ALL SELECT k, 'note', 'note', 'tei-note1', 0, 'more', '' FROM d WHERE s = 'O'
        UNION ALL SELECT k, 'list', 'list', 'tei-list1', 0, '', '' FROM d
        UNION ALL SELECT k, 'item', 'list_item', 'tei-item1', 0, '', '' FROM l
        UNION ALL SELECT k, 'ref', 'link', 'tei-ref1', 0, 'part ' || p, 'uri=#p' || p FROM l
        UNION ALL SELECT k, 'q', 'template', 'tei-q1', 0, q, 'place=' || n FROM l WHERE f = 'R' AND final
        UNION ALL SELECT k, 'q', 'anchor', 'tei-q2', 0, q, 'id=q' || n FROM l WHERE f = 'A'
        UNION ALL SELECT k, 'q', 'inline', 'tei-q3', 0, q, '' FROM l WHERE f = 'A'
        UNION ALL SELECT k, 'q', 'inline', 'tei-q4', 0, q, '' FROM l WHERE f <> 'A' AND NOT (f = 'R' AND final))
    SELECT CAST(k AS VARCHAR) AS doc_id, element, behaviour, model, suppressed = 1 AS suppressed, own_text, params FROM r WHERE k IN (SELECT o_orderkey FROM orders)""")
def xml_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision records: first match, unmatched elements, suppression, parameters, alternates by their default."""
    found = documents.recorded(_orders(spark, sf_dir), RuleSet.parse(ORDER_RULES), columns=["element", "behaviour", "model", "params", "suppressed", "own_text"])
    shown = F.array_join(F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return found.select("doc_id", "element", "behaviour", "model", "suppressed", "own_text", shown.alias("params"))


_EXPRESSIONS = {
    "lines": "count(//item)", "last": "//item[last()]/@n", "sum": "sum(//q)", "most": "max(//q/number())", "refs": "string-join(//ref/@target, ' ')", "flags": "string-join(distinct-values(//q/@unit), '|')",
    "notes": "//note[not(@n)]/string()", "after": "count(//item[q/@unit = 'R'][1]/following-sibling::item)", "id": "id(concat('o', substring-after(//head/string(), ' ')))/local-name()", "big": "if (some $q in //q satisfies $q > 49) then 'yes' else 'no'",
    "loop": "string-join(for $i in //item[position() <= 2] return concat($i/@n, ':', $i/q), ';')",
}


@query(f"""WITH {_LINES}, a AS (
        SELECT k, CAST(count(*) AS VARCHAR) AS lines, CAST(max(n) AS VARCHAR) AS last, CAST(CAST(sum(CAST(q AS INTEGER)) AS BIGINT) AS VARCHAR) AS sum, CAST(max(CAST(q AS INTEGER)) AS VARCHAR) AS most, string_agg('#p' || p, ' ' ORDER BY place) AS refs,
            max(CAST(q AS INTEGER)) > 49 AS big, string_agg(n || ':' || q, ';' ORDER BY place) FILTER (place <= 2) AS loop, min(place) FILTER (f = 'R') AS first_r FROM l GROUP BY 1),
    f AS (SELECT k, string_agg(f, '|' ORDER BY n) AS flags FROM (SELECT k, f, min(place) AS n FROM l GROUP BY 1, 2) GROUP BY 1),
    b AS (SELECT l.k, CAST(count(*) FILTER (l.place > first_r) AS VARCHAR) AS after FROM l JOIN a ON a.k = l.k GROUP BY 1),
    x AS (SELECT o_orderkey AS k, o_orderstatus AS s, a.*, flags, after FROM orders LEFT JOIN a ON a.k = o_orderkey LEFT JOIN f ON f.k = o_orderkey LEFT JOIN b ON b.k = o_orderkey)
    SELECT CAST(k AS VARCHAR) AS doc_id, name, 1 AS item_no, value FROM (
        SELECT k, 'lines' AS name, coalesce(lines, '0') AS value FROM x UNION ALL SELECT k, 'last', last FROM x WHERE last IS NOT NULL UNION ALL SELECT k, 'sum', coalesce(sum, '0') FROM x UNION ALL SELECT k, 'most', most FROM x WHERE most IS NOT NULL
        UNION ALL SELECT k, 'refs', coalesce(refs, '') FROM x UNION ALL SELECT k, 'flags', coalesce(flags, '') FROM x UNION ALL SELECT k, 'notes', CASE s WHEN 'F' THEN 'done' ELSE 'more' END FROM x WHERE s IN ('F', 'O')
        UNION ALL SELECT k, 'after', coalesce(after, '0') FROM x UNION ALL SELECT k, 'id', 'order' FROM x UNION ALL SELECT k, 'big', CASE WHEN big THEN 'yes' ELSE 'no' END FROM x UNION ALL SELECT k, 'loop', coalesce(loop, '') FROM x)""")
def xml_xpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of several steps, nested predicates, positions, loops, quantifiers, aggregates, ids."""
    return documents.evaluated(_orders(spark, sf_dir), _EXPRESSIONS)


@query(f"""WITH {_LINES}, h AS (SELECT f, final FROM l WHERE k IN (SELECT o_orderkey FROM orders)), o AS (SELECT count(*) AS d, count(*) FILTER (o_orderstatus = 'F') AS fs, count(*) FILTER (o_orderstatus = 'O') AS os FROM orders), c AS (SELECT count(*) AS n, count(*) FILTER (f = 'A') AS a, count(*) FILTER (f = 'R' AND final) AS t FROM h),
    r AS (
        SELECT 'model' AS fact, unnest(['tei-order1', 'tei-meta1', 'tei-head1', 'tei-hi1', 'tei-p1', 'tei-choice1', 'tei-list1']) AS key, d AS n FROM o UNION ALL SELECT 'model', 'tei-note1', fs + 2 * os FROM o
        UNION ALL SELECT 'model', unnest(['tei-item1', 'tei-ref1']), n FROM c UNION ALL SELECT 'model', 'tei-q1', t FROM c UNION ALL SELECT 'model', unnest(['tei-q2', 'tei-q3']), a FROM c UNION ALL SELECT 'model', 'tei-q4', n - a - t FROM c
        UNION ALL SELECT 'element', unnest(['order', 'meta', 'head', 'hi', 'p', 'choice', 'orig', 'reg', 'list']), d FROM o UNION ALL SELECT 'element', 'note', fs + 2 * os FROM o UNION ALL SELECT 'element', unnest(['item', 'ref', 'q']), n FROM c
        UNION ALL SELECT 'unmatched', 'reg', d FROM o UNION ALL SELECT 'dropped', 'orig', d FROM o UNION ALL SELECT 'records', 'suppressed', d FROM o UNION ALL SELECT 'records', 'all', 8 * d + fs + 2 * os + 3 * n + a FROM o, c)
    SELECT fact, key, CAST(n AS BIGINT) AS n FROM r WHERE n > 0""")
def xml_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coverage report's counts: records, suppressed ones, rule hits, elements, unmatched and dropped ones."""
    found = documents.counted(_orders(spark, sf_dir), RuleSet.parse(ORDER_RULES))
    return found.where("fact <> 'behaviour'").select("fact", "key", "n")


# ---------------------------------------------------------------- one document for each customer

CUSTOMER_RULES = """<schemaSpec ns="">
  <elementSpec ident="TEI"><model behaviour="document"/></elementSpec>
  <elementSpec ident="teiHeader"><model behaviour="metadata"/></elementSpec>
  <elementSpec ident="body"><model behaviour="body"/></elementSpec>
  <elementSpec ident="div"><model predicate="@type = 'line'" behaviour="block"/><model behaviour="section"/></elementSpec>
  <elementSpec ident="head"><model behaviour="heading"/></elementSpec>
  <elementSpec ident="p"><model behaviour="paragraph"/></elementSpec>
  <elementSpec ident="pb"><model behaviour="break"/></elementSpec>
  <elementSpec ident="name"><model behaviour="inline"/></elementSpec>
  <elementSpec ident="ref"><model behaviour="link"><param name="uri" value="@target"/></model></elementSpec>
</schemaSpec>"""


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, raw``: a customer with their orders as divisions, large ones with a division for each of two parts."""
    part = lambda o, k: F.concat(F.lit('<div type="line" xml:id="o'), o["k"].cast("string"), F.lit(f'-{k}"><head>Part {k}</head><p>Half of '), o["price"].cast("string"), F.lit("</p></div>"))
    intro = lambda o: F.concat(F.lit("<head>Order "), o["k"].cast("string"), F.lit('</head><pb n="'), o["k"].cast("string"), F.lit('"/><p>Costs <name>'), o["status"], F.lit("</name> "), o["price"].cast("string"), F.lit(' see <ref target="#o'), o["k"].cast("string"), F.lit('">here</ref> or <ref target="#c1">first</ref></p>'))
    one = lambda o: F.concat(F.lit('<div xml:id="o'), o["k"].cast("string"), F.lit('">'), intro(o), F.when(o["price"] > 100000, F.concat(part(o, 1), part(o, 2))).otherwise(""), F.lit("</div>"))
    orders = _table(spark, sf_dir, "orders").select("o_custkey", F.struct(F.col("o_orderkey").alias("k"), F.floor("o_totalprice").cast("long").alias("price"), F.col("o_orderstatus").alias("status")).alias("o"))
    grouped = orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o")), one), "").alias("orders"))
    rows = _table(spark, sf_dir, "customer").join(grouped, F.col("c_custkey") == F.col("o_custkey"), "left")
    raw = _joined('<TEI><teiHeader><fileDesc><titleStmt><title>Customer ', "{c_custkey}", '</title></titleStmt></fileDesc></teiHeader><text><body xml:id="c', "{c_custkey}", '">', "{orders}", "</body></text></TEI>")
    return documents.dealt(rows.select(F.col("c_custkey").alias("doc_id"), raw.alias("raw")))


_ORDERS = """d AS (SELECT o_custkey AS c, o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS price, o_orderstatus AS s, floor(o_totalprice) > 100000 AS large FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))"""
_DEEP = f"""{_ORDERS}, p AS (
        SELECT c, k, 0 AS h, 'o' || k AS id, 'Order ' || k AS title FROM d
        UNION ALL SELECT c, k, h, 'o' || k || '-' || h, 'Part ' || h FROM d, (VALUES (1), (2)) v(h) WHERE large),
    q AS (SELECT *, row_number() OVER w AS page_no, lag(id) OVER w AS prev, lead(id) OVER w AS next FROM p WINDOW w AS (PARTITION BY c ORDER BY k, h))"""


@query(f"""WITH {_DEEP} SELECT CAST(c AS VARCHAR) AS doc_id, CAST(page_no AS INTEGER) AS page_no, 'chunk-' || lpad(CAST(page_no AS VARCHAR), 3, '0') AS page_id, id || '.html' AS file, id AS xml_id, prev, next, title FROM q""")
def page_split_divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divisions to depth 2: a division with parts gives its introduction and then the parts."""
    return documents.paged(_customers(spark, sf_dir), RuleSet.parse(CUSTOMER_RULES), pages.PageSettings("divisions", 2), columns=["title"]).select("doc_id", "page_no", "page_id", "file", "xml_id", "prev", "next", "title")


@query(f"""WITH {_DEEP}, f AS (SELECT c, min(id) FILTER (page_no = 1) AS first FROM q GROUP BY 1)
    SELECT CAST(q.c AS VARCHAR) AS doc_id, q.id || '.html' AS file, 'o' || q.k || '.html' AS here, '#c1' AS other FROM q WHERE h = 0""")
def page_split_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages: to the own page by its anchor, to what no page holds unchanged."""
    made = documents.paged(_customers(spark, sf_dir), RuleSet.parse(CUSTOMER_RULES), pages.PageSettings("divisions", 2, "{xml_id}.html"), columns=["output"])
    hrefs = F.regexp_extract_all("output", F.lit('href="([^"]*)"'), F.lit(1))
    here = F.when(hrefs[0] == F.concat(F.lit("#"), "xml_id"), F.col("file")).otherwise(hrefs[0])
    return made.where(F.size(hrefs) > 0).select("doc_id", "file", here.alias("here"), hrefs[1].alias("other"))


@query(f"""WITH {_ORDERS}, t AS (SELECT *, lead(k) OVER w AS after, count(*) OVER (PARTITION BY c) AS n, row_number() OVER w AS i FROM d WINDOW w AS (PARTITION BY c ORDER BY k))
    SELECT CAST(c AS VARCHAR) AS doc_id, CAST(i AS INTEGER) AS page_no, 'page-' || k AS xml_id,
        'Costs ' || s || ' ' || price || ' see here or first' || CASE WHEN large THEN ' Part 1 Half of ' || price || ' Part 2 Half of ' || price ELSE '' END || coalesce(' Order ' || after, '') AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY k) AS j FROM t) x""")
def page_split_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages from break to break, carved across divisions: no text is lost but what stands before the first break, none doubled."""
    rules = RuleSet.parse(CUSTOMER_RULES)
    made = documents.paged(_customers(spark, sf_dir), rules, pages.PageSettings("pages"), "plain", columns=["output"])
    text = F.trim(F.regexp_replace("output", r"\s+", " "))
    return made.select("doc_id", "page_no", "xml_id", text.alias("text"))


@query(f"""WITH {_ORDERS}, u AS (
        SELECT c, k, 0 AS h, 'Order ' || k AS heading, 'Order ' || k || ' Costs ' || price || ' see here or first' AS document, [s] AS status FROM d
        UNION ALL SELECT c, k, h, 'Part ' || h, 'Part ' || h || ' Half of ' || price, NULL FROM d, (VALUES (1), (2)) v(h) WHERE large)
    SELECT CAST(c AS VARCHAR) AS doc_id, c || '#o' || k || CASE WHEN h > 0 THEN '-' || h ELSE '' END AS id, heading, document, substr(sha1(document), 1, 16) AS hash, 'Customer ' || c AS title, array_to_string(status, '|') AS status FROM u WHERE length(document) >= 15""")
def unit_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by behaviour or heading, anchors, headings, titles, facets of the unit that holds them, short pieces dropped."""
    options = passages.Options(min_chars=15, fields=[passages.Field("status", elements=["name"], inline=False)])
    found = documents.indexed(_customers(spark, sf_dir), RuleSet.parse(CUSTOMER_RULES), options)
    return found.select("doc_id", "id", "heading", "document", "hash", "title", F.array_join(F.try_element_at("facets", F.lit("status")), "|").alias("status"))


@query(f"""WITH {_ORDERS}, u AS (
        SELECT c, k, 0 AS h, 'order' AS kind, 'Order ' || k || ' Costs ' || s || ' ' || price || ' see here or first' AS document, NULL AS parent FROM d
        UNION ALL SELECT c, k, h, 'part', 'Part ' || h || ' Half of ' || price, NULL FROM d, (VALUES (1), (2)) v(h) WHERE large
        UNION ALL SELECT c, k, 9, 'status', s, c || '#o' || k FROM d)
    SELECT CAST(c AS VARCHAR) AS doc_id, kind, document, parent, count(*) AS n FROM u GROUP BY ALL""")
def unit_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared units in place of the default ones, and records of their own with their parents' ids."""
    options = passages.Options(min_chars=1, fields=[passages.Field("status", elements=["name"], metadata=False, inline=True)], units=[passages.UnitKind("part", behaviours=["block"]), passages.UnitKind("order", behaviours=["section"])])
    found = documents.indexed(_customers(spark, sf_dir), RuleSet.parse(CUSTOMER_RULES), options)
    return found.groupBy("doc_id", "kind", "document", "parent").agg(F.count("*").alias("n"))


@query(f"""WITH {_DEEP} SELECT CAST(q.c AS VARCHAR) AS doc_id, id, 'Customer ' || q.c AS title, CASE WHEN h = 0 THEN (SELECT string_agg(s, '|') FROM d WHERE d.k = q.k) ELSE '' END AS own FROM q""")
def page_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments beside a page: one of the document, one of the page."""
    settings = pages.PageSettings("divisions", 2, fragments={"title": {"xpath": "//titleStmt/title", "channel": "plain"}, "own": {"xpath": "p/name", "scope": "page", "channel": "plain"}})
    made = documents.paged(_customers(spark, sf_dir), RuleSet.parse(CUSTOMER_RULES), settings, columns=["fragments"])
    return made.select("doc_id", F.col("xml_id").alias("id"), F.col("fragments")["title"].alias("title"), F.col("fragments")["own"].alias("own"))


REGISTER_RULES = """<schemaSpec ns=""><elementSpec ident="c">
  <model predicate="id(@key, doc('nations'))" ><param name="who" value="id(@key, doc('nations'))/name"/><template><b>[[content]]</b> of [[who]]</template></model>
  <model behaviour="inline"/></elementSpec></schemaSpec>"""


@query("""SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CASE WHEN n_nationkey % 5 <> 0 THEN '<b>' || c_custkey || '</b>' || chr(10) || ' of ' || chr(10) || n_name ELSE '<span class="tei-c tei-c2">' || c_custkey || '</span>' END AS output
    FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def rule_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A register of nations looked up by id in a predicate and in a template's parameter; a miss takes the next rule."""
    rows = _table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0").orderBy("n_nationkey").select("n_nationkey", "n_name").collect()  # a register of 20 entries
    register = "<list>" + "".join(f'<nation xml:id="n{r["n_nationkey"]}"><name>{r["n_name"]}</name></nation>' for r in rows) + "</list>"
    docs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), _joined('<c key="n', "{c_nationkey}", '">', "{c_custkey}", "</c>").alias("raw"))
    return documents.rendered(documents.dealt(docs), RuleSet.parse(REGISTER_RULES), "web", documents.Setup(registers={"nations": register})).select("doc_id", "output")


# ---------------------------------------------------------------- one document for each supplier: the other behaviours

SUPPLIER_RULES = """<schemaSpec ns="">
  <elementSpec ident="doc"><model behaviour="body"/></elementSpec>
  <elementSpec ident="fig"><model behaviour="figure"><param name="title" value="cap"/><param name="content" value="img"/></model></elementSpec>
  <elementSpec ident="img"><model behaviour="graphic"><param name="url" value="@src"/><param name="width" value="@w"/></model></elementSpec>
  <elementSpec ident="quote"><model behaviour="cit"><param name="source" value="@who"/></model></elementSpec>
  <elementSpec ident="tab"><model behaviour="table"/></elementSpec>
  <elementSpec ident="r"><model behaviour="row"/></elementSpec>
  <elementSpec ident="c"><model behaviour="cell"><param name="type" value="../@role"/></model></elementSpec>
  <elementSpec ident="brk"><model behaviour="break"><param name="type" value="'page'"/><param name="label" value="@n"/></model></elementSpec>
  <elementSpec ident="lb"><model behaviour="break"/></elementSpec>
  <elementSpec ident="cb"><model behaviour="break"><param name="type" value="'column'"/><param name="label" value="@n"/></model></elementSpec>
  <elementSpec ident="g"><model behaviour="glyph"><param name="content" value="@ref"/></model></elementSpec>
  <elementSpec ident="m"><model behaviour="match"/></elementSpec>
  <elementSpec ident="src"><model behaviour="code"><param name="language" value="@lang"/></model></elementSpec>
  <elementSpec ident="kbd"><model behaviour="code-inline"/></elementSpec>
  <elementSpec ident="part"><model behaviour="webcomponent"><param name="name" value="'my-part'"/><param name="size" value="@size"/></model></elementSpec>
  <elementSpec ident="pass"><model behaviour="pass-through"/></elementSpec>
  <elementSpec ident="t"><model behaviour="text"/></elementSpec>
  <elementSpec ident="b"><model behaviour="block" cssClass="own"/></elementSpec>
  <elementSpec ident="hid"><model behaviour="index"/></elementSpec>
  <elementSpec ident="gloss"><model behaviour="list"/></elementSpec>
  <elementSpec ident="label"><model behaviour="omit"/></elementSpec>
  <elementSpec ident="entry"><model behaviour="listItem"/></elementSpec>
  <elementSpec ident="side"><model behaviour="note"><param name="place" value="'margin'"/></model></elementSpec>
  <elementSpec ident="anchor"><model behaviour="note"><param name="place" value="'start'"/><param name="label" value="@n"/></model></elementSpec>
  <elementSpec ident="note"><model behaviour="note"><param name="label" value="@n"/></model></elementSpec>
</schemaSpec>"""


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _joined(
        '<doc xml:lang="he"><fig><img src="i', "{s_suppkey}", '.png" w="2cm"/><cap>Cap ', "{s_suppkey}", '</cap></fig><quote who="Ada">said</quote><tab><r role="head"><c>A</c><c cols="2">B</c></r><r><c>', "{s_suppkey}", '</c><c>2</c></r></tab><brk n="', "{s_suppkey}",
        '"/><lb/><cb n="2"/>en<g ref="char:EOLhyphen"/> \n  ', 'd<m>hit</m><src lang="xml">a  <i/></src><kbd>x</kbd><part size="', "{s_suppkey}", '">w</part><pass>in</pass><t>text</t><b rend="big">', "{s_name}", "</b><hid>no</hid><gloss><label>L</label><entry>E</entry></gloss>",
        '<side>aside</side><anchor xml:id="a1" n="a"/>word<note target="#a1" n="a">range</note></doc>',
    )
    return documents.dealt(_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), raw.alias("raw")))


def _supplier_output(spark: SparkSession, sf_dir: str, channel: str) -> DataFrame:
    return documents.rendered(_suppliers(spark, sf_dir), RuleSet.parse(SUPPLIER_RULES), channel).select("doc_id", "output")


@query("""SELECT CAST(k AS VARCHAR) AS doc_id, '<body class="tei-doc tei-doc1" lang="he" dir="rtl"><figure class="tei-fig tei-fig1"><img class="tei-img tei-img1" src="i' || k || '.png" style="width: 2cm"><figcaption>Cap ' || k || '</figcaption></figure><blockquote class="tei-quote tei-quote1">said<cite>Ada</cite></blockquote>' ||
    '<table class="tei-tab tei-tab1"><tr class="tei-r tei-r1"><th class="tei-c tei-c1">A</th><th class="tei-c tei-c1" colspan="2">B</th></tr><tr class="tei-r tei-r1"><td class="tei-c tei-c1">' || k || '</td><td class="tei-c tei-c1">2</td></tr></table><span class="tei-brk tei-brk1">' || k || '</span><br class="tei-lb tei-lb1"><div class="tei-cb tei-cb1" data-n="2"></div>en' || chr(173) ||
    'd<mark class="tei-m tei-m1">hit</mark><pre class="tei-src tei-src1"><code data-language="xml">a  &lt;i/&gt;</code></pre><code class="tei-kbd tei-kbd1">x</code><my-part class="tei-part tei-part1" size="' || k || '">w</my-part>intext<div class="tei-b tei-b1 big own">' || s_name || '</div><dl class="tei-gloss tei-gloss1"><dt class="tei-entry tei-entry1">L</dt><dd class="tei-entry tei-entry1">E</dd></dl>' ||
    '<span class="tei-side tei-side1 margin-note" id="margin_ref_1">aside</span><span class="tei-anchor tei-anchor1 note-range-start" style="display:inline-block" data-n="a" data-range="start"><a class="note" rel="footnote" href="#fn_2">a-</a></span>word' ||
    '<span id="fnref_2" style="display:inline-block" class="tei-note tei-note1" data-n="a" data-range="end"><a class="note" rel="footnote" href="#fn_2">-a</a></span><dl class="footnote" id="fn_2" data-n="a" data-range="end"><dt class="fn-number">a-a</dt><dd class="fn-content">range<a class="fn-back" href="#fnref_2">↩</a></dd></dl></body>' AS output
    FROM (SELECT s_suppkey AS k, s_name FROM supplier)""")
def xml_behaviours_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures, citations, tables, breaks, glyphs, matches, code, components, definition lists, margin notes, lemma ranges."""
    return _supplier_output(spark, sf_dir, "web")


@query("""SELECT CAST(k AS VARCHAR) AS doc_id, '![](i' || k || '.png)' || n || n || 'Cap ' || k || n || n || '> said' || n || '> — Ada' || n || n || '| A | B |' || n || '| --- | --- |' || n || '| ' || k || ' | 2 |' || n || n || '|' || k || '|  ' || n || '  ' || n || 'en' || chr(173) || 'dhit' || n || n || '```xml' || n || 'a  <i/>' || n || '```' || n || n || '`x`wintext' || s_name AS output
    FROM (SELECT s_suppkey AS k, s_name, chr(10) AS n FROM supplier)""")
def xml_behaviours_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in Markdown, up to the block (lists and notes are in ``xml_markdown``)."""
    out = _supplier_output(spark, sf_dir, "markdown")
    return out.select("doc_id", F.regexp_extract("output", r"(?s)^(.*?Supplier#\d+)", 1).alias("output"))


@query("""SELECT CAST(k AS VARCHAR) AS doc_id, '#figure([#image("i' || k || '.png", width: 2cm)], caption: [Cap ' || k || '])' || n || n || '#quote(block: true, attribution: [Ada])[said]' || n || n || '#table(columns: 2,' || n || '  [A], [B],' || n || '  [' || k || '], [2],' || n || ')' AS output FROM (SELECT s_suppkey AS k, chr(10) AS n FROM supplier)""")
def xml_behaviours_typst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figure, citation and table in Typst."""
    out = _supplier_output(spark, sf_dir, "typst")
    return out.select("doc_id", F.regexp_extract("output", r"(?s)^(.*?,\n\))", 1).alias("output"))


@query("""SELECT CAST(k AS VARCHAR) AS doc_id, '<span class="tei-brk tei-brk1" epub:type="pagebreak">' || k || '</span><br class="tei-lb tei-lb1"><div class="tei-cb tei-cb1" data-n="2"></div>' AS breaks, '<span class="tei-part tei-part1 my-part">w</span>' AS part, '<aside class="tei-note tei-note1 footnote" id="fn_2" epub:type="footnote">a-a range</aside>' AS note FROM (SELECT s_suppkey AS k FROM supplier)""")
def xml_behaviours_epub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page breaks, components and notes of electronic books."""
    out = _supplier_output(spark, sf_dir, "epub")
    take = lambda p: F.regexp_extract("output", p, 1)
    return out.select("doc_id", take(r'(<span class="tei-brk.*?<div class="tei-cb[^>]*></div>)').alias("breaks"), take(r'(<span class="tei-part.*?</span>)').alias("part"), take("(<aside.*?</aside>)").alias("note"))
