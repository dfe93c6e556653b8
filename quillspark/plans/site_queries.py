"""Queries over registers, notes, sites made of pages, schemas and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import documents, registers, sites
from quillspark.plans import schema
from quillspark.plans.catalogue import query
from quillspark.plans.document_queries import _DEEP, CUSTOMER_RULES, _customers
from quillspark.plans.rules import RuleSet, css_classes
from quillspark.sources.markup import shred
from quillspark.tree import nodes, pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- registers

@query("""WITH g AS (SELECT 'people' AS uri, 'c' || c_custkey AS xml_id, c_custkey AS node_id, c_name AS name FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT 'people', 'c' || c_custkey, c_custkey + 1000000, 'again' FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'places', 'n' || n_nationkey, n_nationkey, n_name FROM nation),
    h AS (SELECT uri, xml_id, min(node_id) AS node_id, arg_min(name, node_id) AS name FROM g GROUP BY 1, 2),
    w AS (SELECT DISTINCT o_orderkey AS ref_no, id FROM (SELECT o_orderkey, unnest(['c' || o_custkey, 'n' || o_custkey % 30, 'c' || o_custkey, 'none']) AS id FROM orders) x)
    SELECT ref_no, CAST(row_number() OVER (PARTITION BY ref_no ORDER BY uri, node_id) AS INTEGER) AS found_no, uri, name FROM w JOIN h ON h.xml_id = w.id""")
def register_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids between spaces looked up in a collection of two registers; the first holder of an id wins, a repeat counts once."""
    c, n = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation")
    id_ = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    people = F.lit("people").alias("uri")
    register = c.where("c_custkey % 5 <> 0").select(people, id_("c", "c_custkey").alias("xml_id"), F.col("c_custkey").alias("node_id"), F.col("c_name").alias("name"))
    register = register.unionByName(c.where("c_custkey % 2 = 0").select(people, id_("c", "c_custkey").alias("xml_id"), (F.col("c_custkey") + 1000000).alias("node_id"), F.lit("again").alias("name")))
    register = register.unionByName(n.select(F.lit("places").alias("uri"), id_("n", "n_nationkey").alias("xml_id"), F.col("n_nationkey").cast("long").alias("node_id"), F.col("n_name").alias("name")))
    customer = id_("c", "o_custkey")
    refs = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref_no"), F.concat_ws(" ", customer, F.concat(F.lit(" n"), (F.col("o_custkey") % 30).cast("string")), customer, F.lit("none ")).alias("ref"))
    both = spark.createDataFrame([("all", "people"), ("all", "places")], "uri string, member string")
    return registers.by_id(refs, register, F.lit("all"), both).select("ref_no", "found_no", "uri", "name")


@query("""SELECT o_orderkey, coalesce(n_name, 'self:' || o_orderkey) AS found FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 5 <> 0 LEFT JOIN nation ON c_nationkey = n_nationkey""")
def register_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders look their customer's nation up in a register without every fifth customer; a miss gives the order itself."""
    known = _table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    register = known.select(F.lit("c").alias("uri"), F.col("c_custkey").alias("node_id"), F.col("c_custkey").cast("string").alias("xml_id"), F.col("n_name").alias("found"))
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref_no"), F.col("o_custkey").cast("string").alias("ref"))
    met = registers.by_id(orders, register, F.lit("c"))
    out = registers.or_self(orders, met, "ref_no", "found", F.concat(F.lit("self:"), F.col("ref_no").cast("string")))
    return out.select(F.col("ref_no").alias("o_orderkey"), "found")


@query("""WITH n AS (SELECT l_suppkey AS doc_id, 'p' || l_partkey AS anchor, min(l_orderkey * 100 + l_linenumber) AS note_id FROM lineitem GROUP BY 1, 2), a AS (SELECT DISTINCT s_suppkey AS doc_id, 'p' || (s_suppkey % 50) AS anchor FROM supplier)
    SELECT a.doc_id, a.anchor, note_id FROM a LEFT JOIN n ON a.doc_id = n.doc_id AND a.anchor = n.anchor""")
def note_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors with the first note that points to them."""
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("anchor"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("note_id"))
    anchors = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.concat(F.lit("p"), (F.col("s_suppkey") % 50).cast("string")).alias("anchor")).distinct()
    return registers.pointing_note(anchors, lines)


@query(f"""WITH {_DEEP} SELECT CAST(c AS VARCHAR) AS doc_id, 'o' || k AS target, count(*) AS n FROM q WHERE h = 0 GROUP BY 1, 2 UNION ALL SELECT '1', 'c1', count(*) FROM d WHERE c = 1 HAVING count(*) > 0""")
def idref_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of shredded documents that point to another element of theirs."""
    found = shred(_customers(spark, sf_dir), columns=["doc_id", "node_id", "kind", "attrs", "xml_id"])
    met = registers.targets(found)
    return met.groupBy("doc_id", F.col("xml_id").alias("target")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT p_brand AS letter, p_size AS line, p_partkey FROM part), s AS (SELECT 'Brand#' || (10 + s_suppkey % 40) AS letter, CAST(s_suppkey % 50 AS INTEGER) AS line, min(s_name) AS region FROM supplier GROUP BY 1, 2)
    SELECT p_partkey, region FROM l LEFT JOIN s ON l.letter = s.letter AND l.line = s.line""")
def picture_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "supplier").groupBy(F.concat(F.lit("Brand#"), (10 + F.col("s_suppkey") % 40).cast("string")).alias("letter"), (F.col("s_suppkey") % 50).cast("int").alias("line")).agg(F.min("s_name").alias("region"))
    lines = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("letter"), F.col("p_size").alias("line"), "p_partkey")
    return registers.regions(lines, s).select("p_partkey", "region")


# ---------------------------------------------------------------- sites

def _pages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    settings = pages.PageSettings("divisions", 2, fragments={"own": {"xpath": "p/name", "scope": "page", "channel": "plain"}})
    return documents.paged(_customers(spark, sf_dir), RuleSet.parse(CUSTOMER_RULES), settings, columns=list(columns))


@query(f"""WITH {_DEEP} SELECT CAST(c AS VARCHAR) AS doc_id, arg_min(title, page_no) AS title, c || '/' || arg_min(id, page_no) || '.html' AS href, CAST(count(*) AS INTEGER) AS n_pages FROM q GROUP BY c""")
def site_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection's index, from the manifests of documents."""
    return sites.collection_index(sites.manifest(_pages(spark, sf_dir, "title")))


@query(f"""WITH {_DEEP} SELECT CAST(c AS VARCHAR) AS doc_id, id AS anchor, id || '.html' AS file FROM q""")
def site_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of ids, from the manifests."""
    return sites.manifest(_pages(spark, sf_dir, "anchors")).select("doc_id", F.explode("anchors").alias("anchor", "file"))


@query(f"""WITH {_DEEP} SELECT CAST(c AS VARCHAR) AS doc_id, 'id=' || id || '&view=page' AS key, id || '.json' AS file FROM q UNION ALL SELECT CAST(c AS VARCHAR), 'id=' || id || '&part=own', id || '-own.json' FROM q""")
def site_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of pages with their keys."""
    return sites.parts(_pages(spark, sf_dir, "output", "fragments")).select("doc_id", "key", "file")


@query("""WITH r AS (SELECT 0 AS run, o_custkey AS doc_id, 'a' || o_orderkey % 4 AS anchor, 'f' || min(o_orderkey) AS file FROM orders WHERE o_orderstatus = 'F' GROUP BY 2, 3 UNION ALL SELECT 1, o_custkey, 'a' || o_orderkey % 4, 'f' || min(o_orderkey) FROM orders WHERE o_orderstatus <> 'F' GROUP BY 2, 3)
    SELECT doc_id, anchor, arg_max(file, run) AS anchor_file, arg_min(file, run) AS fragment_file FROM r GROUP BY 1, 2""")
def site_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of two runs merged: anchors by the later run, fragments by the first."""
    orders = _table(spark, sf_dir, "orders")
    run = lambda c: orders.where(c).groupBy(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("a"), (F.col("o_orderkey") % 4).cast("string")).alias("anchor")).agg(F.concat(F.lit("f"), F.min("o_orderkey").cast("string")).alias("file"))
    runs = [run("o_orderstatus = 'F'"), run("o_orderstatus <> 'F'")]
    late, early = (sites.merged(runs, ["doc_id", "anchor"], k).withColumnRenamed("file", n) for k, n in (("last", "anchor_file"), ("first", "fragment_file")))
    return late.join(early, ["doc_id", "anchor"])


@query("""WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS place, count(*) OVER (PARTITION BY conv_id, role) AS n FROM conversations)
    SELECT u.conv_id AS doc_id, CAST(u.place AS INTEGER) AS place, u.turn AS fragment, a.turn AS page FROM t u JOIN t a ON u.conv_id = a.conv_id AND u.place = a.place AND u.n = a.n WHERE u.role = 'user' AND a.role = 'assistant'""")
def site_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments and pages joined by place where they are equally many: a conversation's questions and answers."""
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role")
    return sites.zipped(turns.where("role = 'user'").select("doc_id", F.col("turn").alias("fragment_no")), turns.where("role = 'assistant'").select("doc_id", F.col("turn").alias("page_no")))


@query("""WITH r AS (SELECT l_orderkey AS doc_id, 'p' || l_partkey % 7 AS xml_id, 'p' || l_suppkey % 5 AS entry, 'own' || l_linenumber || '.html' AS file FROM lineitem), a AS (SELECT DISTINCT l_orderkey AS doc_id, 'p' || l_linenumber AS anchor, 'x' || l_linenumber || '.html' AS file FROM lineitem)
    SELECT r.doc_id, r.xml_id, r.entry, coalesce(b.file || '#' || r.xml_id, e.file || '#' || r.entry, r.file) AS href, count(*) AS n FROM r LEFT JOIN a b ON b.doc_id = r.doc_id AND b.anchor = r.xml_id LEFT JOIN a e ON e.doc_id = r.doc_id AND e.anchor = r.entry GROUP BY 1, 2, 3, 4""")
def index_hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index records and the pages they link to: by their id, by the id they were entered by, else their own page."""
    lines = _table(spark, sf_dir, "lineitem")
    mark = lambda c, n: F.concat(F.lit("p"), (F.col(c) % n).cast("string"))
    number = F.col("l_linenumber").cast("string")
    records = lines.select(F.col("l_orderkey").alias("doc_id"), mark("l_partkey", 7).alias("xml_id"), mark("l_suppkey", 5).alias("entry"), F.concat(F.lit("own"), number, F.lit(".html")).alias("file"))
    anchors = lines.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("p"), number).alias("anchor"), F.concat(F.lit("x"), number, F.lit(".html")).alias("file"))
    n = documents.spread(lines)
    return sites.page_links(records, anchors.repartition(n, "doc_id", "anchor").distinct(), n).groupBy("doc_id", "xml_id", "entry", "href").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- schemas

def _schema(spark: SparkSession, sf_dir: str) -> tuple[dict, nodes.Node]:
    """A schema over the nations: elements that belong to a region's class and hold another region's, attributes by class."""
    rows = sorted((r["n_nationkey"], r["n_name"], r["n_regionkey"]) for r in _table(spark, sf_dir, "nation").collect())  # 25 rows
    specs = [f'<classSpec ident="model.r{k}" type="model" module="core"/><classSpec ident="att.r{k}" module="core">{f"<classes><memberOf key={chr(34)}att.r0{chr(34)}/></classes>" if k else ""}<attList><attDef ident="a{k}"/><attDef ident="shared"/></attList></classSpec>' for k in range(6)]
    specs += ['<macroSpec ident="macro.mixed" module="core"><content><alternate><textNode/><classRef key="model.r0"/></alternate></content></macroSpec>']
    for k, name, region in rows:
        content = '<macroRef key="macro.mixed"/>' if k % 7 == 0 else f'<sequence><classRef key="model.r{(region + 1) % 5}" minOccurs="0" maxOccurs="unbounded"/></sequence>'
        specs.append(f'<elementSpec ident="{name.lower()}" module="m{k % 3}"><desc>Nation {k}</desc><classes><memberOf key="model.r{region}"/><memberOf key="att.r{region}"/></classes><content>{content}</content><attList><attDef ident="own{k % 4}"/></attList></elementSpec>')
    base = schema.collect([nodes.read(f"<x>{''.join(specs)}</x>")])
    local = nodes.read('<schemaSpec ident="s"><moduleRef key="core"/><moduleRef key="m0"/><moduleRef key="m1" include="nation_1 nation_4"/><moduleRef key="m2" except="nation_2 nation_5"/><elementSpec ident="nation_3" mode="delete"/><elementSpec ident="nation_6" mode="change"><attList><attDef ident="own2" mode="delete"/></attList></elementSpec><elementSpec ident="extra" mode="add"><content><textNode/></content></elementSpec></schemaSpec>')
    return base, local


_NATIONS = """n AS (SELECT n_nationkey AS k, lower(n_name) AS name, n_regionkey AS r FROM nation)"""


@query(f"""WITH {_NATIONS} SELECT a.name AS ident, 'element' AS kind, b.name AS child FROM n a JOIN n b ON b.r = CASE WHEN a.k % 7 = 0 THEN 0 ELSE (a.r + 1) % 5 END UNION ALL SELECT name, 'text', 'character data' FROM n WHERE k % 7 = 0""")
def schema_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What elements may contain: classes expanded, macros followed, text as character data."""
    return schema.Schema(_schema(spark, sf_dir)[0]).tables(spark)["contains"]


@query(f"""WITH {_NATIONS} SELECT name AS ident, 'own' || k % 4 AS attribute, name AS source FROM n UNION ALL SELECT name, 'a' || r, 'att.r' || r FROM n UNION ALL SELECT name, 'shared', 'att.r' || r FROM n UNION ALL SELECT name, 'a0', 'att.r0' FROM n WHERE r <> 0
    UNION ALL SELECT 'att.r' || i, 'a' || i, 'att.r' || i FROM range(6) t(i) UNION ALL SELECT 'att.r' || i, 'shared', 'att.r' || i FROM range(6) t(i) UNION ALL SELECT 'att.r' || i, 'a0', 'att.r0' FROM range(1, 6) t(i)""")
def schema_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes that hold for specifications: own ones, then those of the classes above, the nearest wins."""
    return schema.Schema(_schema(spark, sf_dir)[0]).tables(spark)["attributes"]


@query(f"""WITH {_NATIONS}, s AS (SELECT name, r, k FROM n WHERE k <> 3 AND (k % 3 = 0 OR (k % 3 = 1 AND k IN (1, 4)) OR (k % 3 = 2 AND k NOT IN (2, 5))))
    SELECT 'element' AS kind, name AS ident FROM s UNION ALL SELECT 'element', 'extra' UNION ALL SELECT 'macro', 'macro.mixed' UNION ALL SELECT 'class', 'model.r' || r FROM (SELECT DISTINCT r FROM s) UNION ALL SELECT DISTINCT 'class', 'att.r' || r FROM (SELECT r FROM s UNION SELECT 0 FROM s WHERE r > 0)""")
def schema_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema worked out: modules with include and except, local additions, changes and deletions, closure, pruning."""
    base, local = _schema(spark, sf_dir)
    return spark.createDataFrame(list(schema.resolved(local, base)), "kind string, ident string")


@query(f"""WITH {_NATIONS}, d AS (SELECT name, 'own' || k % 4 AS a FROM n UNION ALL SELECT 'att.r' || i, 'a' || i FROM range(6) t(i) UNION ALL SELECT 'att.r' || i, 'shared' FROM range(6) t(i)) SELECT a AS attribute, string_agg(name, ' ' ORDER BY lower(name), name) AS owners FROM d GROUP BY 1""")
def schema_attribute_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = schema.Schema(_schema(spark, sf_dir)[0]).owners()
    return spark.createDataFrame([(a, " ".join(o)) for a, o in found.items()], "attribute string, owners string")


@query(f"""WITH {_NATIONS}, s AS (SELECT 'element' AS kind, name AS ident, 'm' || k % 3 AS module, upper(substr(name, 1, 1)) AS letter FROM n UNION ALL SELECT 'class', 'model.r' || i, 'core', 'R' FROM range(6) t(i) UNION ALL SELECT 'class', 'att.r' || i, 'core', 'R' FROM range(6) t(i) UNION ALL SELECT 'macro', 'macro.mixed', 'core', 'M')
    SELECT * FROM s""")
def schema_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifications with the letters they stand under, class prefixes ignored."""
    return schema.Schema(_schema(spark, sf_dir)[0]).tables(spark)["specs"]


@query(f"""WITH {_NATIONS}, u AS (SELECT 'macro.mixed' AS ident, 'element' AS kind, name AS user FROM n WHERE k % 7 = 0 UNION SELECT 'model.r' || r, 'element', name FROM n UNION SELECT 'att.r' || r, 'element', name FROM n UNION SELECT 'model.r' || (r + 1) % 5, 'element', name FROM n WHERE k % 7 <> 0
    UNION SELECT 'model.r0', 'macro', 'macro.mixed' UNION SELECT 'att.r0', 'class', 'att.r' || i FROM range(1, 6) t(i)) SELECT * FROM u""")
def schema_used_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.Schema(_schema(spark, sf_dir)[0]).tables(spark)["used"]


@query(f"""WITH {_NATIONS}, c AS (SELECT r, '<choice>' || string_agg('<ref name="' || name || '"/>', '' ORDER BY name) || '</choice>' AS body FROM n GROUP BY 1)
    SELECT name AS ident, '<element name="' || name || '"><optional><attribute name="own' || k % 4 || '"><text/></attribute></optional><optional><attribute name="a' || r || '"><text/></attribute></optional><optional><attribute name="shared"><text/></attribute></optional>' ||
        CASE WHEN r <> 0 THEN '<optional><attribute name="a0"><text/></attribute></optional>' ELSE '' END || CASE WHEN k % 7 = 0 THEN '<ref name="macro.mixed"/>' ELSE '<zeroOrMore><ref name="model.r' || (r + 1) % 5 || '"/></zeroOrMore>' END || '</element>' AS definition FROM n
    UNION ALL SELECT 'model.r' || r, body FROM c UNION ALL SELECT 'macro.mixed', '<choice><text/><ref name="model.r0"/></choice>'""")
def schema_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The definitions of a RELAX NG grammar that its start elements reach."""
    base = _schema(spark, sf_dir)[0]
    grammar = schema.relax_ng(base, sorted(i for k, i in base if k == "element"))
    rows = [tuple(d.split('">', 1)) for d in (p.split("</define>", 1)[0] for p in grammar.split('<define name="')[1:])]
    return spark.createDataFrame(rows, "ident string, definition string")


@query(f"""WITH {_NATIONS} SELECT 1 AS run, 'element.' || a.name || '.html' AS file, a.name AS title, 'Nation ' || a.k AS text, CAST(count(b.name) AS INTEGER) AS n_links FROM n a LEFT JOIN n b ON b.r = CASE WHEN a.k % 7 = 0 THEN 0 ELSE (a.r + 1) % 5 END GROUP BY a.name, a.k
    UNION ALL SELECT 0, 'intro.html', 'Intro', 'Intro text', 0 UNION ALL SELECT 2, 'elements.html', 'Elements', (SELECT 'N: ' || string_agg(name, ', ' ORDER BY name) FROM n), (SELECT CAST(count(*) AS INTEGER) FROM n)""")
def schema_documentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a documentation: prose, elements, the catalogue of elements; links between them."""
    base = _schema(spark, sf_dir)[0]
    document = nodes.read('<TEI><text><body><div xml:id="intro"><head>Intro</head><p> text</p></div></body></text></TEI>')
    rows = [(p["run"], p["file"], p["title"], p["text"], len(p["links"])) for p in schema.documented(document, {k: s for k, s in base.items()}) if p["kind"] in ("prose", "element") or p["file"] == "elements.html"]
    return spark.createDataFrame(rows, "run int, file string, title string, text string, n_links int")


# ---------------------------------------------------------------- scalar functions

@query(r"""SELECT p_partkey, p_name AS stripped, replace(replace(k, '-', '_'), '.', '_') AS note_id, k || '-' AS opens, '-' || k AS closes, k || '-' || k AS ranges, 'a-b-c' AS stem, upper(substr(replace(h, '_', ' '), 1, 1)) || substr(replace(replace(h, '_', ' '), '-', ' '), 2) AS title,
    p_name || ', end.' AS tight, p_name AS plain, 'part-' || replace(p_name, ' ', '-') AS slug, 'id-' || p_partkey || '-x' AS safe_id, 'a ' || p_name || ' of {unknown}' AS filled, 'a=' || p_name || '&b=2' AS part_key, upper(substr(p_name, 1, 1)) AS letter, substr('abcdefghiklmnopqrstuvwxyz', CAST(p_partkey % 25 AS INTEGER) + 1, 1) AS mark,
    substr(sha1(p_name), 1, 16) AS hash, CASE WHEN p_partkey % 2 = 0 THEN 'd#i' || p_partkey ELSE 'd#' || substr(sha1('s|/p[' || p_partkey || ']'), 1, 12) END AS id, '\#' || p_partkey || ' \*' || p_name || '\*' AS typst, 'soft' || chr(173) || p_name AS joined,
    'tei-p tei-p1 bold x own' AS classes, 'a' || chr(10) || chr(10) || 'b ' || p_name AS finished, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS first, 'a b ' || p_name AS normal
    FROM (SELECT *, 'n-' || p_partkey || '.1' AS k, 'my_part-' || p_partkey AS h FROM part)""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar functions, over parts' names and keys."""
    key = F.col("p_partkey").cast("string")
    k, name = F.concat(F.lit("n-"), key, F.lit(".1")), F.col("p_name")
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    even = F.col("p_partkey") % 2 == 0
    return _table(spark, sf_dir, "part").select(
        "p_partkey", text.strip(c("  ", name, "\t ")).alias("stripped"), text.note_id(k).alias("note_id"), text.lemma_markers(k, "open").alias("opens"), text.lemma_markers(k, "close").alias("closes"), text.lemma_markers(k, "range").alias("ranges"),
        text.file_stem(F.lit("a/b\\c")).alias("stem"), text.humanise(c("my_part-", key)).alias("title"), text.tighten_punctuation(c(name, " , end .")).alias("tight"), text.strip_markup(c("<b>", name, "<!-- x > y --></b>")).alias("plain"), text.slug(c("Pärt: ", name, "!")).alias("slug"),
        text.safe_id(c(key, " x")).alias("safe_id"), text.placeholders(F.lit("a {name} of {unknown}"), {"name": name}).alias("filled"), text.parameter_key(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), name)).alias("part_key"), text.sort_letter(c("att.", name)).alias("letter"), text.apparatus_letter(F.col("p_partkey") + 1).alias("mark"),
        text.content_hash(name).alias("hash"), text.stable_id(F.lit("d"), F.when(even, c("i", key)), F.lit("s"), c("/p[", key, "]")).alias("id"), text.typst_escape(c("#", key, " *", name, "*")).alias("typst"), text.join_soft_hyphens(c("soft­ \n", name)).alias("joined"),
        css_classes(F.lit("p"), F.lit("tei-p1"), F.lit("bold  x"), F.lit("own")).alias("classes"), text.markdown_finish(c("a\n\n\n\nb ", name)).alias("finished"), text.first_text(F.when(even, F.array(c(" ", name))).otherwise(F.array().cast("array<string>"))).alias("first"), text.normalise_markup(c("a\n   b \t", name)).alias("normal"),
    )


@query("""SELECT n_name, 'soft' || chr(173) || n_name AS seam, 'x ' || n_name AS apart FROM nation""")
def text_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = text.join_seam(F.lit("soft­"), F.concat(F.lit(" \n"), "n_name"))
    return _table(spark, sf_dir, "nation").select("n_name", joined.alias("seam"), text.join_seam(F.lit("x"), F.concat(F.lit(" "), "n_name")).alias("apart"))
