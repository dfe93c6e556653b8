import os

import pytest

from quillspark.engine import Config, Engine
from quillspark.operators import records, render
from quillspark.plans.expressions import compile_test
from quillspark.plans.rules import RuleSet
from quillspark.tree.pages import PageSettings
from quillspark.tree.passages import Field, Options

DATA = "/root/testdata/sf0.001"
RULES = """<schemaSpec ns="">
<elementSpec ident="doc"><model behaviour="document"/></elementSpec>
<elementSpec ident="div"><model behaviour="section"/></elementSpec>
<elementSpec ident="head"><model behaviour="heading"/></elementSpec>
<elementSpec ident="p"><model predicate="@rend = 'quote'" behaviour="cit"/><model behaviour="paragraph"/><model behaviour="block"/></elementSpec>
<elementSpec ident="note"><model behaviour="note"><param name="label" value="@n"/></model></elementSpec>
<elementSpec ident="meta"><model behaviour="omit"/></elementSpec>
<elementSpec ident="hi"><modelGrp predicate="@rend"><model predicate="contains(@rend, 'b')" behaviour="inline"/></modelGrp><model predicate="unknown-function(.)" behaviour="block"/></elementSpec>
</schemaSpec>"""
DOC = """<doc><meta>hidden <p>deep</p></meta><div id="s1"><head>Title one</head><p>Some text of a length that is kept in the index.<note n="a">first</note></p>
<p rend="quote">Quoted words, also long enough to be kept there.<note>second</note></p></div><div id="s2"><head>Two</head><p>More <hi rend="bold">bold</hi> text that is long enough to be kept.</p><odd/></div></doc>"""


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, RuleSet.parse(RULES), Config(pages=PageSettings("//div", 1, "{xml_id}.html"), options=Options(fields=[Field("notes", elements=["note"], inline=True)])))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("d", DOC)], "doc_id string, raw string")


def columns(engine, docs):
    """The same records by expressions compiled to Columns."""
    nodes = engine.nodes(docs)
    return nodes, records.dispatch(nodes, engine.rules.channel("json"))


def test_first_match_and_unmatched(engine, docs):
    want = {("p", "cit", "tei-p1"), ("p", "paragraph", "tei-p2"), ("hi", "inline", "tei-hi1"), ("odd", None, None)}
    assert want < {(r.element, r.behaviour, r.model) for r in engine.records(docs).collect()}
    assert want < {(r.tag, r.behaviour, r.rule_key) for r in columns(engine, docs)[1].collect()}


def test_suppression_prunes(engine, docs):
    found = columns(engine, docs)[1]
    kept = records.pruned(found)
    assert kept.where("tag = 'meta'").count() == 1 and kept.where("xpath like '%meta%p%'").count() == 0
    assert engine.records(docs).where("xpath like '%meta%p%'").count() == 0


def test_render(engine, docs):
    html = engine.render(docs).first().output
    assert "hidden" not in html and html.index("<h1") < html.index("Title one") < html.index("</h1>") and html.count("<section") == html.count("</section>") == 2
    assert "# Title one" in engine.render(docs, "markdown").first().output
    nodes, found = columns(engine, docs)
    by_tokens = render.render(nodes, found, "html").first().output
    assert "hidden" not in by_tokens and by_tokens.index("<h1") < by_tokens.index("Title one") < by_tokens.index("</h1>")
    assert engine.page(docs, "<x>$content</x>$doc").first().page.endswith("</x>d")


def test_notes(engine, docs):
    got = [(r.marker, r.body) for r in records.labelled_first(records.notes(columns(engine, docs)[1])).orderBy("note_order").collect()]
    assert got == [("a", "first"), ("1", "second")]
    placed = records.by_place(records.notes(columns(engine, docs)[1]))
    assert [r.note_order for r in placed.orderBy("node_id").collect()] == [1, 2]


def test_passages(engine, docs):
    rows = engine.passages(docs).collect()
    assert len({r.id for r in rows}) == len(rows) and all("hidden" not in r.document for r in rows)
    assert {r.heading for r in rows} == {"Title one", "Two"} and rows[0].facets == {"notes": ["first", "second"]} and rows[1].facets == {} and rows[0].href == "s1.html#s1"


def test_pages_and_site(engine, docs, tmp_path):
    got = [(r.file, r.prev, r.next, r.title) for r in engine.pages(docs).orderBy("page_no").collect()]
    assert got == [("s1.html", None, "s2", "Title one"), ("s2.html", "s1", None, "Two")]
    assert [(r.doc_id, r.title, r.href, r.n_pages) for r in engine.site(docs, str(tmp_path / "site")).collect()] == [("d", "Title one", "d/s1.html", 2)]
    names = sorted(str(p.relative_to(tmp_path / "site")) for p in (tmp_path / "site").rglob("*") if p.is_file())
    assert names == ["d/manifest.json", "d/parts/s1.json", "d/parts/s2.json", "d/s1.html", "d/s2.html", "index.json"]


def test_coverage(engine, docs):
    report = engine.coverage(docs)
    assert [r.key for r in report["unmatched"].collect()] == ["odd"]
    assert {r.rule_key for r in report["unreachable"].collect()} == {"tei-p3", "tei-hi2"}
    assert report["summary"].first().suppressed == 1 and report["unused_specs"].count() == 0
    nodes, found = columns(engine, docs)
    assert records.dropped(nodes, found.where("behaviour is not null")).count() == 1


def test_strict(engine, docs):
    with pytest.raises(ValueError, match="tei-hi2"):
        engine.records(docs, strict=True)
    assert [r.where for r in engine.errors(docs).collect()] == ["tei-hi2"]


def test_cycle_is_an_error():
    with pytest.raises(ValueError, match="cycle"):
        RuleSet.parse('<schemaSpec source="a"/>', "a", lambda s: '<schemaSpec source="a"/>')


def test_epub(engine, docs):
    data = engine.epub(docs).first().epub
    assert data[30:38] == b"mimetype"


@pytest.mark.parametrize(("expression", "want"), [
    ("@a = 'x'", True), ("@b", False), ("not(@b)", True), ("count(child::p) > 1", True), ("parent::div", True), ("ancestor::doc and @a", True), ("string-length(.) = 5", True),
    ("'' ", True), ("count(child::none)", True), ("starts-with(., 'he') or false()", True), ("substring-after(., 'l') = 'lo'", True), ("no-such(.)", False), ("@a = ('x', 'y')", False), ("preceding-sibling::q", False),
])
def test_expressions(spark, expression, want):
    row = spark.createDataFrame([("p", {"a": "x"}, ["doc", "div"], ["p", "p"], [], [], "hello")], "tag string, attrs map<string,string>, anc_tags array<string>, child_tags array<string>, before_tags array<string>, after_tags array<string>, string_value string")
    assert row.select(compile_test(expression)[0].alias("t")).first().t is want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_unused_rules_meet_fired_ones_once(spark):
    """Rows that a rule won are not brought together by its key: each task hands on the key alone."""
    from quillspark.plans import catalogue

    found = catalogue.queries()["rule_unused"](spark, DATA)
    assert sorted(r.rule_key for r in found.collect()) == ["tei-A1", "tei-A2"]
    assert "Aggregate [rule_key" in found._jdf.queryExecution().optimizedPlan().toString()
