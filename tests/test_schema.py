"""Schemas, styles, and sites written to files."""

from xml.etree import ElementTree

import pytest

from quillspark.operators import documents, registers, sites, specs
from quillspark.plans import schema
from quillspark.plans.rules import RuleSet
from quillspark.tree import library, nodes, pages

BASE = """<x><moduleSpec ident="core"/>
<classSpec ident="att.a" module="core"><attList><attDef ident="n" usage="req"><desc>number</desc><valList><valItem ident="1"/><valItem ident="2"/></valList></attDef><attDef ident="type"/></attList></classSpec>
<classSpec ident="att.b" module="core"><classes><memberOf key="att.a"/></classes><attList><attDef ident="type"/></attList></classSpec>
<classSpec ident="model.p" module="core"/><classSpec ident="model.empty" module="core"><classes><memberOf key="model.loop"/></classes></classSpec><classSpec ident="model.loop" module="core"><classes><memberOf key="model.empty"/></classes></classSpec>
<macroSpec ident="macro.text" module="core"><content><alternate minOccurs="0" maxOccurs="unbounded"><textNode/><classRef key="model.p"/></alternate></content></macroSpec>
<elementSpec ident="doc" module="core"><content><elementRef key="p" minOccurs="2" maxOccurs="4"/></content></elementSpec>
<elementSpec ident="p" module="core"><desc>old</desc><classes><memberOf key="model.p"/><memberOf key="att.b"/></classes><content><macroRef key="macro.text"/></content><attList><attDef ident="own"/></attList><model behaviour="paragraph"/></elementSpec>
<elementSpec ident="gone" module="core" mode="delete"/><egXML><elementSpec ident="example"/></egXML><elementSpec ident="p"><desc>a copy without module</desc></elementSpec></x>"""


@pytest.fixture
def base():
    return schema.collect([nodes.read(BASE)])


def spec(xml):
    return nodes.top(nodes.read(xml))


def test_collect(base):
    assert ("element", "gone") not in base and ("element", "example") not in base and schema.part(base["element", "p"], "desc").string() == "old" and ("module", "core") in base


def test_graph(base):
    s = schema.Schema(base)
    assert s.may_contain("p") == [("text", "character data"), ("element", "p")] and s.contained_by("p") == ["doc"] and s.elements_of("model.p") == ["p"] and s.elements_of("model.loop") == []
    assert s.ancestors(("element", "p")) == ["model.p", "att.b", "att.a"] and ("element", "doc") in s.used_by(("element", "p"))
    assert s.attributes(("element", "p")) == [("own", "p"), ("type", "att.b"), ("n", "att.a")]
    tree = s.attribute_tree(("element", "p"))
    assert tree[1]["ident"] == "att.b" and [r["overridden"] for r in tree[1]["inside"][1]["inside"]] == [False, True]
    assert s.by_letter("class") == {"A": ["att.a"], "B": ["att.b"], "E": ["model.empty"], "L": ["model.loop"], "P": ["model.p"]}
    assert s.owners() == {"n": ["att.a"], "own": ["p"], "type": ["att.a", "att.b"]} and list(s.by_module(s.may_contain("p"))) == ["core", "character data"]


def test_changes(base):
    local = spec('<elementSpec ident="p" mode="change"><desc>new</desc><classes mode="change"><memberOf key="att.b" mode="delete"/><memberOf key="att.a"/></classes><attList><attDef ident="own" mode="delete"/><attDef ident="n" mode="change"><desc>changed</desc></attDef></attList></elementSpec>')
    made = schema.overlaid(base, [local])
    p = made["element", "p"]
    assert schema.part(p, "desc").string() == "new" and schema.memberships(p) == ["model.p", "att.a"] and schema.part(p, "model") is not None
    s = schema.Schema(made)
    assert s.attributes(("element", "p")) == [("n", "p"), ("type", "att.a")]
    done = next(d for d in s.own_attributes(s.completed(("element", "p"))) if d.get("ident") == "n")
    assert done.get("usage") == "req" and schema.part(done, "desc").string() == "changed" and schema.part(done, "valList") is not None
    assert s.inherited(("element", "p"), "type").get("ident") == "type"
    replaced = schema.overlaid(base, [spec('<elementSpec ident="p" mode="replace"><desc>r</desc></elementSpec>'), spec('<elementSpec ident="doc" mode="delete"/>'), spec('<elementSpec ident="q" mode="add"/>')])
    assert len(replaced["element", "p"].elements()) == 1 and ("element", "doc") not in replaced and ("element", "q") in replaced
    models = schema.changed(base["element", "p"], spec('<elementSpec ident="p"><model behaviour="block"/></elementSpec>'))
    assert [m.get("behaviour") for m in schema.parts(models, "model")] == ["block"]


def test_resolve_close_and_prune(base):
    local = spec('<schemaSpec><elementRef key="p"/></schemaSpec>')
    assert set(schema.resolved(local, base)) == {("element", "p"), ("class", "model.p"), ("class", "att.b"), ("class", "att.a"), ("macro", "macro.text")}
    assert set(schema.selected(spec('<schemaSpec><moduleRef key="core" include=""/></schemaSpec>'), base)) == {k for k in base if k[0] not in ("element", "module")}
    whole = schema.resolved(spec('<schemaSpec><moduleRef key="core" except="doc"/></schemaSpec>'), base)
    assert ("class", "model.loop") not in whole and ("element", "doc") not in whole and ("element", "p") in whole
    assert schema.compiled([spec('<schemaSpec ns=""><elementSpec ident="z"/></schemaSpec>')], base).keys() == {("element", "z")}
    assert ("element", "p") in schema.compiled([spec('<schemaSpec><elementSpec ident="z"/></schemaSpec>')], base)


def test_grammar(base):
    grammar = schema.relax_ng(base)
    root = ElementTree.fromstring(grammar)
    names = [d.get("name") for d in root if d.tag.endswith("define")]
    assert names == ["doc", "macro.text", "model.p", "p"] and "model.loop" not in grammar
    assert '<element name="doc"><ref name="p"/><ref name="p"/><optional><ref name="p"/></optional><optional><ref name="p"/></optional></element>' in grammar
    assert '<attribute name="n"><choice><value>1</value><value>2</value></choice></attribute>' in grammar and '<zeroOrMore><choice><text/><ref name="model.p"/></choice></zeroOrMore>' in grammar
    assert schema.occurring("<a/>", 2, None) == "<a/><a/><zeroOrMore><a/></zeroOrMore>" and schema.occurring("<a/>", 0, 1000).count("<a/>") == schema.UNROLL


def test_documents_of_a_schema(base):
    document = nodes.read('<TEI><div xml:id="d"><head>H</head><p>prose</p></div><schemaSpec><elementSpec ident="p"><desc>local</desc></elementSpec><elementSpec ident="doc"/></schemaSpec><graphic url="a.png"/><graphic url="http://x/b.png"/><egXML><graphic url="c.png"/></egXML></TEI>')
    only = {k: s for k, s in base.items() if k != ("element", "doc")}
    made = schema.into_prose(document, only)
    idents = [n.get("ident") for n in made.walk() if n.tag == "elementSpec"]
    assert idents == ["p"] and schema.figures(document) == ["a.png"]
    grown = schema.Schema(base).expanded(nodes.read(BASE))
    assert any(n.tag == "contained-by" and [c.get("key") for c in n.elements()] == ["doc"] for n in grown.walk())
    rows = schema.documented(document, base)
    page = next(r for r in rows if r["file"] == "element.p.html")
    assert page["links"] == ["element.p.html"] and rows[0]["title"] == "H" and {r["run"] for r in rows} == {0, 1, 2}


def test_load_folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.xml").write_text(BASE)
    (tmp_path / "sub" / "b.odd").write_text('<x><elementSpec ident="more"/></x>')
    assert {("element", "p"), ("element", "more")} < set(schema.load_folder(str(tmp_path)))


def test_styles():
    rules = RuleSet.parse('<schemaSpec ns=""><elementSpec ident="a"><model behaviour="inline"><outputRendition>font-weight: bold; color: #ff0000; font-size: 16px</outputRendition><outputRendition scope="before">content: "x"</outputRendition></model></elementSpec></schemaSpec>')
    sheet = rules.stylesheet('<TEI><tagsDecl><rendition xml:id="r">color:  red</rendition></tagsDecl></TEI>', "body {}")
    assert sheet.split("\n") == ["body {}", ".simple_r { color: red }", ".tei-a1 { font-weight: bold; color: #ff0000; font-size: 16px }", '.tei-a1:before { content: "x" }']
    assert rules.typst_prelude() == '#let tei-a1(body) = [x] + text(size: 12pt, text(fill: rgb("#ff0000"), strong(body)))'
    assert rules.fingerprint("web") == rules.fingerprint("web") != rules.fingerprint("print")


def test_library():
    tree = nodes.read('<TEI xmlns="http://www.tei-c.org/ns/1.0"><div><div/><div><pb/><p/></div></div></TEI>')
    inner = [n for n in tree.walk() if n.tag == "div"][2]
    assert library.outline_number(inner) == "1.2" and library.page_number(next(n for n in tree.walk() if n.tag == "p")) == 2 and library.apparatus_letter(10) == "k"
    assert library.slug("Äpfel & Birnen") == "apfel-birnen" and library.slug("1 a") == "s-1-a" and library.tighten("a , b .") == "a, b." and library.humanise("my_doc-x") == "My doc x"
    used = set()
    assert [library.unique("a", used) for _ in range(3)] == ["a", "a-2", "a-3"] and library.highlight("x < y", "nope") in ("x < y", "x &lt; y")
    assert nodes.pretty(spec("<a><b>x</b><c/></a>")) == "<a>\n  <b>x</b>\n  <c/>\n</a>" and nodes.dedent("a\n    b\n      c") == "a\nb\n  c"


def test_site_files(spark, tmp_path):
    (tmp_path / "in" / "images").mkdir(parents=True)
    (tmp_path / "in" / "d.xml").write_text('<doc><div xml:id="one"><img src="p.png"/><img src="no.png"/></div></doc>')
    (tmp_path / "in" / "images" / "p.png").write_bytes(b"png")
    rules = RuleSet.parse('<schemaSpec ns=""><elementSpec ident="div"><model behaviour="section"/></elementSpec><elementSpec ident="img"><model behaviour="graphic"><param name="url" value="@src"/></model></elementSpec></schemaSpec>')
    from quillspark.sources.markup import read_corpus

    docs = read_corpus(spark, str(tmp_path / "in"))
    found = documents.paged(docs, rules, pages.PageSettings("//div"))
    out = str(tmp_path / "out")
    assert sites.write_pages(found, out) == 4
    (tmp_path / "out" / "bad").mkdir()
    (tmp_path / "out" / "bad" / "manifest.json").write_text("{")
    again = sites.read_manifests(spark, out).collect()
    assert [(r.doc_id, r.pages[0].file, r.anchors) for r in again] == [("d", "one.html", {"one": "one.html"})]
    pics = sites.pictures(found, docs, str(tmp_path / "in")).collect()
    assert [(r.path, bytes(r.content)) for r in pics] == [("d/p.png", b"png")]
    assert '<a href="d/one.html">' in sites.index_page(sites.collection_index(sites.manifest(found))).first().content
    assert sites.search_names(found).first().content == '{"one":["d/one.html"]}'
    with pytest.raises(Exception, match="outside"):
        sites.write_files(spark.createDataFrame([("../x", "y")], "path string, content string"), out)


def test_registers_and_specs(spark):
    refs = spark.createDataFrame([(1, " b a  b "), (2, None), (3, "none")], "ref_no int, ref string")
    register = spark.createDataFrame([("u", 1, "a", "A"), ("u", 2, "b", "B"), ("u", 3, "b", "later")], "uri string, node_id int, xml_id string, value string")
    from pyspark.sql import functions as F

    got = [(r.ref_no, r.found_no, r.value) for r in registers.by_id(refs, register, F.lit("u")).orderBy("ref_no", "found_no").collect()]
    assert got == [(1, 1, "A"), (1, 2, "B")]
    rows = spark.createDataFrame([("a", "m"), ("b", "m"), ("c", "k")], "ident string, module string")
    take = spark.createDataFrame([("m", ["a"], None), ("k", [], None)], "module string, include array<string>, except_ array<string>")
    assert [r.ident for r in specs.select_modules(rows, take).collect()] == ["a"]
    local = spark.createDataFrame([("a", "z", "replace"), ("b", None, "delete"), ("n", "y", "add")], "ident string, module string, mode string")
    assert sorted((r.ident, r.module) for r in specs.overlay(rows, local).collect()) == [("a", "z"), ("c", "k"), ("n", "y")]


def test_populated_classes_that_nothing_names_go():
    text = """<x><classSpec ident="model.a"/><classSpec ident="model.b"/><classSpec ident="model.c"><classes><memberOf key="model.b"/></classes></classSpec><classSpec ident="model.none"/>
    <classSpec ident="att.x"><classes><memberOf key="att.y"/></classes></classSpec><classSpec ident="att.y"/><classSpec ident="att.z"/><classSpec ident="att.named"/>
    <elementSpec ident="p"><classes><memberOf key="model.a"/><memberOf key="att.x"/></classes><attList><attRef class="att.named"/></attList></elementSpec>
    <elementSpec ident="q"><classes><memberOf key="model.c"/></classes><content><classRef key="model.b"/><classRef key="model.none"/></content></elementSpec></x>"""
    kept = schema.pruned(schema.collect([nodes.read(text)]))
    assert {i for k, i in kept if k == "class"} == {"model.b", "model.c", "att.x", "att.y", "att.named"} and ("element", "p") in kept
