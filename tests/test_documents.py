"""Pages, passages and packages of documents."""

import io
import zipfile
from xml.etree import ElementTree

import pytest

from quillspark.operators import documents
from quillspark.plans.rules import RuleSet
from quillspark.tree import nodes, packages, pages, passages, xpath
from quillspark.tree.process import Process

RULES = RuleSet.parse("""<schemaSpec ns=""><elementSpec ident="doc"><model behaviour="document"/></elementSpec><elementSpec ident="div"><model behaviour="section"/></elementSpec><elementSpec ident="head"><model behaviour="heading"/></elementSpec>
<elementSpec ident="p"><model behaviour="paragraph"/></elementSpec><elementSpec ident="note"><model behaviour="note"/></elementSpec><elementSpec ident="hi"><model behaviour="inline"/></elementSpec><elementSpec ident="name"><model behaviour="inline"/></elementSpec>
<elementSpec ident="img"><model behaviour="graphic"><param name="url" value="@src"/></model></elementSpec><elementSpec ident="ref"><model behaviour="link"><param name="uri" value="@target"/></model></elementSpec>
<elementSpec ident="table"><model behaviour="table"/></elementSpec><elementSpec ident="row"><model behaviour="row"/></elementSpec><elementSpec ident="cell"><model behaviour="cell"/></elementSpec></schemaSpec>""")


def ids(found):
    return [n.id for n in found]


def test_divisions_and_introductions():
    tree = nodes.read('<TEI><text><body><div xml:id="a"><head>A</head><div xml:id="b"><p>b</p></div></div><div xml:id="c"><pb/><div xml:id="d"><p>d</p></div></div><div xml:id="e"><p>e</p></div></body></text><div xml:id="out"/></TEI>')
    env = xpath.Env()
    assert ids(pages.select(tree, pages.PageSettings("divisions", 1), env)) == ["a", "c", "e"]
    deep = pages.select(tree, pages.PageSettings("divisions", 2), env)
    assert ids(deep) == ["a", "b", "d", "e"] and deep[0].string() == "A" and deep[0].source.id == "a" and deep[1].node_id == next(n.node_id for n in tree.walk() if n.id == "b")
    assert ids(pages.select(tree, pages.PageSettings("//div[p]"), env)) == ["b", "d", "e"]
    assert ids(pages.select(tree, pages.PageSettings(lambda t, s: [n for n in t.walk() if n.id == "d"]), env)) == ["d"]


def test_docbook_and_jats():
    book = nodes.read('<book xmlns="http://docbook.org/ns/docbook"><section xml:id="a"><title>t</title><section xml:id="b"><para/></section></section></book>')
    assert ids(pages.select(book, pages.PageSettings("docbook", 2), xpath.Env())) == ["a", "b"]
    article = nodes.read('<article><front xml:id="f"/><body><sec xml:id="s"><p/></sec></body><back/></article>')
    assert [n.tag for n in pages.select(article, pages.PageSettings("jats"), xpath.Env())] == ["front", "sec"]


def test_pages_lose_and_double_nothing():
    tree = nodes.read('<TEI><text><body><div><pb n="1"/><p>one <hi>two<pb xml:id="p2"/>three</hi> four</p></div><div><p>five<pb n="1"/>six</p></div>tail</body></text></TEI>')
    found = pages.select(tree, pages.PageSettings("pages"), xpath.Env())
    assert ids(found) == ["page-1", "p2", "page-1-2"] and [n.string() for n in found] == ["one two", "three fourfive", "six"]
    single = nodes.read('<TEI><text><body><p>a<pb/>b</p><p>c</p></body></text></TEI>')
    assert [n.string() for n in pages.select(single, pages.PageSettings("pages"), xpath.Env())] == ["bc"]


def test_file_names_and_links():
    page = nodes.top(nodes.read('<div xml:id="x"/>'))
    assert pages.file_name("{xml_id}.html", page, 1, "d") == "x.html" and pages.file_name("all.html", page, 2, "d") == "all.html" and pages.file_name("{xml_id}.html", nodes.top(nodes.read("<div/>")), 3, "d") == "003.html" and pages.file_name("{stem}-{index}.xml", page, 4, "d") == "d-4.xml"
    held = {"a": "one.html", "two": "two.html", "b c": "one.html"}
    assert pages.rewritten("#a", "one.html", held) == "#a" and pages.rewritten("#a", "x.html", held) == "one.html#a" and pages.rewritten("#two", "x.html", held) == "two.html" and pages.rewritten("#zz", "x", held) == "#zz" and pages.rewritten("http://a", "x", held) == "http://a"
    assert pages.rewritten("#b%20c", "x", held) == "one.html#b c" and pages.rewritten("doc.xml?id=a", "x", held, r"doc\.xml\?id=(\w+)") == "one.html#a"
    link = nodes.Node("e", "pb-link", attrs={"xml-id": "a", "class": "k"})
    assert pages.rewrite([link], "x.html", held)[0].attrs == {"class": "k", "href": "one.html#a"} and link.tag == "a"
    assert pages.anchors([page], ["x.html"], {"x": "old.html", "y": "old.html"}) == {"x": "x.html", "y": "old.html"}


def records(xml):
    return Process(RULES, "json").transform([nodes.read(xml)])


def test_split_counts_a_character_for_each_part():
    unit = passages.Unit(None, "/p", None, None, parts=[("a" * n, None, f"/p[{n}]") for n in (100, 1399, 200)])
    assert [len(t) for t, _, _ in passages.split(unit, 1500, 0)] == [100, 1399, 200]
    unit.parts = [("a" * n, None, None) for n in (100, 1398, 200)]
    assert [len(t) for t, _, _ in passages.split(unit, 1500, 0)] == [1499, 200]
    assert [len(t) for t, _, _ in passages.split(unit, 1500, 1)] == [1499, 1599]


def test_units_fields_and_children():
    found = records('<doc><p xml:id="i">before</p><div xml:id="d"><head>Head</head><p>text <name>Ada</name><note>aside words</note></p><div><p>inner <name>Bob</name></p></div></div></doc>')
    options = passages.Options(min_chars=1, fields=[passages.Field("who", elements=["name"], inline=False), passages.Field("notes", behaviours=["note"], metadata=False)])
    rows = passages.rows("s", found, options)
    assert [(r["id"], r["document"], r["heading"], dict(r["facets"])) for r in rows if not r["kind"]][1:2] == [("s#d", "Head text", "Head", {"who": ["Ada"]})]
    child = next(r for r in rows if r["kind"] == "notes")
    assert child["parent"] == "s#d" and child["document"] == "aside words" and rows[-1] is child
    assert len({r["id"] for r in rows}) == len(rows)


def test_a_unit_without_emit_sets_the_heading():
    found = records("<doc><head>One</head><p>a</p><p>b</p><head>Two</head><p>c</p></doc>")
    options = passages.Options(min_chars=1, units=[passages.UnitKind("h", behaviours=["heading"], emit=False), passages.UnitKind("p", behaviours=["paragraph"])])
    assert [(r["document"], r["heading"], r["kind"]) for r in passages.rows("s", found, options)] == [("a", "One", "p"), ("b", "One", "p"), ("c", "Two", "p")]


def test_repeated_ids_and_short_pieces():
    found = records('<doc><div xml:id="x"><p>first words</p></div><div xml:id="x"><p>other words</p></div><div><p>no</p></div></doc>')
    assert [r["id"] for r in passages.rows("s", found, passages.Options(min_chars=5))] == ["s#x", "s#x~1"]


DOC = '<doc xml:lang="de"><fileDesc><titleStmt><title>Book</title><author>A. Writer</author></titleStmt></fileDesc><div xml:id="one"><head>First</head><p>a<note>n1</note> <ref target="#two">go</ref> <ref target="http://x.org">out</ref> <hi rend="b">b</hi></p><img src="pic.png"/></div><div xml:id="two"><head>Second</head><p>z</p><table><row><cell>1</cell></row></table></div></doc>'


def test_book():
    process = Process(RULES, "epub")
    found = pages.select(nodes.read(DOC), pages.PageSettings("//div"), process.env)
    chapters = [(p.id, packages.chapter_title(x := process.pieces([p]), p), x) for p in found]
    data = packages.epub("d", "Book", "A. Writer", "de", chapters)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED and {"OEBPS/toc.ncx", "OEBPS/nav.xhtml", "OEBPS/one.xhtml", "OEBPS/two.xhtml"} <= set(z.namelist())
        for n in z.namelist()[1:]:
            if not n.endswith(".css"):
                ElementTree.fromstring(z.read(n))
        one = z.read("OEBPS/one.xhtml").decode()
        assert 'href="two.xhtml#two"' in one and "<img" not in one and one.index("n1") > one.index("go") and "First" in z.read("OEBPS/nav.xhtml").decode()
    assert packages.epub("d", "Book", "A. Writer", "de", [(p.id, packages.chapter_title(x := process.pieces([p]), p), x) for p in pages.select(nodes.read(DOC), pages.PageSettings("//div"), process.env)]) == data
    assert packages.chapter_title([], nodes.top(nodes.read('<div><pb n="7"/><p>x</p></div>'))) == "Page 7" and packages.chapter_title([], nodes.top(nodes.read("<div/>"))) == "Untitled"
    assert packages.media_type("a.JPG") == "image/jpeg" and packages.safe_id("1 x", set()) == "id-1-x"


def test_word_file():
    data = packages.docx(Process(RULES, "docx").pieces([nodes.read(DOC)]), {"tei-p": "BodyText"})
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for n in z.namelist():
            ElementTree.fromstring(z.read(n))
        body, notes = z.read("word/document.xml").decode(), z.read("word/footnotes.xml").decode()
    assert 'w:val="Heading1"' in body and 'w:val="BodyText"' in body and "<w:tbl>" in body and "footnoteReference" in body and "n1" in notes and "n1" not in body and 'r:id="link1"' in body


def test_spark_operators(spark):
    docs = spark.createDataFrame([("a", DOC), ("b", "<doc><p>broken"), ("c", None)], "doc_id string, raw string")
    out = {r.doc_id: r for r in documents.rendered(docs, RULES).collect()}
    assert out["b"].error and "broken" in out["b"].output and out["c"].output == ""
    assert documents.books(docs, RULES).count() == 2 and documents.word_files(docs, RULES).count() == 3
    assert '"models"' in documents.record_trees(docs, RULES).first().output
    assert {r.name for r in documents.named(docs.where("doc_id = 'a'"), "//title").collect()} == {"Book"}
    with pytest.raises(ValueError, match="empty or not its own"):
        documents.named(docs, "//title")
    made = documents.indexed(docs, RULES, passages.Options(min_chars=1), pages.PageSettings("//div")).where("doc_id = 'a'").collect()
    assert [r.href for r in made] == ["one.html#one", "two.html#two"] and made[0].title == "Book"
    report = documents.totals(documents.facts(docs, RULES))
    assert [r.key for r in documents.ranked(report, "unmatched").collect()][0] in ("author", "fileDesc", "title", "titleStmt")


def test_fragment_and_images():
    assert packages.fragment(["a ", nodes.Node("e", "b")]) == "<div>a <b></b></div>" and packages.fragment([nodes.Node("e", "p")]) == "<p></p>"
    pics = [nodes.Node("e", "img", attrs={"src": s}) for s in ("a.png", "http://x/b.png", "../c.png", "/d.png", "a.png")]
    assert packages.images(pics) == ["a.png"]


def test_pages_are_read_once_and_made_by_columns(spark):
    """Parts, manifests and targets of pointers take their input, which is parsed where it is read, only once."""
    from quillspark.operators import documents, registers, sites
    from quillspark.plans.rules import RuleSet
    from quillspark.sources.markup import shred
    from quillspark.tree import pages

    raw = "<TEI><text><body>" + "".join(f'<div xml:id="d{k}"><head>H{k}</head><p xml:id="x">t <name>n{k}</name></p><ref target="#d0">r</ref></div>' for k in range(3)) + "</body></text></TEI>"
    docs = spark.createDataFrame([("a", raw), ("b", "<TEI><text><body/></text></TEI>")], "doc_id string, raw string")
    rules = RuleSet.parse('<schemaSpec ns=""><elementSpec ident="div"><model behaviour="section"/></elementSpec><elementSpec ident="head"><model behaviour="heading"/></elementSpec></schemaSpec>')
    settings = pages.PageSettings("divisions", 1, fragments={"own": {"xpath": "p/name", "scope": "page", "channel": "plain"}})
    whole = documents.paged(docs, rules, settings)
    once = lambda df: df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    parts, manifest, met = sites.parts(whole), sites.manifest(whole), registers.targets(shred(docs))
    assert once(parts) and once(manifest) and once(met)
    assert sorted((r.key, r.file) for r in parts.collect())[:2] == [("id=d0&part=own", "d0-own.json"), ("id=d0&view=page", "d0.json")]
    assert {r.content for r in parts.where("key like '%part=own'").collect()} == {f'{{"content":"n{k}"}}' for k in range(3)}
    (row,) = manifest.collect()
    assert row.anchors == {"d0": "d0.html", "d1": "d1.html", "d2": "d2.html", "x": "d0.html"} and [p.title for p in row.pages] == ["H0", "H1", "H2"]
    assert sorted(r.node_id > r.target_id for r in met.collect()) == [True] * 3
    full = {r.xml_id: r for r in whole.collect()}
    for columns in (["title"], ["output"], ["fragments"], ["anchors", "images"], []):
        for r in documents.paged(docs, rules, settings, columns=columns).collect():
            for c in ("title", "output", "fragments", "anchors", "images"):
                assert r[c] == (full[r.xml_id][c] if c in columns else None)
            assert (r.file, r.prev, r.next, r.xpath) == (full[r.xml_id].file, full[r.xml_id].prev, full[r.xml_id].next, full[r.xml_id].xpath)


@pytest.mark.parametrize("name", ["rule_template", "xml_behaviours_html"])
def test_documents_from_narrow_tables_are_dealt_out(spark, name, tmp_path):
    from quillspark.plans import catalogue

    for k in ("customer", "supplier", "nation"):
        spark.range(40).selectExpr("id AS c_custkey", "id % 20 AS c_nationkey", "id AS s_suppkey", "concat('Supplier#', id) AS s_name", "id AS n_nationkey", "concat('N', id) AS n_name").coalesce(1).write.parquet(str(tmp_path / f"{k}.parquet"))
    found = catalogue.queries()[name](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() > 1 and found.count() == 40


def test_units_are_not_compared_with_those_taken_out(monkeypatch):
    """Whether a unit was taken out is known by its place, not by comparing it with all that were."""
    def never(self, other):
        raise AssertionError

    monkeypatch.setattr(passages.Unit, "__eq__", never)
    records = [{"behaviour": "section", "element": "div", "id": f"d{k}", "children": [{"behaviour": "inline", "element": "name", "children": ["N"]}, "long enough"]} for k in range(3)]
    options = passages.Options(min_chars=5, fields=[passages.Field("who", elements=["name"], metadata=False, inline=False)])
    assert [(r["document"], r["kind"]) for r in passages.rows("d", records, options)] == [("long enough", None)] * 3 + [("N", "who")] * 3
