"""Pages by division: equal to those of whole documents."""

import random

import pytest

from quillspark.operators import documents
from quillspark.plans.document_queries import CUSTOMER_RULES
from quillspark.plans.rules import RuleSet
from quillspark.tree import nodes, pages, segments


class Caught(Exception):
    pass


def maker(monkeypatch, rules, settings, columns=None, channel="web"):
    def caught(docs, rows_of, schema, **names):
        raise Caught(rows_of)

    monkeypatch.setattr(documents, "mapped", caught)
    with pytest.raises(Caught) as found:
        documents.paged(None, RuleSet.parse(rules), settings, channel, columns=columns)
    return found.value.args[0]()


def document(rng, n):
    def division(k):
        inner = "".join(f'<div type="line" xml:id="o{k}-{h}"><head>Part {h}</head><p>Half {k}</p></div>' for h in range(rng.randrange(3)))
        return f'<div xml:id="o{k}"><head>Order {k}</head><pb n="{k}"/><p>Costs <name>{rng.choice("FOP")}</name> {k}.5 <ref target="#o{rng.randrange(12)}">here</ref> <ref target="#o{k}-1">100%</ref> <ref target="#c{n}">x</ref></p>{inner}</div>'
    return f'<TEI><teiHeader><title>No {n}</title></teiHeader><text><body xml:id="c{n}">{"".join(division(k) for k in rng.sample(range(12), rng.randrange(6)))}</body></text></TEI>'


@pytest.mark.parametrize("depth", [1, 2, 3])
@pytest.mark.parametrize(("channel", "pattern", "columns"), [("web", "{xml_id}.html", ["title", "output", "fragments", "anchors"]), ("markdown", "{stem}-{index}.md", ["output"]), ("epub", "{ident}.xhtml", []), ("web", "{xml_id}/x.html", ["output"])])
def test_pages_by_division_are_those_of_the_document(monkeypatch, depth, channel, pattern, columns):
    settings = pages.PageSettings("divisions", depth, pattern, fragments={"own": {"xpath": "p/name", "scope": "page", "channel": "plain"}})
    make, rng = maker(monkeypatch, CUSTOMER_RULES, settings, columns, channel), random.Random(depth)
    docs = [document(rng, n) for n in range(120)]
    for n, raw in enumerate(docs):
        assert make(str(n), raw) == make.whole(str(n), nodes.read(raw))
    seen = []
    monkeypatch.setattr(make, "whole", lambda key, tree: seen.append(key))
    for n, raw in enumerate(docs):
        make(str(n), raw)
    assert make.on and len(seen) < len(docs) // 2  # before, each document was parsed and rendered; those without divisions still are


@pytest.mark.parametrize("raw", ["", None, "<TEI/>", "<TEI><text><body><div>1</div>x<div>2</div></body></text></TEI>", "<TEI><text><body><div>1<div/></body></text></TEI>", "<TEI><text><body><!-- <div> --><div>1</div></body></text></TEI>", '<TEI><text><body><div n="<div>">1</div></body></text></TEI>', "<TEI><text><body><div/><div>3</div><div a='>'><div>&#52;</div></div></body></text></TEI>", "<TEI><text><div>5</div><body><div xml:id='a b'><p>1</p><ref target='#a b'>2</ref></div></body></text></TEI>", "</div><div>1</div>", '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div xml:id="a7"><ref target="#a7">7</ref></div><div xml:id="a7">8</div></body></text></TEI>'])
def test_odd_documents(monkeypatch, raw):
    make = maker(monkeypatch, CUSTOMER_RULES, pages.PageSettings("divisions", 2), ["title", "output", "anchors"])
    for _ in range(3):
        assert make("d", raw) == make.whole("d", nodes.read(raw))


@pytest.mark.parametrize("source", ["../@n", "ancestor::div", "following-sibling::p", "//p", "/TEI", "count(//p)", "@n > 5", "position()", "id('a')", "p/..", "p[../@n]", "concat(/TEI, 'a')"])
def test_expressions_that_look_out_of_their_element(monkeypatch, source):
    assert not segments.own(source)
    rules = f'<schemaSpec ns=""><elementSpec ident="p"><model predicate="{source.replace(">", "&gt;")}" behaviour="block"/></elementSpec></schemaSpec>'
    assert not maker(monkeypatch, rules, pages.PageSettings("divisions", 2)).on


def test_expressions_that_stay_inside():
    assert all(map(segments.own, ["@type = 'line'", "p/name", "p//name[1]/@n", "*/p", "count(p)", "concat(@n, '/..')", "."]))
