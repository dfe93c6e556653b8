"""Rendering by shapes: documents that differ in their numbers alone are rendered once, and exactly as one by one."""

import itertools

import pytest
from test_process import DOC

from quillspark.plans.document_queries import ORDER_RULES
from quillspark.plans.rules import RuleSet
from quillspark.tree import nodes
from quillspark.tree.process import Process
from quillspark.tree.shapes import Shapes, blind, blind_rules

CHANNELS = ["web", "print", "markdown", "typst", "plain", "epub", "docx"]


def order(n, *lines, status="O", note="open"):
    items = "".join(f'<item n="{k}"><ref target="#p{p}">part {p}</ref> <q unit="{u}">{q}</q></item>' for k, (p, u, q) in enumerate(lines, n))
    return f'<order xml:id="o{n}"><meta>{n}.5</meta><head>Order <hi rend="bold">{n}</hi></head><p>Status {status}<note n="{n}">{note} 100%</note><choice><orig>{n}e3</orig><reg>a  {n}</reg></choice></p><list type="ordered">{items}</list></order>'


def rendering(rules, channel):
    process, calls = Process(RuleSet.parse(rules), channel), []

    def render(raw):
        calls.append(raw)
        tree = nodes.read(raw)
        return {"output": process.transform([tree]), "error": nodes.error_of(tree), "metadata": list(process.run.metadata)}

    return Shapes(process, render), render, calls


@pytest.mark.parametrize("channel", CHANNELS)
def test_equal_to_one_by_one(channel):
    shapes, render, calls = rendering(ORDER_RULES, channel)
    lines = list(itertools.product((1, 20, 300), "RAN", (0, 7, 50)))
    docs = [order(n, *lines[n % 27 : n % 27 + n % 4], status="FOP"[n % 3]) for n in range(1200)]
    assert [shapes(d) for d in docs] == [render(d) for d in docs]
    assert len(calls) - len(docs) < len(docs) // 2  # most documents were not rendered; before, all were


@pytest.mark.parametrize("raw", [
    "<order><p>{}&#38;{}</p></order>", "<order><p><!-- {} -->{}</p></order>", '<order xmlns:a="u{}"><p>{}</p></order>', "<h{}><p>{}</p></h{}>", "<order><p {}>x</p></order>", '<order a{}="1" a{}="2"/>', '<order><hi rend="r{} r{}">x</hi></order>', "<order>{}<", "{}", "", '<order xml:lang="ar-{}"/>', "<order>{}</order>", '<order xmlns="u{}"><p>{}</p></order>', "<?xml version='1.{}'?><order>{}</order>", "<order><![CDATA[{}]]></order>",
])
def test_odd_documents(raw):
    shapes, render, _ = rendering(ORDER_RULES, "web")
    docs = [raw.replace("{}", "{0}").format(n) for n in (1, 2, 1, 38, 1, 0)] + [raw.replace("{}", "{0}", 1).replace("{}", "{1}").format(n, n + 1) for n in (1, 2, 3)]
    assert [shapes(d) for d in docs] == [render(d) for d in docs]


@pytest.mark.parametrize("predicate", ["@n = '7'", "@n > 5", "number(.) mod 2 = 0", "string-length(.) > 1", "@n = .", "id(.)", "position() = 2", ". + 1"])
def test_rules_that_look_into_numbers(predicate):
    rules = f'<schemaSpec ns=""><elementSpec ident="p"><model predicate="{predicate.replace(">", "&gt;")}" behaviour="block"/><model behaviour="inline"/></elementSpec></schemaSpec>'
    shapes, render, _ = rendering(rules, "web")
    docs = [f'<p n="{n}">{m}</p>' for n in range(12) for m in (7, n)]
    assert blind(predicate) is None and not blind_rules(Process(RuleSet.parse(rules))) and [shapes(d) for d in docs] == [render(d) for d in docs]


def test_behaviours_that_look_into_numbers():
    for model in ('behaviour="heading"><param name="level" value="@n"/>', 'behaviour="graphic"><param name="width" value="@n"/>', 'behaviour="code">', 'behaviour="unknown">'):
        rules = f'<schemaSpec ns=""><elementSpec ident="p"><model {model}</model></elementSpec></schemaSpec>'
        shapes, render, _ = rendering(rules, "typst")
        docs = [f'<p n="{n}">{n}px</p>' for n in range(9)]
        assert not shapes.on and [shapes(d) for d in docs] == [render(d) for d in docs]


def test_ranges_of_notes_find_their_ends():
    rules = '<schemaSpec ns=""><elementSpec ident="note"><model behaviour="note"><param name="label" value="@n"/></model></elementSpec></schemaSpec>'
    shapes, render, _ = rendering(rules, "web")
    docs = [f'<d><anchor xml:id="a{k}"/><note n="{n}" target="#a{m}">x</note></d>' for n in range(3) for k in range(3) for m in range(3)]
    assert shapes.on and [shapes(d) for d in docs] == [render(d) for d in docs]


def test_documents_of_their_own_are_left_alone(monkeypatch):
    monkeypatch.setattr("quillspark.tree.shapes.TRIAL", 20)
    shapes, render, _ = rendering(ORDER_RULES, "web")
    docs = [DOC.replace("Text", "x" * k) for k in range(40)]
    assert [shapes(d) for d in docs] == [render(d) for d in docs] and not shapes.on and not shapes.known


def test_rows_of_a_known_shape_are_those_of_each_document():
    from quillspark.plans.document_queries import _EXPRESSIONS
    from quillspark.tree import xpath
    from quillspark.tree.shapes import Filled, free

    assert blind("//item[last()]/@n") and blind("string-join(//ref/@target, ' ')") and not blind("//item[last()]/@n > 1") and not blind("sum(//q)")
    lines = list(itertools.product((1, 20, 300), "RAN", (0, 7, 50)))
    docs = [order(n, *lines[n % 27 : n % 27 + n % 4], status="FOP"[n % 3]) for n in range(600)] + ["", "<a>1", "<order>5&#53;</order>"] * 4
    env = xpath.Env()
    items = lambda sources, tree: [(n, k, xpath.text_of(x)) for n, s in sources.items() for k, x in enumerate(xpath.select_all(tree, s, env), 1)]
    known, others, made = {n: s for n, s in _EXPRESSIONS.items() if blind(s)}, {n: s for n, s in _EXPRESSIONS.items() if not blind(s)}, []
    filled = Filled(lambda raw, tree: made.append(raw) or items(known, tree), 3, free(env), lambda tree: items(others, tree))
    for raw in docs:
        out = [[], [], []]
        assert filled(raw, out) == len(out[0]) and sorted(zip(*out, strict=True)) == sorted(items(_EXPRESSIONS, nodes.read(raw)))
    assert len(made) < len(docs) * 3 // 4 and filled.met > len(docs) // 2  # before, each document was evaluated by itself
    assert any(rows is not None and rows.tree is not None for rows in filled.known.values())


@pytest.mark.parametrize("columns", [None, ["own_text", "params", "suppressed"]])
def test_records_of_a_known_shape(spark, columns, monkeypatch):
    from quillspark.operators import documents

    docs = [(n, order(n, (n, "RAN"[n % 3], n + 1), status="FO"[n % 2])) for n in range(60)] + [(99, None)]
    table, rules = spark.createDataFrame(docs, "doc_id int, raw string").coalesce(1), RuleSet.parse(ORDER_RULES)
    found = documents.recorded(table, rules, columns=columns)
    assert columns is None or found.columns == ["doc_id", *columns]
    process, want = Process(rules, "json"), []
    for n, raw in docs:
        from quillspark.tree.process import flat_records
        want += [(str(n), r["own_text"], bool(r.get("suppressed"))) for r in flat_records(process.transform([nodes.read(raw)]))]
    assert sorted((r.doc_id, r.own_text, r.suppressed) for r in found.collect()) == sorted(want)
    assert blind_rules(process, True) and not blind_rules(process)


def test_counts_are_those_of_all_facts(spark):
    from quillspark.operators import documents

    docs = [(n, order(n, (n, "RAN"[n % 3], n + 1), status="FO"[n % 2])) for n in range(60)] + [(98, "<order>1<b>"), (99, None), (100, "")]
    table, rules = spark.createDataFrame(docs, "doc_id int, raw string").coalesce(1), RuleSet.parse(ORDER_RULES)
    want = {(r.fact, r.key, r.detail, r.n) for r in documents.totals(documents.facts(table, rules)).collect()}
    assert {tuple(r) for r in documents.counted(table, rules).collect()} == want
    part = documents.counted(table, rules)
    assert "MapInArrow" in part._jdf.queryExecution().executedPlan().toString() and part.columns == ["fact", "key", "detail", "n"]


@pytest.mark.parametrize("kinds", [None, "e"])
def test_nodes_of_a_known_shape(spark, kinds):
    from quillspark.sources.markup import shred

    docs = [(n, order(n, (n, "RAN"[n % 3], n + 1), status="FO"[n % 2])) for n in range(60)] + [(97, "<a>1<b x='2'>"), (98, "<a>3<b x='4'>"), (99, None), (100, ""), (101, "<!-- 1 --><a>&#49;</a>")] + [(n, f'<a n{n % 2}="{n}"><?p {n}?>{n}</a>') for n in range(200, 212)]
    table = spark.createDataFrame(docs, "doc_id int, raw string").coalesce(1)
    columns = ["doc_id", "node_id", "end_id", "parent_id", "kind", "tag", "attrs", "text", "string_value", "xml_id", "xpath", "parent_attrs"]
    whole = shred(table).select(*columns)  # lines are asked for, so each document is parsed
    want = [str(r) for r in (whole if kinds is None else whole.where(f"instr('{kinds}', kind) > 0")).collect()]
    assert [str(r) for r in shred(table, columns=columns, kinds=kinds).collect()] == want


def test_equal_blocks_are_walked_once(spark, monkeypatch):
    from quillspark.operators import blocks, twigs
    from quillspark.sources.markup import shred

    docs = [(n, order(n, *[(n, "R", n)] * (n % 3))) for n in range(90)]
    table = shred(spark.createDataFrame(docs, "doc_id int, raw string"), columns=["doc_id", "node_id", "end_id", "parent_id", "kind", "tag", "attrs"], kinds="e")
    seen = {}
    real = blocks.walked
    monkeypatch.setattr(blocks, "walked", lambda rows, keys, each, schema: seen.update(each=each) or real(rows, keys, each, schema))
    got = twigs.several(table, [([twigs.below("item")], None), ([twigs.below("item"), twigs.child("q")], 0)])
    assert got.count() == 180
    rows = [(0, 9, None, 1, None), (1, 1, 0, 1, None)]
    once, walks = seen["each"], []
    monkeypatch.setattr(twigs, "_satisfied", lambda *a: walks.append(1) or ({}, {}))
    assert once(("a", 0), list(rows)) == once(("b", 0), rows[::-1]) == [] and len(walks) == 1  # before, each block was walked
