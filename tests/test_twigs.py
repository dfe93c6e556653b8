"""Twigs against nested loops over parsed documents, with blocks far smaller than these."""

import os
import random

import pytest

from quillspark.operators.twigs import below, child, matches, picked, placed, several
from quillspark.plans import catalogue
from quillspark.sources.markup import shred

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(8)

    def grow(depth):
        tag = rng.choice("abcd")
        inner = "".join(grow(depth - 1) for _ in range(rng.randint(0, 4)) if depth)
        return f'<{tag} k="{rng.randrange(3)}">{inner}</{tag}>'

    docs = [(f"d{i}", f"<r>{''.join(grow(5) for _ in range(4))}</r>") for i in range(3)] + [("none", "<r/>"), ("bad", "")]
    return shred(spark.createDataFrame(docs, "doc_id string, raw string")).cache()


def walk(rows, path, bind):
    """(doc, match, context) by the definition of each step."""
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    hit = lambda n, s: n["kind"] == "e" and s.tag in (None, n["tag"]) and (s.where is None or n["attrs"].get("k") == s.where[-2])
    under = lambda n, s, nodes: [x for x in nodes if (x["parent_id"] == n["node_id"] if s.axis == "child" else n["node_id"] < x["node_id"] <= n["end_id"])]

    def good(n, s, nodes):
        return hit(n, s) and all(any(good(x, b, nodes) for x in under(n, b, nodes)) for b in s.branches)

    out = set()
    for doc, nodes in by.items():
        chains = [(n,) for n in nodes if good(n, path[0], nodes) and (path[0].axis == "descendant" or n["parent_id"] is None)]
        for s in path[1:]:
            chains = [(*c, x) for c in chains for x in under(c[-1], s, nodes) if good(x, s, nodes)]
        out |= {(doc, c[-1]["node_id"], c[bind]["node_id"] if bind is not None else None) for c in chains}
    return out


PATHS = [
    [below("a")], [child("r"), child()], [below("a"), below("b")], [below("a"), child("b"), below("a")], [below("b").having(child("c")), child("d")],
    [below("a", "attrs['k'] = '1'"), below("b").having(below("c", "attrs['k'] = '2'"))], [child("r"), below("d").having(child("a").having(below("b").having(child("c"))), below("d"))],
    [below().having(below("a"), child("b")), below("c")],
]


@pytest.mark.parametrize("span", [5, 1 << 14])
def test_twigs_equal_nested_loops(table, span):
    rows = [r.asDict() for r in table.collect()]
    for k, path in enumerate(PATHS):
        bind = 0 if k in (2, 3, 7) else None
        got = [(r.doc_id, r.node_id, r.context_id if bind is not None else None) for r in matches(table, path, bind, span).collect()]
        assert len(got) == len(set(got)) and set(got) == walk(rows, path, bind), k


def test_places_count_under_one_parent(table):
    got = {(r.doc_id, r.node_id): (r.pos, r.size) for r in placed(table.where("tag = 'a'")).collect()}
    rows = [r for r in table.collect() if r.tag == "a"]
    for r in rows:
        mine = sorted(x.node_id for x in rows if (x.doc_id, x.parent_id) == (r.doc_id, r.parent_id))
        assert got[r.doc_id, r.node_id] == (mine.index(r.node_id) + 1, len(mine))


@pytest.mark.parametrize("span", [5, 1 << 14])
def test_several_twigs_in_one_walk_are_those_of_single_walks(table, span):
    rows = [r.asDict() for r in table.collect()]
    twigs = [(path, 0 if k in (2, 3, 7) else None) for k, path in enumerate(PATHS)]
    got = [tuple(r) for r in several(table, twigs, span).select("twig", "doc_id", "node_id", "context_id").collect()]
    want = {(k, *found) for k, (path, bind) in enumerate(twigs) for found in walk(rows, path, bind)}
    assert len(got) == len(set(got)) and set(got) == want
    with pytest.raises(ValueError):
        several(table, [(path, None) for path in PATHS] * 5)


def test_columns_of_matches_are_not_broadcast(table):
    found = picked(matches(table, [below("a")]), table, "tag")
    assert {r.tag for r in found.collect()} == {"a"}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_node_tables_give_what_trees_give(spark):
    found = catalogue.queries()["node_xpath"](spark, DATA)
    got = sorted((r.doc_id, r.name, r.item_no, r.value) for r in found.collect())
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert got == sorted((r.doc_id, r.name, r.item_no, r.value) for r in catalogue.queries()["xml_xpath"](spark, DATA).collect())
