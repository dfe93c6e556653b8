import os

import duckdb
import numpy as np
import pytest

from quillspark.plans import catalogue

DATA = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float | np.floating):
        return round(float(x), 6)
    return list(map(plain, x)) if isinstance(x, list | tuple) else x


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["doc_lines_normalized", "doc_passages_split", "doc_passage_ids", "tree_nodes", "tree_link_rewrite", "rule_first_match", "conv_notes_labelled_first", "facet_lists", "class_closure", "may_contain", "page_tag_counts", "event_sessions"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    df = catalogue.queries()[name](spark, DATA)
    found = con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == sorted(str([plain(x) for x in row]) for row in found.fetchall())


def test_streamed_index_upserts(spark, tmp_path):
    from quillspark.plans.rules import RuleSet
    from quillspark.streaming.watch import current, index_folder
    from quillspark.tree.passages import Options

    rules = RuleSet.parse('<schemaSpec ns=""><elementSpec ident="d"><model behaviour="section"/></elementSpec></schemaSpec>')
    write = lambda name, text: ((tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True), (tmp_path / "in" / name).write_text(text))
    write("a/x.xml", '<d xml:id="one">first text</d>')
    write("b/x.xml", '<d xml:id="one">another text</d>')
    run = lambda k: index_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / f"state{k}"), rules, Options(min_chars=1)).awaitTermination()
    for k in range(2):
        run(k)
    assert {(r.doc_id, r.id, r.document) for r in current(spark, str(tmp_path / "out")).collect()} == {("a/x", "a/x#one", "first text"), ("b/x", "b/x#one", "another text")}
    write("a/x.xml", '<d xml:id="one">changed text</d>')
    run(3)
    assert sorted(r.document for r in current(spark, str(tmp_path / "out")).collect()) == ["another text", "changed text"]


def test_an_upsert_writes_the_buckets_it_touches(spark, tmp_path):
    from quillspark.streaming.watch import current, upsert

    target = str(tmp_path / "target")
    schema = "doc_id string, id string, hash string, document string"
    rows = [(f"d{k // 4}", f"d{k // 4}#{k % 4}", f"h{k}", f"text {k}") for k in range(1000)]
    frame = lambda x: spark.createDataFrame(x, schema)
    files = lambda: {str(f): f.stat().st_size for f in (tmp_path / "target").rglob("*.parquet")}
    held = lambda: sorted(tuple(r) for r in current(spark, target).select("doc_id", "id", "hash", "document").collect())
    assert upsert(frame(rows), target, batch="a-0") > 50 and held() == sorted(rows)
    before = files()
    changed = [*rows[:3], ("d0", "d0#3", "other", "another text")]
    assert upsert(frame(changed), target, batch="a-1") == 1  # one bucket of 64
    written = sum(size for f, size in files().items() if f not in before)
    assert held() == sorted(changed + rows[4:]) and 0 < written < sum(before.values()) / 20
    before = files()
    assert upsert(frame(rows[:4]), target, batch="a-1") == 0 and upsert(frame(changed), target) == 0 and files() == before  # seen, or nothing new
    twice = [("d1", "d1#0", "b", "second"), ("d1", "d1#0", "a", "first"), ("new", "new#0", "n", "new")]
    gone = spark.createDataFrame([("d2",)], "doc_id string")
    assert upsert(frame(twice), target, docs=gone) > 0  # passages that documents no longer have go, also the last ones
    want = [r for r in changed + rows[4:] if r[0] not in ("d1", "d2")] + [twice[1], twice[2]]
    assert held() == sorted(want)
    whole = spark.createDataFrame([(f"d{k}",) for k in range(250)] + [("new",)], "doc_id string")
    assert upsert(frame([]), target, docs=whole) > 0 and held() == []


def test_streamed_windows(spark, tmp_path):
    from quillspark.streaming import watch

    rows = spark.createDataFrame([(1, "2024-01-01 00:01:00"), (1, "2024-01-01 00:05:00"), (1, "2024-01-01 01:00:00"), (2, "2024-01-01 00:02:00")], "u int, t string").selectExpr("u", "cast(t as timestamp) t")
    rows.write.parquet(str(tmp_path / "e"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))

    def run(df, name, mode="complete"):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.n for r in spark.table(name).collect())

    assert run(watch.tumbling(stream(), "t", "30 minutes", ["u"]), "tumbled") == [1, 1, 2]
    assert run(watch.sliding(stream(), "t", "30 minutes", "15 minutes", ["u"]), "slid") == [1, 1, 1, 1, 2, 2]
    assert run(watch.sessions(stream(), "t", "10 minutes", ["u"]), "sat") == [1, 1, 2]
    watch.without_repeats(stream(), "t", ["u"]).writeStream.format("memory").queryName("once").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 2


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_columns_and_trees_agree_on_pages(spark):
    """The records that Columns make of node tables are those that trees give."""
    from quillspark.operators import documents, records
    from quillspark.plans.corpus_queries import PAGE_RULES
    from quillspark.plans.rules import RuleSet
    from quillspark.sources.markup import parse_html

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    rules = RuleSet.parse(PAGE_RULES)
    by_columns = sorted(map(tuple, catalogue.queries()["page_records"](spark, DATA).select("doc_id", "xpath", "tag", "behaviour", "rule_key", "suppressed").na.fill("").collect()))
    found = documents.recorded(pages, rules, "web", documents.Setup(kind="html"), id_="page_id", raw="html")
    assert by_columns == sorted(map(tuple, found.select("doc_id", "xpath", "element", "behaviour", "model", "suppressed").na.fill("").collect())) != []
    nodes = {(r.doc_id, r.node_id): (r.kind, r.tag, r.end_id, r.parent_id, r.xpath) for r in catalogue.queries()["page_nodes"](spark, DATA).collect()}
    for p in pages.collect():
        for n in parse_html(p.html):
            assert nodes.pop((str(p.page_id), n["node_id"])) == (n["kind"], n["tag"], n["end_id"], n["parent_id"], n["xpath"])
    assert not nodes
    total = documents.totals(documents.facts(pages, rules, "web", documents.Setup(kind="html"), id_="page_id", raw="html"))
    want = {r.behaviour: r.n for r in records.behaviour_counts(records.pruned(records.dispatch(*_nodes_and_rules(pages, rules)))).collect()}
    assert {r.key: r.n for r in total.where("fact = 'behaviour'").collect()} == want


def _nodes_and_rules(pages, rules):
    from quillspark.sources.markup import shred

    return shred(pages, "page_id", "html", "html"), rules
