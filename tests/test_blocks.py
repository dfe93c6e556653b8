"""Scans by blocks against plain loops; blocks are smaller than the documents."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import blocks, nodes, passages, records


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for doc in ("a", "b", None, "lone"):
        for k in sorted(rng.sample(range(-20, 400), 1 if doc == "lone" else 150)):
            out.append((doc, k, rng.choice([None, rng.randrange(100)]), "own"))
    return out


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_running_values(spark, rows, span):
    table = spark.createDataFrame(rows, "doc string, at int, v int, block string").repartition(3)
    kinds = {"total": ("sum", F.col("v")), "latest": ("last", F.col("v")), "most": ("max", F.col("v")), "least": ("min", F.col("v"))}
    for exclusive in (False, True):
        got = blocks.running(table, "doc", "at", span, exclusive, **kinds)
        assert got.columns == [*table.columns, *kinds]
        want = []
        for doc, at, v, own in rows:
            seen = [x for d, k, x, _ in rows if d == doc and x is not None and (k < at or (k == at and not exclusive))]
            want.append((doc, at, v, own, sum(seen) if seen else None, seen[-1] if seen else None, max(seen, default=None), min(seen, default=None)))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_ranks_over_ranges(spark, rows):
    table = spark.createDataFrame([(d, [str(k), str(v)]) for d, k, v, _ in rows], "doc string, path array<string>")
    got = {(r.doc, *r.path): r.n for r in blocks.ranked(table, "doc", "path", "n", 9).collect()}
    by = {}
    for d, k, v, _ in rows:
        by.setdefault(d, []).append((str(k), str(v)))
    assert got == {(d, *p): n for d, paths in by.items() for n, p in enumerate(sorted(paths))}


def test_repeated_paths_are_an_error(spark):
    edges = lambda paths: spark.createDataFrame([("d", p) for p in paths], "doc_id string, path array<int>")
    got = sorted((r.node_id, r.end_id, r.parent_id, r.depth) for r in nodes.encode(edges([[0], [0, 2], [0, 1], [0, 2, 5]])).collect())
    assert got == [(0, 3, None, 0), (1, 1, 0, 1), (2, 3, 0, 1), (3, 3, 2, 2)]
    with pytest.raises(ValueError, match="repeated path"):
        nodes.encode(edges([[0], [0, 1], [0, 1]]))


def test_operators_across_blocks(spark, monkeypatch):
    """What runs through a document does not notice where blocks begin."""
    table = spark.createDataFrame([("d", k, 39 if k in (5, 70) else k, "pb" if k % 9 == 4 else "p", k in (5, 70)) for k in range(90)], "doc_id string, node_id int, end_id int, tag string, hide boolean")
    found = []
    for span in (4, 1 << 14):
        monkeypatch.setattr(blocks.running, "__defaults__", (span, False))
        pages = {r.node_id: r.page for r in nodes.page_of(table).collect()}
        inside = {r.node_id: r.inside for r in records.covered(table, "hide").collect()}
        numbers = {r.node_id: r.note_no for r in records.running_numbers(table, F.when(F.col("tag") == "pb", "x")).collect()}
        unit = {r.node_id: r.unit_no for r in passages.islands(table, F.col("tag") == "pb", order="node_id").collect()}
        found.append((pages, inside, numbers, unit))
    assert found[0] == found[1]
    assert {k for k, v in found[0][1].items() if v} == set(range(6, 40)) and found[0][0][89] == 10


def test_no_task_takes_a_document(spark):
    """With five documents, blocks are dealt evenly: the largest task has at most twice the median's rows."""
    table = spark.range(5 * 40_000).select((F.col("id") % 5).alias("doc"), F.floor(F.col("id") / 5).alias("at"), F.lit(1).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = sorted(r["count"] for r in blocks.running(table, "doc", "at", 256, n=("sum", F.col("v"))).groupBy(F.spark_partition_id().alias("task")).count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
