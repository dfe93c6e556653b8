"""The Merkle manifest against a plain recursion over whole lists."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, tree string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text):
    return H(*map(field, [row[0], row[1], row[2], row[3], text]))


def levels(leaves, fanout):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + fanout]) for k in range(0, len(out[-1]), fanout)])
    return out


def path(tree, k, fanout):
    out = []
    for level in tree[:-1]:
        first = k - k % fanout
        out.append(("".join(level[first:k]), "".join(level[k + 1 : first + fanout])))
        k //= fanout
    return out


def expected(rows, fanout=3):
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row, row[4]), row))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by[s], key=lambda x: x[:3])], fanout) for s in sources}
    top = levels([trees[s][-1][0] for s in sources], fanout)
    out = []
    for n, s in enumerate(sources):
        for k, (_, _, own, row) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            steps = path(trees[s], k, fanout) + path(top, n, fanout)
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            found = leaf(row, row[4].replace("\n", "") if tampered and row[4] is not None else row[4])
            for left, right in steps:
                found = H(left, found, right)
            out.append((row[0], own, trees[s][-1][0], top[-1][0], H(*[x for step in steps for x in step]), found, found == top[-1][0]))
    return sorted(out, key=repr)


def made(n, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(-50, 4 * n), rng.choice(["hot"] * 6 + ["b", "é", "", None, f"own{i}"]), rng.choice(["en", None]), rng.choice([None, i]), rng.choice([None, "", "a\nb", f"text {i} é🙂\n", "x" * 3000]), "clash", "clash") for i in range(n)]
    return rows + rows[:5] + [rows[0]] * 7 + [(None, "hot", None, None, None, "", "")] * 2 if n > 10 else rows


@pytest.mark.parametrize(("n", "fanout", "part_rows"), [(1, 3, 10), (10, 2, 1), (160, 3, 1), (300, 3, 7), (120, 5, 3)])
def test_audit_is_the_plain_recursion(spark, n, fanout, part_rows):
    rows = made(n, n)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = merkle.audited(docs, merkle.without_line_feeds(), fanout, part_rows)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows, fanout)


def test_manifest_holds_all_digests(spark):
    rows = made(200, 5)
    nodes, tops = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), part_rows=3)
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row, row[4])))
    want = {(s, level, k, d) for s, own in by.items() for level, ds in enumerate(levels([x[2] for x in sorted(own)], 3)) for k, d in enumerate(ds)}
    got = [tuple(r) for r in nodes.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    roots = {r.source: (r.leaves, r.subroot, r.root) for r in tops.collect()}
    top = levels([levels([x[2] for x in sorted(by[s])], 3)[-1][0] for s in sorted(by, key=lambda s: (s is not None, (s or "").encode()))], 3)[-1][0]
    assert roots == {s: (len(own), levels([x[2] for x in sorted(own)], 3)[-1][0], top) for s, own in by.items()}


def test_only_changed_rows_fail(spark):
    rows = made(100, 9)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert merkle.audited(docs).where("not verified").count() == 0
    changed = merkle.audited(docs, F.when(F.col("doc_id") == rows[20][0], F.lit("other")).otherwise(F.col("text")))
    assert {r.doc_id for r in changed.where("not verified").collect()} == {rows[20][0]}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle.audited(docs).collect() == []
    assert [d.count() for d in merkle.manifest(docs)] == [0, 0]


def test_more_partitions_than_asked_for(spark, monkeypatch):
    """Sessions may hold their own number of partitions; merging goes on until none is left."""
    plain = type(spark.range(1)).repartitionByRange
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", lambda self, n, *keys: plain(self, 150, *keys))
    rows = made(200, 3)
    got = merkle.audited(spark.createDataFrame(rows, SCHEMA), merkle.without_line_feeds())
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)
