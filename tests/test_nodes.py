import os

import pytest

from quillspark.operators import nodes
from quillspark.plans import tree_queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_outline_numbers_of_all_levels_by_parents(spark):
    tree = tree_queries._tree(spark, DATA)
    rows = sorted(tree.collect(), key=lambda r: (r.doc_id, r.node_id))
    assert sum(r.depth == 3 for r in rows) == spark.read.parquet(f"{DATA}/orders.parquet").count()
    want, children = {}, {}
    for r in rows:
        n = children[r.doc_id, r.parent_id] = children.get((r.doc_id, r.parent_id), 0) + 1
        want[r.doc_id, r.node_id] = str(n) if r.parent_id is None else f"{want[r.doc_id, r.parent_id]}.{n}"
    # Parents alone number the nodes: no interval is needed.
    got = nodes.outline_numbers(tree.drop("end_id", "depth")).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.context_id): r.outline for r in got} == want
