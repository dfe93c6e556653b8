import os
import random

import pytest
import test_queries

from quillspark.operators import registers


def test_references_to_one_id_are_divided(spark):
    rng = random.Random(2)
    refs = [(k, " ".join(rng.sample(["a", "b", "none", f"x{k % 5}"], 3))) for k in range(400)]
    register = [("r", 1, "a", "one"), ("r", 2, "a", "again"), ("r", 3, "b", "two"), ("s", 1, "b", "three"), *[("s", 10 + k, f"x{k}", f"n{k}") for k in range(4)]]
    both = spark.createDataFrame([("all", "r"), ("all", "s")], "uri string, member string")
    rows = spark.createDataFrame(register, "uri string, node_id long, xml_id string, name string")
    found = registers.by_id(spark.createDataFrame(refs, "ref_no long, ref string").withColumn("uri", registers.F.lit("all")), rows, None, both, hot=20)
    held = {}
    for uri, node, xml_id, name in register:
        held.setdefault((uri, xml_id), (uri, node, name))
    want = {(no, k, h[0], h[2]) for no, ref in refs for k, h in enumerate(sorted(held[u, i] for i in ref.split() for u in "rs" if (u, i) in held), 1)}
    got = [(r.ref_no, r.found_no, r.uri, r.name) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "piece_" in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(test_queries.DATA), reason="no test data")
@pytest.mark.parametrize("name", ["register_id", "register_lookup", "graph_used_classes", "unit_declared"])
def test_lookups_equal_sql(spark, name):
    test_queries.test_query_equals_sql(spark, name)
