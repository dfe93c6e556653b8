from quillspark.operators import specs


def test_closure_of_a_long_chain_and_a_cycle(spark):
    edges = [(i, i + 1) for i in range(70)] + [(100, 101), (101, 102), (102, 100)]
    got = sorted((r.src, r.dst) for r in specs.closure(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == sorted([(i, j) for j in range(71) for i in range(j)] + [(i, j) for i in (100, 101, 102) for j in (100, 101, 102)])
