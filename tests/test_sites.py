"""Links of index records: results, and shuffles that keep their number of partitions."""

from quillspark.operators import documents, sites
from quillspark.plans.site_queries import index_hrefs

RECORDS = [(1, "a", "b", "own1"), (1, "x", "b", "own2"), (1, "x", "x", "own3"), (2, "a", "b", "own4"), (1, "a", "b", "own1"), (3, None, "a", "own5")]
ANCHORS = [(1, "a", "f1"), (1, "b", "f2"), (2, "b", "f3"), (2, "b", "f4"), (3, "a", "f5")]


def test_links_by_given_partitions(spark):
    records, anchors = spark.createDataFrame(RECORDS, "doc_id long, xml_id string, entry string, file string"), spark.createDataFrame(ANCHORS, "doc_id long, anchor string, file string")
    rows = lambda df: sorted(map(repr, df.select("doc_id", "xml_id", "entry", "file", "href").collect()))
    dealt = sites.page_links(records, anchors, 7)
    assert rows(dealt) == rows(sites.page_links(records, anchors)) and sorted(r["href"] for r in dealt.collect()) == ["f1#a", "f1#a", "f2#b", "f3#b", "f4#b", "f5#a", "own3"]
    assert dealt.rdd.getNumPartitions() == 7


def test_index_hrefs_is_not_joined_into_few_tasks(spark):
    sf = "/root/testdata/sf0.001"
    n = documents.spread(spark.read.parquet(f"{sf}/lineitem.parquet"))
    assert n >= 2 * spark.sparkContext.defaultParallelism and index_hrefs(spark, sf).rdd.getNumPartitions() == n
