"""The stored index: same hits as a scan, no shuffle of postings or hits, errors that name what lacks."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import bm25, sparse_index


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 17 else None, f"common w{i % 7} w{i % 5} w{i % 5} x{i}" if i % 13 else None, "t") for i in range(200)]
    return spark.createDataFrame([*rows, (1000, "", "t")], "doc_id long, text string, term string").repartition(5)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "common w3 w3"), (2, "W1, w4!"), (3, "nowhere"), (4, None)], "query_id long, text string")


def test_hits_of_a_scan(spark, docs, queries, tmp_path):
    sparse_index.build(docs, str(tmp_path / "i"), buckets=3)
    index = sparse_index.load(spark, str(tmp_path / "i"))
    named = docs.filter("doc_id IS NOT NULL")
    assert index.n_docs == named.count() and index.postings.filter("term = 'common'").select("shard").distinct().count() == 3
    same = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))
    want = same(bm25.top_hits(named, queries, 12))
    assert same(sparse_index.top_hits(index, queries, 12)) == want and len({r[0] for r in want}) == 2
    assert same(sparse_index.top_hits(index, queries, 12, broadcast_terms=1)) == want
    allowed = docs.filter("doc_id % 3 = 0").select("doc_id")
    assert same(sparse_index.top_hits(index, queries, 5, allowed)) == same(bm25.top_hits(named, queries, 5, allowed))


def test_neither_postings_nor_hits_are_shuffled(spark, docs, queries, tmp_path):
    sparse_index.build(docs, str(tmp_path / "i"), buckets=4)
    index = sparse_index.load(spark, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "common", 1, 0.5), (2, "w3", 2, 0.7)], "query_id long, term string, n long, idf double")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = sparse_index.scored(index, asked)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert "Bucketed: true" in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange") == plan.count("BroadcastExchange") == 1


def test_newest_build_and_errors(spark, docs, queries, tmp_path):
    at = str(tmp_path / "i")
    with pytest.raises(sparse_index.IndexNotFound, match="no index at"):
        sparse_index.load(spark, at)
    sparse_index.build(docs.limit(0), at, buckets=2)
    assert sparse_index.load(spark, at).n_docs == 0 and sparse_index.top_hits(sparse_index.load(spark, at), queries, 3).count() == 0
    name = sparse_index.build(docs, at, buckets=2)
    assert sparse_index.load(spark, at).n_docs == docs.filter("doc_id IS NOT NULL").count()
    spark.range(1).select(F.lit("a").alias("term")).write.mode("overwrite").parquet(f"{at}/{name}/terms")
    with pytest.raises(ValueError, match="table terms .* lacks df, n"):
        sparse_index.load(spark, at)
