"""Hybrid modes against plain fusion: ids that come twice, one-sided hits, merged metadata."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval as R

LIST = "query_id long, id long, rank int, score double, metadata map<string,string>"


@pytest.fixture(scope="module")
def arms(spark):
    d = [(1, 10, 1, 0.9, {"a": "d", "x": "1"}), (1, 11, 2, 0.8, {"a": "d"}), (1, 10, 3, 0.7, {"a": "late"}), (1, 12, 4, 0.6, None), (2, 20, 1, 0.5, {})]
    s = [(1, 12, 1, 7.0, {"a": "s", "y": "2"}), (1, 12, 2, 6.0, {"a": "late"}), (1, 10, 3, 5.0, {"a": "s"}), (3, 30, 1, 4.0, {"y": "3"})]
    return spark.createDataFrame(d, LIST), spark.createDataFrame(s, LIST)


def test_modes(arms):
    rows = lambda mode, k=9: [(r.query_id, r.id, r.rank, r.dense_rank, r.sparse_rank, r.dense_score, r.sparse_score, r.metadata, r.score) for r in R.hybrid(*arms, mode=mode, k=k).orderBy("query_id", "rank").collect()]
    rrf = lambda a, b: round(1 / (60 + a) + 1 / (60 + b), 8)
    assert rows("hybrid_bm25") == [
        (1, 10, 1, 1, 2, 0.9, 5.0, {"a": "s", "x": "1"}, rrf(1, 2)),
        (1, 12, 2, 3, 1, 0.6, 7.0, {"a": "s", "y": "2"}, rrf(3, 1)),
        (1, 11, 3, 2, None, 0.8, None, {"a": "d"}, rrf(2, 3)),
        (2, 20, 1, 1, None, 0.5, None, {}, rrf(1, 1)),
        (3, 30, 1, None, 1, None, 4.0, {"y": "3"}, rrf(1, 1)),
    ]
    assert [r[:3] + r[7:] for r in rows("dense", 2)] == [(1, 10, 1, {"a": "d", "x": "1"}, 0.9), (1, 11, 2, {"a": "d"}, 0.8), (2, 20, 1, {}, 0.5)]
    assert [(r[1], r[8]) for r in rows("hybrid_splade") if r[0] == 1] == [(12, 2.7), (10, 2.4), (11, 0.8)]
    with pytest.raises(ValueError, match="is none of"):
        R.hybrid(*arms, mode="sparse")


def test_merged_is_null_safe(spark):
    m = "map<string,string>"
    d = spark.createDataFrame([({"a": "1", "b": None}, {"b": "2"}), (None, {"c": "3"}), ({"a": "1"}, None), (None, None)], f"l {m}, r {m}")
    assert [r[0] for r in d.select(R.merged(F.col("l"), F.col("r"))).collect()] == [{"a": "1", "b": "2"}, {"c": "3"}, {"a": "1"}, {}]


def test_filter_by_column_is_filter_by_list(spark):
    from corpusloom.operators import bm25

    d = spark.createDataFrame([(i, f"word w{i % 4} x{i}", "en" if i % 3 else "fr") for i in range(60)], "doc_id long, text string, lang string")
    q = spark.createDataFrame([(1, "w1 word"), (2, "x9 x10 w2")], "query_id long, text string")
    same = lambda **how: sorted(map(tuple, bm25.top_hits(d, q, 7, **how).collect()))
    want = same(allowed=d.filter("lang = 'en'").select("doc_id"))
    assert same(where=F.col("lang") == "en") == want and len(want) == 14
    assert same(where=F.col("lang") == "en", allowed=d.filter("doc_id < 30").select("doc_id")) == same(allowed=d.filter("lang = 'en' AND doc_id < 30").select("doc_id"))
