"""Search, masking, metrics and index refresh against plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain_pii
from corpusloom.operators import bm25, dense, evaluation, safety
from corpusloom.operators.best import Best
from corpusloom.plans import streams


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_best_of_blocks():
    rng = np.random.default_rng(1)
    for k, n in ((1, 7), (3, 40), (5, 3), (4, 0)):
        s = rng.integers(0, 6, (9, n)).astype(float)
        s[s == 0] = -np.inf
        ids = rng.permutation(n).astype(np.int64)
        best = Best(9, k)
        for i in range(0, n, 11):
            for q in (np.arange(4), np.arange(4, 9)):
                best.add(q, ids[i : i + 11], s[q, i : i + 11])
        got = {}
        for q, i, x in zip(*best.rows(), strict=True):
            got.setdefault(int(q), []).append((int(i), float(x)))
        for q in range(9):
            want = sorted(((int(i), float(x)) for i, x in zip(ids, s[q], strict=True) if np.isfinite(x)), key=lambda r: (-r[1], r[0]))[:k]
            assert got.get(q, []) == want


@pytest.mark.parametrize("limit,matrix", [(1000, 4_000_000), (1000, 8), (3, 8)])
def test_bm25_hits_are_the_joins(spark, monkeypatch, limit, matrix):
    """By value, in blocks of few queries, and by the join: the same hits."""
    monkeypatch.setattr(bm25, "BROADCAST_TERMS", limit)
    monkeypatch.setattr(bm25, "MATRIX", matrix)
    rnd = random.Random(2)
    texts = [None, "", "Same words here", "same WORDS here", *(" ".join(rnd.choice("a bb cc dd ee ff gg".split()) for _ in range(rnd.randint(1, 20))) for _ in range(60))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    q = spark.createDataFrame([(1, "bb bb gg"), (2, "nothing like that"), (3, None), (4, "same here ee"), (5, "a cc")], "query_id long, text string")
    ok = d.filter("doc_id % 3 <> 1").select("doc_id")
    every = bm25.scores(q, bm25.postings(d))
    for allowed, found in ((None, every), (ok, every.join(ok, "doc_id", "left_semi"))):
        assert rows(bm25.top_hits(d, q, 4, allowed).select("query_id", "rank", "doc_id", "score"), "query_id", "rank") == rows(bm25.top(found, 4).select("query_id", "rank", "doc_id", "score"), "query_id", "rank")
    assert bm25.top_hits(d.filter("false"), q, 4).count() == 0 and bm25.top_hits(d, q.filter("false"), 4).count() == 0


@pytest.mark.parametrize("numbers", [1000, 1])
def test_vectors_that_cannot_be_compared(spark, monkeypatch, numbers):
    monkeypatch.setattr(dense, "BROADCAST_NUMBERS", numbers)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, vector array<double>")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None)], "vec_id long, vector array<double>")
    assert rows(dense.top_k(q, v, 2).select("vec_id", "score"), "rank") == [(1, 1.0), (3, 0.707107)]
    odd = v.unionByName(spark.createDataFrame([(7, [1.0]), (8, [None, 1.0])], "vec_id long, vector array<double>"))
    assert [r[0] for r in rows(dense.bad_vectors(odd, "vec_id", "vector", 2), "vec_id")] == [7, 8]
    for x in (7, 8):
        with pytest.raises(Exception, match="numbers|component"):
            dense.top_k(q, odd.filter(F.col("vec_id") == x), 2).collect()


def test_query_without_hits_counts(spark):
    run = spark.createDataFrame([(1, 1, 10), (1, 2, 11)], "query_id long, rank int, id long")
    qrels = spark.createDataFrame([(1, 10, 1.0), (2, 10, 1.0)], "query_id long, id long, relevance double")
    assert rows(evaluation.recall(run, qrels, [1]), "query_id") == [(1, 1, 1.0), (2, 1, 0.0)]
    assert rows(evaluation.reciprocal_rank(run, qrels), "query_id") == [(1, 1.0), (2, 0.0)]
    assert rows(evaluation.ndcg(run, qrels, [1]), "query_id") == [(1, 1, 1.0), (2, 1, 0.0)]


def test_mask_is_mask_text_on_every_row(spark):
    """Each kind of personal data, valid and not, spaced and in other digits."""
    said = [
        None, "", "nothing of it", "PAN ABCDE1234F and abcde1234f", "a.b@example.org", "EMP-123 emp_4567890 EMP12", "cust-998", "4111 1111 1111 1111", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "4111-1111-1111-1112",
        "1234 5678 9012", "12 Long Road, Town 560001", "+91 98765-43210", "(020) 7946 0018", "123456789012345678", "12", "call 1 2 3", "٤١١١ ١١١١ ١١١١ ١١١١", "x@y", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    ]
    d = spark.createDataFrame(list(enumerate(said)), "id long, text string")
    for r in safety.mask(d).collect():
        want = plain_pii.mask_text(r.text or "")
        assert (r.masked or "", r.pii_types) == (want[0], want[1]), r.text


def test_a_document_that_comes_again_replaces_its_terms(spark):
    batch = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string")
    t = streams.refreshed(None, batch((1, "alpha beta"), (2, "beta")))
    t = streams.refreshed(t, batch((1, "gamma")))
    assert rows(t, "doc_id", "term") == [(1, "gamma", 1), (2, "beta", 1)]
    assert rows(streams.refreshed(t, batch((2, ""))), "doc_id", "term") == [(1, "gamma", 1)]
