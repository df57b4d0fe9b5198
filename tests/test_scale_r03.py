"""What keeps a query's memory, shuffles and rows in proportion to its input; results against plain ones."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import bm25, evaluation, sparse_index
from corpusloom.operators import retrieval as R
from corpusloom.plans.registry import QUERIES
from corpusloom.sources import files


def rows(df, *by):
    return sorted(tuple(r) for r in (df.select(*by) if by else df).collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(5)
    said = [None, "", "Same words here", *(" ".join(rnd.choice("a bb cc dd ee ff gg".split()) for _ in range(rnd.randint(1, 30))) + f" only{i}" for i in range(60))]
    return spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "bb bb gg only7"), (2, "nothing like that"), (3, None), (4, "same here ee")], "query_id long, text string")


def test_all_scores_are_the_joins_without_a_shuffle(spark, texts, asked):
    found = bm25.all_scores(texts, asked)
    want = rows(bm25.scores(asked, bm25.postings(texts)), "query_id", "doc_id", "score")
    assert rows(found) == want and len(want) > 60
    assert "hashpartitioning" not in plan(found)
    assert bm25.all_scores(texts.filter("false"), asked).count() == 0 and bm25.all_scores(texts, asked.filter("false")).count() == 0


def test_rows_that_share_a_doc_id_are_one_document(spark, asked):
    """As the SQL groups them: one document of all their terms, and none without a doc_id."""
    d = spark.createDataFrame([(1, "same here"), (1, "bb bb same"), (2, "ee"), (None, "gg bb"), (None, "bb")], "doc_id long, text string")
    assert rows(bm25.postings(d), "doc_id", "term", "tf") == [(1, "bb", 2), (1, "here", 1), (1, "same", 2), (2, "ee", 1)]
    s = rows(bm25.all_scores(d, asked), "query_id", "doc_id")
    assert s == [(1, 1), (4, 1), (4, 2)]


def test_scaled_scores_need_no_window(spark):
    hits = spark.createDataFrame([(1, 10, 2.0), (1, 11, 4.0), (1, 12, 3.0), (2, 10, 5.0)], "query_id long, doc_id long, score double")
    for n, want in ((3, [(1, 10, 0.0), (1, 11, 1.0), (1, 12, 0.5), (2, 10, 1.0)]), (4, [(1, 10, 0.5), (1, 11, 1.0), (1, 12, 0.75), (2, 10, 1.0)]), (None, [(1, 10, 0.0), (1, 11, 1.0), (1, 12, 0.5), (2, 10, 0.0)])):
        d = bm25.min_max(hits, n)
        assert rows(d, "query_id", "doc_id", "norm") == want
        assert "Window" not in plan(d) and "BroadcastHashJoin" in plan(d)


def test_only_rare_terms_are_shuffled_to_their_counts(spark, texts):
    """Few or all terms by broadcast: the same df; a term of many documents takes no part in the shuffle."""
    tf = bm25.written(bm25.counted(texts), "test-tf")
    want = rows(tf.groupBy("term").agg(F.count("*").alias("df")))
    for most in (0, 7, 1000):
        x = bm25.with_df(tf, most)
        assert x.count() == tf.count() and rows(x.select("term", "df").distinct(), "term", "df") == want
        assert "BroadcastHashJoin" in plan(x)


def test_counted_terms_are_those_of_a_grouping(spark, texts):
    want = rows(bm25.terms(texts, "doc_id").groupBy("doc_id", "term").count(), "doc_id", "term", "count")
    found = bm25.counted(texts)
    assert rows(found, "doc_id", "term", "tf") == want and "Exchange hash" not in plan(found)
    odd = spark.createDataFrame([(1, " -Aa9--b\tÄa\n"), (2, "--"), (3, "x")], "doc_id long, text string")
    assert rows(bm25.counted(odd), "doc_id", "dl", "term", "tf") == [(1, 3, "a", 1), (1, 3, "aa9", 1), (1, 3, "b", 1), (3, 1, "x", 1)]


def test_index_takes_more_buckets_for_more_text(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(sparse_index, "BUCKET_BYTES", 200)
    at = str(tmp_path / "i")
    sparse_index.build(texts, at)
    index = sparse_index.load(spark, at)
    assert index.buckets > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows(index.terms, "term", "df", "n") == rows(bm25.term_stats(bm25.term_frequency(texts)), "term", "df", "n")


def test_grades_by_label_are_those_of_pairs_without_pairs(spark):
    v = spark.createDataFrame([(i, None if i % 11 == 0 else i % 3) for i in range(40)], "id long, label int")
    q = v.filter("id % 10 < 2").withColumnRenamed("id", "query_id")
    pairs = q.join(v, "label").select("query_id", "id", F.when(F.col("query_id") == F.col("id"), 3.0).otherwise(1.0).alias("relevance"))
    run = q.join(v.select("id"), F.pmod(F.col("id") * 7 + F.col("query_id"), F.lit(5)) == 0).select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("id") % 7, "id")).alias("rank"))
    by = evaluation.SameLabel(q, v)
    for f in (lambda x: evaluation.recall(run, x, [1, 5, 10]), lambda x: evaluation.recall(run, x, [3], 2.0), lambda x: evaluation.reciprocal_rank(run, x), lambda x: evaluation.ndcg(run, x, [1, 5, 10])):
        assert rows(f(by)) == rows(f(pairs))


def test_fused_lists_are_made_once(spark):
    a = spark.range(20).select((F.col("id") % 3).alias("query_id"), "id", (F.col("id") / 3 + 1).cast("int").alias("rank"))
    b = spark.range(30).select((F.col("id") % 4).alias("query_id"), "id", (F.col("id") / 4 + 1).cast("int").alias("rank"))
    found = R.rrf(a, b)
    assert plan(found).count("Range (") == 2
    score = {(r.query_id, r.id): r.rrf_score for r in found.collect()}
    assert score[3, 3] == round(1 / 61 + 1 / 61, 8) and score[0, 0] == round(1 / 61 + 1 / 61, 8)  # query 3 has no list in a: rank 0 + 1


def test_scans_take_few_texts_at_once(spark, texts, asked):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, 10000)
        bm25.top_hits(texts, asked, 3)
        assert int(spark.conf.get(key)) <= 1000
    finally:
        spark.conf.set(key, before)


def test_a_scan_shuffles_no_content_and_keeps_rows_apart(spark):
    f = spark.createDataFrame([("a.txt", b"words"), ("a.txt", b"other words"), ("b.pdf", b"no pdf"), ("c.html", b"<html>x</html>")], "path string, content binary")
    s = files.scan(f.withColumn("length", F.octet_length("content").cast("long")))
    assert "Exchange" not in plan(s)
    assert sorted(map(str, rows(s.na.fill(""), "path", "text", "status"))) == sorted(map(str, [("a.txt", "words", "parsed"), ("a.txt", "other words", "parsed"), ("b.pdf", "", "failed"), ("c.html", "x", "parsed")]))


def test_queries_make_chunks_and_hits_once(spark):
    at = "/root/testdata/sf0.001"
    q = QUERIES["ingest_summary"](spark, at)
    assert plan(q).count("Scan parquet") == 2 and {r.phase: r.rows >= r.docs > 0 for r in q.collect()} == {"chunks": True, "vectors": True, "postings": True}
    assert "MapInArrow" not in plan(QUERIES["context_neardup_pairs"](spark, at))
