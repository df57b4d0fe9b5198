"""Queries over embeddings. The query set is every vec_id that 50 divides, against all vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dense, retrieval, store
from . import sqltext as S
from .registry import query, table


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")


def asked(spark, d):
    return vectors(spark, d).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")


def top(spark, d, metric="cosine", k=10):
    return dense.top_k(asked(spark, d), vectors(spark, d), k, metric)


def _ranked(score: str) -> str:
    return f"""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, round({score}, 6) AS score FROM q CROSS JOIN embeddings)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""


@query(_ranked("list_cosine_similarity(qv, CAST(embedding AS DOUBLE[]))"))
def dense_topk_cosine(spark, d):
    return top(spark, d)


@query(_ranked("list_inner_product(qv, CAST(embedding AS DOUBLE[]))"))
def dense_topk_dot(spark, d):
    return top(spark, d, "dotproduct")


@query()
def dense_topk_euclid(spark, d):
    """Distances to itself differ in their last digits between ways to compute them; a test holds the order against brute force."""
    return top(spark, d, "euclidean")


@query(f"WITH {S.DENSE} SELECT query_id, vec_id, score FROM dense WHERE score >= 0.75")
def dense_topk_threshold(spark, d):
    return top(spark, d).filter("score >= 0.75").select("query_id", "vec_id", "score")


@query("SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0")
def zero_vector_filter(spark, d):
    return store.non_zero(vectors(spark, d), "vector").select("vec_id")


@query("SELECT vec_id, i, round(x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))), 5) AS x FROM (SELECT vec_id, embedding, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings)")
def l2_normalize(spark, d):
    return vectors(spark, d).select("vec_id", F.posexplode(dense.l2_normalise(F.col("vector"))).alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("x"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS nnz, TRUE AS ok FROM embeddings")
def sparse_vector_check(spark, d):
    """Positive components as parallel arrays of places and values."""
    v = vectors(spark, d).select("vec_id", F.filter(F.transform("vector", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull()).alias("indices"), F.filter("vector", lambda x: x > 0).alias("values"))
    return v.select("vec_id", F.size("indices").cast("long").alias("nnz"), (F.size("indices") == F.size("values")).alias("ok"))


def records(spark, d):
    return vectors(spark, d).withColumn("namespace", F.concat(F.lit("tenant"), F.col("label") % 3, F.lit("__corpus"), "label"))


_NS = "r AS (SELECT vec_id, label, embedding, 'tenant' || (label % 3) || '__corpus' || label AS namespace FROM embeddings)"


@query(f"WITH {_NS} SELECT namespace, count(*) AS n_vectors, CAST(max(len(embedding)) AS INTEGER) AS dimension FROM r GROUP BY ALL")
def namespace_stats(spark, d):
    return store.namespace_stats(records(spark, d), "vector")


@query(f"WITH {_NS} SELECT vec_id, namespace, CASE WHEN label >= 5 THEN 2 ELSE 1 END AS version FROM r UNION ALL SELECT vec_id + 1000000000, namespace, 2 FROM r WHERE label = 9")
def vector_upsert(spark, d):
    old = records(spark, d).select("vec_id", "namespace", F.lit(1).alias("version"))
    again = records(spark, d).filter("label >= 5").select("vec_id", "namespace", F.lit(2).alias("version"))
    fresh = records(spark, d).filter("label = 9").select((F.col("vec_id") + 1000000000).alias("vec_id"), "namespace", F.lit(2).alias("version"))
    return store.upsert(old, again.unionByName(fresh), ["vec_id"])


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def vector_delete_ids(spark, d):
    gone = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return store.delete_ids(vectors(spark, d), gone, "vec_id").select("vec_id")


@query(f"WITH {_NS} SELECT vec_id, namespace FROM r WHERE NOT (namespace = 'tenant1__corpus1' OR label = 4)")
def vector_delete_filter(spark, d):
    return store.delete_where(records(spark, d), (F.col("namespace") == "tenant1__corpus1") | (F.col("label") == 4)).select("vec_id", "namespace")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def vector_fetch(spark, d):
    want = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return store.fetch(vectors(spark, d), want, "vec_id").select("vec_id", "label")


def _fields(spark, d):
    lang = F.col("lang")
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("corpus"), lang.alias("language"), F.col("n_chars").alias("page"), F.when(lang == "en", "public").otherwise("internal").alias("access_level"), F.lit("legal").alias("department"), F.col("doc_id").alias("published_at"))


@query("SELECT doc_id FROM documents WHERE (lang IN ('en', 'de') AND n_chars >= 100 AND (source <> 'src3' OR n_chars < 500))")
def metadata_filter(spark, d):
    f = {"language": {"$in": ["en", "de"]}, "page": {"$gte": 100}, "$or": [{"corpus": {"$ne": "src3"}}, {"page": {"$lt": 500}}]}
    return _fields(spark, d).filter(retrieval.predicate(f)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE source = 'src0' AND lang <> 'en' AND doc_id >= 10")
def acl_filter(spark, d):
    f = retrieval.access_filter({"corpus": "src0"}, department="legal", access_level="internal", date_from=10)
    return _fields(spark, d).filter(retrieval.predicate(f)).select("doc_id")
