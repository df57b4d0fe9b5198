"""Dense plus sparse scores of all documents in one search; nothing is cut before the best k are taken."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bm25, dense
from .arrow import lean, small_batches
from .best import Best

_FOUND = "query_id long, id long, score double"


def top_k(docs: DataFrame, queries: DataFrame, alpha: float, k: int) -> DataFrame:
    """query_id, id, score, rank of the best k documents (doc_id, text) of each query (query_id, text): cosine of hashed term counts plus (1 - alpha) times BM25; dense isn't scaled.

    A task scores its documents in blocks, both ways at once, and gives its best k for each query. Queries that tasks can't get by value, and documents of
    several rows, are joined (`_joined`). Null doc_ids are never hits.
    """
    spark = docs.sparkSession
    docs, queries = docs.filter("doc_id IS NOT NULL"), queries.filter("query_id IS NOT NULL")
    most = dense.BROADCAST_NUMBERS // 64
    given = queries.select(F.col("query_id").cast("long").alias("query_id"), dense.hashed_embedding(F.col("text")).alias("vector")).limit(most + 1).toArrow()
    asked = bm25._asked(queries)
    q_ids = given.column("query_id").to_pylist()
    if asked is None or len(q_ids) > most or len(set(q_ids)) < len(q_ids) or bm25.repeated(docs):
        return _joined(docs, queries, alpha, k)
    vectors = dense.matrix(given.column("vector").combine_chunks(), q_ids, 64) if q_ids else np.zeros((0, 64))
    ids, blocks = bm25._by_scan(docs, asked) or ([], None)
    place = {q: i for i, q in enumerate(q_ids)}
    scored, plain = np.array([place[q] for q in ids], np.int64), np.array([i for q, i in place.items() if q not in set(ids)], np.int64)
    shared = spark.sparkContext.broadcast((q_ids, vectors, scored, plain))
    small_batches(spark)

    def run(batches):
        import pyarrow as pa

        q_ids, vectors, scored, plain = shared.value
        best, now = Best(len(q_ids), k), SimpleNamespace(v=None)

        def parts():  # one block of documents at a time, with its vectors in `now`
            for b in batches:
                for lo in range(0, b.num_rows, bm25.ROWS):
                    part = b.slice(lo, bm25.ROWS)
                    own = part.column("doc_id").to_numpy(zero_copy_only=False)
                    now.v = dense.matrix(part.column("vector"), own, 64)
                    for i in range(0, len(plain), 256):
                        best.add(plain[i : i + 256], own, dense.similarity(vectors[plain[i : i + 256]], now.v, "cosine"))
                    yield part

        if blocks is None:
            for _ in parts():
                pass
        else:
            for q, own, s in blocks(parts()):
                at = scored[q]
                best.add(at, own, np.round(dense.similarity(vectors[at], now.v, "cosine") + np.round(s / 1e6 * (1 - alpha), 8), 8))
        at, own, s = best.rows()
        yield pa.record_batch([pa.array(np.array(q_ids, np.int64)[at]), pa.array(own), pa.array(s)], names=["query_id", "id", "score"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"), dense.hashed_embedding(F.col("text")).alias("vector"))
    return bm25.top(d.mapInArrow(lean(run), _FOUND), k, key="id")


def _cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.round(dot(a, b) / norm, 6)).otherwise(0.0)


def _joined(docs: DataFrame, queries: DataFrame, alpha: float, k: int) -> DataFrame:
    """The same by joins: all sparse hits with their dense scores, and the best k dense ones that are no sparse hits. As sparse scores
    aren't negative, what isn't among the best k dense ones and has no sparse score has k better ones."""
    v = docs.select(F.col("doc_id").cast("long").alias("id"), dense.hashed_embedding(F.col("text")).alias("vector"))
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), dense.hashed_embedding(F.col("text")).alias("vector"))
    words = bm25.all_scores(docs, queries).select("query_id", F.col("doc_id").alias("id"), F.round(F.col("score") * (1 - alpha), 8).alias("s"))
    both = words.join(v, "id").join(q.withColumnRenamed("vector", "asked"), "query_id")
    both = both.select("query_id", "id", F.round(_cosine(F.col("asked"), F.col("vector")) + F.col("s"), 8).alias("score"))
    near = dense.top_k(q, v.withColumnRenamed("id", "vec_id"), k).select("query_id", F.col("vec_id").alias("id"), "score")
    return bm25.top(both.unionByName(near.join(words.select("query_id", "id"), ["query_id", "id"], "left_anti")), k, key="id")
