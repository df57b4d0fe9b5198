"""Exact dense search: blocks of queries against blocks of vectors, best k of each block first, then of all."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import lean, small_batches
from .best import Best

BLOCK = 4096
#: Numbers of all queries' vectors that tasks get by value at most.
BROADCAST_NUMBERS = 8_000_000


def bad_vectors(rows: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """Rows that can't be compared, with what is wrong: another length, or a component that is null or not a number."""
    v = F.col(vector)
    why = F.when(F.size(v) != dims, F.concat(F.size(v).cast("string"), F.lit(" numbers"))).when(F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double"))), "a component is missing")
    return rows.filter(v.isNotNull()).select(key, why.alias("reason")).filter("reason IS NOT NULL")


def matrix(column, ids: list, dims: int | None) -> np.ndarray:
    """Vectors of an Arrow list column as rows; raises with the id of one that has another length or lacks a component."""
    size = np.diff(column.offsets.to_numpy())
    dims = dims if dims is not None else int(size[0]) if len(size) else 0
    if (size != dims).any():
        raise ValueError(f"vector {ids[int((size != dims).argmax())]} has other than {dims} numbers")
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(size), dims)
    if np.isnan(flat).any():
        raise ValueError(f"vector {ids[int(np.isnan(flat).any(axis=1).argmax())]} lacks a component")
    return flat


def similarity(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    s = q @ v.T
    if metric == "cosine":
        norm = np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1))
        s = np.divide(s, norm, out=np.zeros_like(s), where=norm > 0)
    elif metric == "euclidean":
        s = -np.sqrt(np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * s, 0))
    return np.round(s, 6)


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x / norm))


def blocks(rows: DataFrame, key: str, vector: str, size: int = BLOCK) -> DataFrame:
    """Rows packed to (block, ids, n, data): up to `size` vectors as doubles."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        for b in batches:
            for i in range(0, b.num_rows, size):
                part = b.slice(i, size)
                ids = part.column(key).to_pylist()
                data = matrix(part.column(vector), ids, None)
                yield pa.record_batch([pa.array([at], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([part.num_rows], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["block", "ids", "n", "data"])
                at += 1

    return rows.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), vector).mapInArrow(run, "block long, ids array<long>, n int, data binary")


def top_k(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """query_id, vec_id, score, rank. queries (query_id, vector), vectors (vec_id, vector); ties go to the smaller id.

    Queries of up to `BROADCAST_NUMBERS` numbers go to the tasks by value; a task goes through its vectors and gives its best k for each query. More
    queries meet the vectors in packed blocks. Null vectors are left out; a vector of another length or with a missing
    component fails the job with its id (`bad_vectors` lists them all).
    """
    spark = queries.sparkSession
    schema = "query_id long, vec_id long, score double"
    asked = queries.filter(F.col("vector").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    dims = asked.select(F.max(F.size("vector"))).first()[0] or 1
    rows = asked.limit(BROADCAST_NUMBERS // dims + 1).toArrow()
    if rows.num_rows > BROADCAST_NUMBERS // dims:
        return _ranked(in_blocks(queries, vectors, k, metric), k)
    q_ids = rows.column("query_id").to_pylist()
    shared = spark.sparkContext.broadcast((q_ids, matrix(rows.column("vector").combine_chunks(), q_ids, dims) if q_ids else np.zeros((0, dims))))

    def run(batches):
        import pyarrow as pa

        q_ids, q = shared.value
        best, every = Best(len(q_ids), k), np.arange(len(q_ids))
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                ids = part.column("vec_id").to_pylist()
                v = matrix(part.column("vector"), ids, dims)
                for i in range(0, len(q), 256):  # the matrix of scores stays small
                    best.add(every[i : i + 256], np.array(ids, np.int64), similarity(q[i : i + 256], v, metric))
        at, ids, scores = best.rows()
        yield pa.record_batch([pa.array(np.array(q_ids, np.int64)[at]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    given = vectors.filter(F.col("vector").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "vector")
    small_batches(spark)
    return _ranked(given.mapInArrow(lean(run), schema), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def in_blocks(queries: DataFrame, vectors: DataFrame, k: int, metric: str) -> DataFrame:
    """Blocks of queries against blocks of vectors, the best k of each block; the work is the matrix product, not a row for each pair."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for qi, qn, qd, vi, vn, vd in zip(*(b.column(c).to_pylist() for c in ("q_ids", "q_n", "q_data", "ids", "n", "data")), strict=True):
                q, v = np.frombuffer(qd).reshape(qn, -1), np.frombuffer(vd).reshape(vn, -1)
                if q.shape[1] != v.shape[1]:
                    raise ValueError(f"vectors from {vi[0]} on have other than {q.shape[1]} numbers")
                best = Best(qn, k)
                best.add(np.arange(qn), np.array(vi, np.int64), similarity(q, v, metric))
                at, ids, scores = best.rows()
                yield pa.record_batch([pa.array(np.array(qi, np.int64)[at]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    q = blocks(queries, "query_id", "vector").select(F.col("ids").alias("q_ids"), F.col("n").alias("q_n"), F.col("data").alias("q_data"))
    return q.crossJoin(blocks(vectors, "vec_id", "vector")).mapInArrow(run, "query_id long, vec_id long, score double")


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """Counts of the text's terms in `dims` hash buckets, on the JVM: runs of the sorted buckets. `embedding.Model` is the slot for any other model."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    buckets = F.array_sort(F.transform(words, lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 6), 16, 10).cast("int") % dims))
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    starts = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull())
    runs = lambda s, at: F.map_from_entries(F.transform(at, lambda a, i: F.struct(F.get(s, a), (F.coalesce(F.get(at, i + 1), F.size(s)) - a).cast("double"))))
    spread = lambda m: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)))
    return let(buckets, lambda s: let(starts(s), lambda at: let(runs(s, at), spread)))
