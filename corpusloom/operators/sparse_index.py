"""The sparse index as stored tables: postings, term statistics, and a manifest that names the builds.

Postings are bucketed by a shard of documents (a hash of doc_id) and sorted by term in each, one file a bucket. A query's terms are broadcast with their weights,
each shard is scored on its own, and its best k leave it: neither postings nor single hits are shuffled, a term that many documents have is in all shards, and the
work of a query grows with shards, not with hits. Queries with more terms than are broadcast are taken in blocks. Terms' statistics are bucketed by term.

A build writes its tables under a name of its own and, last, its row of the manifest; a reader takes the newest build, so one that broke off
is never seen. Null texts are documents without terms. Rows without a doc_id
take no part. Rows that share a doc_id and a length are one document. No documents: an index without postings.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written
from . import bm25

#: Terms of queries (one row for each query and term) that are broadcast at once.
BROADCAST_TERMS = 500_000

MANIFEST = "build string, built_at timestamp, buckets int, n_docs long, avgdl double"
COLUMNS = {"postings": "shard int, term string, doc_id long, tf int, dl int", "terms": "term string, df long, n long"}
BUCKETED = {"postings": "shard", "terms": "term"}
#: Bytes of text that a bucket holds about; more text makes more buckets, so that a task's sort stays as large.
BUCKET_BYTES = 16_000_000
#: Queries with no more distinct terms have them looked up in the files' statistics.
PUSHED_TERMS = 10


class IndexNotFound(LookupError):
    pass


def _table(spark: SparkSession, path: str, build: str, kind: str, buckets: int) -> DataFrame:
    """The stored table, under a name of this session's catalog that knows its buckets."""
    name = f"sparse_index_{build}_{kind}"
    if not spark.catalog.tableExists(name):
        at = f"{path}/{build}/{kind}".replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({COLUMNS[kind]}) USING parquet CLUSTERED BY ({BUCKETED[kind]}) INTO {buckets} BUCKETS LOCATION '{at}'")
    return spark.table(name)


def _store(rows: DataFrame, path: str, build: str, kind: str, buckets: int) -> DataFrame:
    # rows come sorted by term, by its first bytes; a sort by bucket and term would compare whole rows
    rows.sortWithinPartitions("term").write.bucketBy(buckets, BUCKETED[kind]).format("parquet").option("path", f"{path}/{build}/{kind}").saveAsTable(f"sparse_index_{build}_{kind}")
    return _table(rows.sparkSession, path, build, kind, buckets)


def build(docs: DataFrame, path: str, buckets: int | None = None) -> str:
    """Index docs (doc_id, text) below `path`; gives the build's name. `buckets`: one for each BUCKET_BYTES of text, at least as many as shuffle partitions, unless given."""
    spark = docs.sparkSession
    if not buckets:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    name = uuid.uuid4().hex
    d = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # texts are dealt to the shards; terms are counted there in each document's row, without a shuffle or a grouping
    dealt = d.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")).repartition(buckets, "shard")
    tf = bm25.runs(dealt, "shard").withColumn("tf", F.col("tf").cast("int"))
    if bm25.repeated(d):
        tf = tf.groupBy("shard", "doc_id", "dl", "term").agg(F.sum("tf").cast("int").alias("tf"))
    postings = _store(tf.select("shard", "term", "doc_id", "tf", "dl"), path, name, "postings", buckets)
    terms = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))
    _store(terms.repartition(buckets, "term"), path, name, "terms", buckets)
    n_docs = d.agg(F.count("*").alias("n_docs"))
    length = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("length"))
    facts = n_docs.join(F.broadcast(length)).withColumn("avgdl", F.col("length") / F.greatest("n_docs", F.lit(1)))  # one row each
    facts.select(F.lit(name).alias("build"), F.current_timestamp().alias("built_at"), F.lit(buckets).alias("buckets"), "n_docs", "avgdl").write.mode("append").parquet(f"{path}/manifest")
    return name


class SparseIndex:
    def __init__(self, spark: SparkSession, path: str, build: str, buckets: int, n_docs: int, avgdl: float):
        self.n_docs, self.avgdl, self.buckets = n_docs, avgdl, buckets
        self.postings = _table(spark, path, build, "postings", buckets)
        self.terms = _table(spark, path, build, "terms", buckets)


def load(spark: SparkSession, path: str) -> SparseIndex:
    """The newest build below `path`. IndexNotFound if there is none, ValueError naming what a table lacks."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").orderBy(F.desc("built_at"), "build").limit(1).collect()
    except AnalysisException:
        rows = []
    if not rows:
        raise IndexNotFound(f"no index at {path}; build one first")
    found = rows[0]
    for kind, columns in COLUMNS.items():
        try:
            there = set(spark.read.parquet(f"{path}/{found['build']}/{kind}").columns)
        except AnalysisException as e:
            if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":  # a table without rows has no files
                continue
            raise ValueError(f"the index at {path} lacks its table {kind}; build it again") from e
        lacking = {c.split()[0] for c in columns.split(", ")} - there
        if lacking:
            raise ValueError(f"the table {kind} of the index at {path} lacks {', '.join(sorted(lacking))}; build it again")
    return SparseIndex(spark, path, found["build"], found["buckets"], found["n_docs"], found["avgdl"])


def scored(index: SparseIndex, asked: DataFrame) -> DataFrame:
    """shard, query_id, doc_id, score of the documents that have terms in `asked` (query_id, term, n, idf), which is broadcast. Weights have six decimals and are summed as whole numbers."""
    weight = F.col("idf") * (F.col("tf") * (bm25.K1 + 1)) / (F.col("tf") + bm25.K1 * (1 - bm25.B + bm25.B * F.col("dl") / F.lit(index.avgdl)))
    few = [r["term"] for r in asked.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    postings = index.postings.filter(F.col("term").isin(few)) if len(few) <= PUSHED_TERMS else index.postings
    hit = postings.join(F.broadcast(asked), "term").select("shard", "query_id", "doc_id", (F.floor(weight * 1e6 + 0.5) * F.col("n")).alias("weight"))
    return hit.groupBy("shard", "query_id", "doc_id").agg((F.sum("weight") / 1e6).alias("score")).filter("score > 0")


def top_hits(index: SparseIndex, queries: DataFrame, k: int, allowed: DataFrame | None = None, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """query_id, doc_id, score, rank of the best k documents of each query (query_id, text), of the `allowed` (doc_id) only, if given."""
    asked = bm25.terms(queries, "query_id").groupBy("query_id", "term").agg(F.count("*").alias("n"))
    idf = F.ln((index.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    asked = written(asked.join(index.terms, "term").select("query_id", "term", asked["n"].alias("n"), idf.alias("idf")), "index-asked")
    blocks = max(1, -(-asked.count() // broadcast_terms))
    out = None
    for b in range(blocks):
        s = scored(index, asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b))
        if allowed is not None:
            s = s.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
        best = bm25.top(s.select("query_id", "doc_id", "score"), k)
        out = best if out is None else out.unionByName(best)
    return out
