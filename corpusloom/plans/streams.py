"""Queries that run as streams; each drains its table and gives back what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import bm25, sessions, store
from ..streaming import jobs
from . import sqltext as S
from .registry import query


@query("SELECT doc_id, length(text) AS n_chars, CASE WHEN length(trim(text)) = 0 THEN 'empty' END AS reject_reason FROM documents")
def stream_ingest_drain(spark, d):
    s = jobs.source(spark, f"{d}/documents.parquet")
    reason = F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) == 0, "empty")
    return jobs.drain(s.select("doc_id", F.length("text").cast("long").alias("n_chars"), reason.alias("reject_reason")))


@query("SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN length(text) > 20000 THEN 'too long' WHEN NOT regexp_matches(text, '[A-Za-z]') THEN 'no letters' END AS reject_reason FROM documents")
def stream_drain_rejects(spark, d):
    """One stream to two tables, accepted rows and rejected ones with their reason."""
    s = jobs.source(spark, f"{d}/documents.parquet").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    reason = F.when(F.trim(text) == "", "empty").when(F.length(text) > 20000, "too long").when(~text.rlike("[A-Za-z]"), "no letters")
    accepted, rejected = jobs.drain_checked(s, reason)
    return accepted.select("doc_id", F.lit(None).cast("string").alias("reject_reason")).unionByName(rejected.select("doc_id", "reject_reason"))


@query("SELECT DISTINCT sha256(text) AS content_hash FROM documents")
def stream_dedup(spark, d):
    s = jobs.source(spark, f"{d}/documents.parquet").select(F.sha2("text", 256).alias("content_hash"))
    return jobs.drain(jobs.dedup(s, ["content_hash"]))


def refreshed(before, batch):
    """Term counts after a batch (doc_id, text), for a table that is kept as one: the old rows of its documents go, all of them, before the new ones come."""
    new = bm25.term_frequency(batch)
    return new if before is None else store.delete_ids(before, batch, "doc_id").unionByName(new)


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({S.bag('text')}) AS term FROM documents) GROUP BY ALL")
def stream_index_refresh(spark, d):
    """Term counts of documents, batch by batch; a document that comes again replaces its rows."""
    s = jobs.source(spark, f"{d}/documents.parquet").select("doc_id", "text")
    return jobs.drain_changes(s, bm25.term_frequency)


@query("SELECT user_id AS thread_id, arg_max(event_id, (ts, event_id)) AS checkpoint_id, CAST(count(*) AS BIGINT) AS n_turns FROM events GROUP BY ALL")
def stream_sessions(spark, d):
    """The newest checkpoint of each thread, kept as state by thread; a batch writes the threads it has only."""
    s = jobs.source(spark, f"{d}/events.parquet").select(F.col("user_id").alias("thread_id"), F.col("event_id").alias("checkpoint_id"), F.col("ts").alias("created_at"))
    return jobs.drain_changes(sessions.newest(s), keys=["thread_id"]).select("thread_id", "checkpoint_id", "n_turns")


@query("SELECT * FROM (SELECT date_trunc('minute', ts) AS start, CAST(sum(event_id) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1) WHERE start + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE")
def stream_per_minute(spark, d):
    """Sums of closed minutes of event time."""
    s = jobs.source(spark, f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return jobs.drain(jobs.per_window(s, "ts", "event_id")).select(F.col("start").cast("timestamp_ntz").alias("start"), "total", "n")


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS BIGINT) AS n_terms FROM documents")
def stream_term_counts(spark, d):
    s = jobs.source(spark, f"{d}/documents.parquet")
    return jobs.drain(s.select("doc_id", F.size(X.bag(F.col("text"))).cast("long").alias("n_terms")))
