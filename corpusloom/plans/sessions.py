"""Queries over events as session checkpoints: thread = user_id, created_at = ts, metadata = props."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions as W
from .registry import query, table


def rows(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("thread_id"), F.col("event_id").alias("checkpoint_id"), F.col("ts").alias("created_at"), F.col("props").alias("metadata"), "event_type")


_R = "WITH r AS (SELECT user_id AS thread_id, event_id AS checkpoint_id, ts AS created_at, props AS metadata, event_type FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY created_at DESC, checkpoint_id DESC) AS n FROM r), lim AS (SELECT max(created_at) - INTERVAL 7 DAY AS cutoff FROM r)"


def cutoff(spark, d):
    return F.lit(table(spark, d, "events").agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("c")).first()["c"]).cast("timestamp_ntz")


@query(f"{_R} SELECT r.thread_id, count(*) AS n, min(created_at) AS first_at, max(created_at) AS last_at, arg_max(metadata, (created_at, checkpoint_id)) AS metadata FROM r GROUP BY ALL")
def session_summary(spark, d):
    return W.summary(rows(spark, d))


@query(f"{_R} SELECT thread_id, checkpoint_id FROM n, lim WHERE n <= 5 OR created_at >= cutoff")
def session_prune(spark, d):
    return W.prune(rows(spark, d), 5, cutoff(spark, d)).select("thread_id", "checkpoint_id")


@query(f"{_R} SELECT thread_id, checkpoint_id FROM n WHERE n <= 10")
def session_cap(spark, d):
    return W.cap(rows(spark, d), 10).select("thread_id", "checkpoint_id")


@query(f"{_R} SELECT thread_id, checkpoint_id, lag(checkpoint_id) OVER (PARTITION BY thread_id ORDER BY created_at, checkpoint_id) AS parent_id FROM r")
def session_parents(spark, d):
    return W.parents(rows(spark, d)).select("thread_id", "checkpoint_id", "parent_id")


@query(f"{_R} SELECT thread_id, checkpoint_id, metadata AS state FROM n WHERE n = 1")
def session_latest(spark, d):
    return W.latest(rows(spark, d))


@query(f"{_R}, c AS (SELECT thread_id, max(created_at) AS cursor FROM r GROUP BY ALL) SELECT thread_id, checkpoint_id FROM (SELECT r.*, row_number() OVER (PARTITION BY thread_id ORDER BY created_at DESC, checkpoint_id DESC) AS k FROM r JOIN c USING (thread_id) WHERE created_at < cursor) WHERE k <= 3")
def session_page(spark, d):
    r = rows(spark, d)
    return W.page(r, r.groupBy("thread_id").agg(F.max("created_at").alias("cursor")), 3).select("thread_id", "checkpoint_id")


@query(f"{_R} SELECT thread_id, n, last_at FROM (SELECT thread_id, count(*) AS n, max(created_at) AS last_at FROM r GROUP BY ALL) ORDER BY last_at DESC, thread_id LIMIT 20 OFFSET 10")
def session_list(spark, d):
    return W.summary(rows(spark, d)).select("thread_id", "n", "last_at").orderBy(F.desc("last_at"), "thread_id").offset(10).limit(20)


@query("SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def audit_tail(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", "event_type", "value")


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def activity_tail(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def events_props_json(spark, d):
    """State to a struct, to JSON and back."""
    once = F.from_json("props", "k bigint")
    return table(spark, d, "events").select("event_id", F.from_json(F.to_json(once), "k bigint")["k"].alias("k"))


@query("SELECT date_trunc('minute', ts) AS minute, CAST(sum(len(props)) AS BIGINT) AS tokens, sum(len(props)) > 1000000 AS over FROM events GROUP BY ALL")
def tokens_per_minute(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "60 seconds").alias("w")).agg(F.sum(F.length("props")).alias("tokens"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("minute"), "tokens", (F.col("tokens") > 1000000).alias("over"))


@query("""SELECT event_id AS checkpoint_id, event_id AS turn, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id + 1 AS nested, 'q"' || user_id AS tag, CAST(NULL AS VARCHAR) AS parent, TRUE AS same, 'OBJECT<history: ARRAY<ARRAY<BIGINT>>, parent: VOID, tags: ARRAY<STRING>, turn: OBJECT<id: BIGINT, props: OBJECT<k: BIGINT>>>' AS kind FROM events""")
def state_variant(spark, d):
    """States of any depth as VARIANT: nested objects, lists and nulls to JSON and back, asked by path."""
    e = table(spark, d, "events")
    n = F.col("event_id")
    turn = F.struct(n.cast("long").alias("id"), F.parse_json("props").alias("props"))
    state = F.struct(turn.alias("turn"), F.array(F.array(n - 1, n), F.array(n + 1)).alias("history"), F.array(F.lit("a"), F.concat(F.lit('q"'), F.col("user_id").cast("string"))).alias("tags"), F.lit(None).cast("string").alias("parent"))
    rows = e.select(n.alias("checkpoint_id"), F.to_json(state, {"ignoreNullFields": "false"}).alias("state"))
    v = W.round_trip(rows)
    at = lambda path, kind: F.try_variant_get("back", path, kind)
    return v.select("checkpoint_id", at("$.turn.id", "bigint").alias("turn"), at("$.turn.props.k", "bigint").alias("k"), at("$.history[1][0]", "bigint").alias("nested"), at("$.tags[1]", "string").alias("tag"), at("$.parent", "string").alias("parent"), "same", F.schema_of_variant("back").alias("kind"))
