"""Session histories: rows (thread_id, checkpoint_id, created_at, ...). Newest means latest created_at, then largest id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _newest() -> Window:
    return Window.partitionBy("thread_id").orderBy(F.desc("created_at"), F.desc("checkpoint_id"))


def summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("thread_id").agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.max_by("metadata", F.struct("created_at", "checkpoint_id")).alias("metadata"))


def prune(rows: DataFrame, keep_last: int, cutoff: Column) -> DataFrame:
    """Without rows older than the cutoff that aren't among the newest keep_last of their thread."""
    return rows.withColumn("_n", F.row_number().over(_newest())).filter((F.col("_n") <= keep_last) | (F.col("created_at") >= cutoff)).drop("_n")


def cap(rows: DataFrame, most: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(_newest())).filter(F.col("_n") <= most).drop("_n")


def parents(rows: DataFrame) -> DataFrame:
    return rows.withColumn("parent_id", F.lag("checkpoint_id").over(Window.partitionBy("thread_id").orderBy("created_at", "checkpoint_id")))


def latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("thread_id").agg(F.max_by("metadata", F.struct("created_at", "checkpoint_id")).alias("state"), F.max(F.struct("created_at", "checkpoint_id")).alias("m")).select("thread_id", F.col("m.checkpoint_id").alias("checkpoint_id"), "state")


def newest(rows: DataFrame) -> DataFrame:
    """thread_id, checkpoint_id, created_at of the newest row, n_turns; of a stream, too, where the state is one row a thread."""
    newest = rows.groupBy("thread_id").agg(F.max(F.struct("created_at", "checkpoint_id")).alias("m"), F.count("*").alias("n_turns"))
    return newest.select("thread_id", "m.checkpoint_id", "m.created_at", "n_turns")


def page(rows: DataFrame, before: DataFrame, limit: int) -> DataFrame:
    """Newest `limit` rows of each thread strictly before its cursor; before: (thread_id, cursor)."""
    d = rows.join(before, "thread_id").filter(F.col("created_at") < F.col("cursor"))
    return cap(d, limit).drop("cursor")


def round_trip(rows: DataFrame) -> DataFrame:
    """rows (state: JSON of any depth, ...) with it as VARIANT `v`, `back` as it comes back from JSON, and whether both are the same; a state that is no JSON is null."""
    d = rows.withColumn("v", F.try_parse_json("state"))
    d = d.withColumn("back", F.try_parse_json(F.to_json("v")))
    return d.withColumn("same", F.to_json("v") == F.to_json("back"))
