"""Tables of records keyed by id: upserts, deletes, fetches, statistics. Each takes and gives DataFrames; `write_partitions` stores them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Last write of each key: new over old, in `new` the row with the largest `order`."""
    d = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), *([F.desc(order)] if order else []))
    return d.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def delete_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    return rows.filter(~F.coalesce(condition, F.lit(False)))


def fetch(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def non_zero(vectors: DataFrame, col: str) -> DataFrame:
    return vectors.filter(F.exists(col, lambda x: x != 0))


def namespace_stats(vectors: DataFrame, vector: str) -> DataFrame:
    return vectors.groupBy("namespace").agg(F.count("*").alias("n_vectors"), F.max(F.size(vector)).alias("dimension"))


def write_partitions(rows: DataFrame, path: str, by: str = "namespace") -> None:
    """Overwrite only the partitions that `rows` has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
