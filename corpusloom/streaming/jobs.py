"""Streaming jobs that drain what is there (availableNow) into Parquet and give back what they wrote."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_folder


def source(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """A folder or file of Parquet as a stream."""
    glob = f"{path[:-1]}[{path[-1]}]"  # a pattern takes a single file as well as a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_at_once).parquet(glob)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def large_state(spark: SparkSession) -> Iterator[None]:
    """Queries started here keep their state on disk, in RocksDB; a running query keeps the store that it began with.

    For state beyond the executors' memory. A store takes some 4 MB of disk for each partition, however small it is.
    """
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drain(stream: DataFrame, at: str | None = None, large: bool = False) -> DataFrame:
    """Append all that the stream has; the checkpoint makes each input count once, also when it is called again with the same `at`. `large`: as in `large_state`; else the session's store."""
    spark = stream.sparkSession
    at = at or shared_folder(spark, "stream")
    with large_state(spark) if large else nullcontext():
        q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def drain_changes(stream: DataFrame, change: Callable[[DataFrame], DataFrame] | None = None, keys: list[str] | None = None, at: str | None = None, large: bool = False) -> DataFrame:
    """Drain a stream of changes to a keyed table, and give the table: for each key the rows of the last batch that had it.

    A batch appends its own rows, and the keys that it touched, under its number, so its work is in proportion to the batch; one that is run again overwrites its
    own. `change` makes rows of a batch (its keys with none are gone from the table); without it the batch itself is taken. Called again with the same `at`, it goes on from there.
    """
    spark = stream.sparkSession
    at = at or shared_folder(spark, "stream")
    keys = keys or stream.columns[:1]

    def each(batch: DataFrame, number: int) -> None:
        batch.select(*keys).distinct().write.mode("overwrite").parquet(f"{at}/touched/batch={number}")
        (change(batch) if change else batch).write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    with large_state(spark) if large else nullcontext():
        q = stream.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    last = spark.read.parquet(f"{at}/touched").groupBy(*keys).agg(F.max("batch").alias("batch"))
    rows = spark.read.parquet(f"{at}/rows")
    return rows.join(last, [*keys, "batch"], "left_semi").drop("batch")


def staged(spark: SparkSession, folder: str, archive: str | None = None, files_at_once: int = 100) -> DataFrame:
    """Uploaded files of a folder (path, modificationTime, length, content) as a stream. With `archive` a file is moved there once its batch is committed."""
    reader = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_at_once)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.schema("path string, modificationTime timestamp, length long, content binary").load(folder)


def drain_checked(stream: DataFrame, reason: Column, at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of a stream that are accepted, and those that aren't, with `reject_reason`; `reason` gives null for the former.

    A batch is gone through once: it writes both kinds below its own number, so one that is run again after a failure writes the same again and doubles nothing. Called
    again with the same `at` it goes on with what is new. A row that can't be judged (the reason fails) is no exception that stops the run: use try_ functions in `reason`.
    """
    spark = stream.sparkSession
    at = at or shared_folder(spark, "stream")
    given = T.StructType([*stream.schema.fields, T.StructField("reject_reason", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("batch", T.LongType())])

    def each(batch: DataFrame, number: int) -> None:
        judged = batch.withColumn("reject_reason", reason)
        judged.withColumn("verdict", F.when(F.col("reject_reason").isNull(), "accepted").otherwise("rejected")).write.mode("overwrite").partitionBy("verdict").parquet(f"{at}/out/batch={number}")

    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(given).option("basePath", f"{at}/out").parquet(f"{at}/out").drop("batch")
    return rows.filter("verdict = 'accepted'").drop("verdict", "reject_reason"), rows.filter("verdict = 'rejected'").drop("verdict")


def dedup(stream: DataFrame, keys: list[str]) -> DataFrame:
    """First row of each key, in whatever order rows come: the state holds every key, nothing is too late and nothing forgotten."""
    return stream.dropDuplicates(keys)


def per_window(stream: DataFrame, time: str, value: str, window: str = "60 seconds", late: str = "1 minute") -> DataFrame:
    """Totals of windows that are closed: those that end no later than the newest time less `late`. Rows that come up to `late` behind the newest are counted."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.sum(value).alias("total"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "total", "n")
