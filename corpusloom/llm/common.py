"""Helpers that the training-data operators share: inputs, scratch tables, distributed numbering."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the folder that driver and executors share (`spark.checkpoint.dir`).

    A folder of this machine is set up only where the session names none, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


#: Rows that go to a Python worker at once. A batch is held several times over, off the heap of the JVM and in the worker.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Whole texts pass through Arrow here: batches of the session are kept to ARROW_ROWS, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of Arrow batches whose worker, which Spark keeps for later stages, gives free memory back when a task ends."""

    @wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def give_back() -> None:
    """Memory that Arrow and the C library hold free goes back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def materialise(df: DataFrame, tag: str, codec: str = "zstd", partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = scratch(spark, tag)
    writer = df.write.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a written list of ids that are broadcast at most.
BROADCAST_IDS = 1_000_000


def few_or_shuffled(written: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A written frame, marked for broadcast if it has at most `most` rows."""
    return F.broadcast(written) if written.limit(most + 1).count() <= most else written


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small intermediate (loop state)."""
    scratch(df.sparkSession, "x")
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir"))
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_total(parts: DataFrame, key: str, values: list[str], by: list[str] | None = None) -> DataFrame:
    """Exclusive running totals of `values` over `key`, within `by`.

    `parts` has one row for a partition (times a queue), so it stays small while the rows it
    stands for are numbered in parallel.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*(by or [])).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(key, *(by or []), *[F.coalesce(F.sum(v).over(w), F.lit(0)).cast("long").alias(f"{v}_before") for v in values])


def split_points(df: DataFrame, col: str, n: int) -> list[int]:
    """At most n-1 ascending cut values of a long column that split the rows nearly evenly."""
    qs = [i / n for i in range(1, n)]
    found = df.select(F.percentile_approx(col, qs, 100 * n).alias("q")).first()["q"] if n > 1 else None
    return sorted({int(x) for x in found or []})


def range_number(col: Column, points: list[int]) -> Column:
    """How many of the ascending points are <= col; looked up in two levels, so about 2*sqrt(n) comparisons a row."""
    if not points:
        return F.lit(0)
    step = max(1, int(len(points) ** 0.5))
    rows = [points[i : i + step] for i in range(0, len(points), step)]
    heads = "array(" + ",".join(f"{r[0]}L" for r in rows) + ")"
    nested = "array(" + ",".join("array(" + ",".join(f"{x}L" for x in r) + ")" for r in rows) + ")"
    c = col.cast("long")
    coarse = F.size(F.filter(F.expr(heads), lambda x: x <= c))
    fine = F.size(F.filter(F.element_at(F.expr(nested), F.greatest(coarse, F.lit(1))), lambda x: x <= c))
    return F.when(c.isNull() | (coarse == 0), 0).otherwise((coarse - 1) * step + fine)


def docs_of(docs: DataFrame) -> DataFrame:
    """The columns every operator reads; anything else in the table may clash with working names and stays out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def small_table(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """A few rows of the driver's as a frame, by Arrow: rows as Python objects would start Python workers of another kind on the executors."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return spark.createDataFrame(pa.table(columns, schema=to_arrow_schema(_parse_datatype_string(schema))))
