"""Arrow batches of texts in Python workers: few rows at once, and free memory given back when a task ends."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

from pyspark.sql import SparkSession

#: Rows that go to a Python worker at once.
ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Batches of the session are kept to ROWS, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS:
        spark.conf.set(key, ROWS)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of Arrow batches whose worker, which Spark keeps for later tasks, gives free memory back when a task ends."""

    @wraps(run)
    def inner(batches):
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
            if trim:
                trim(0)

    return inner
