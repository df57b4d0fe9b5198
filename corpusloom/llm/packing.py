"""Mixture-controlled packing.

Every source is a queue of tokens. A window of `window_tokens` takes from each queue its quantum,
target share times window; what a quantum leaves below a whole token stays with the queue as its
deficit and counts in the next window, so after any number of windows a queue is within one token
of its target, and a window that starts in one partition ends in another. When a queue runs dry, the
others share its quantum from the next window on. Windows follow one another without a gap and are cut into
sequences, so only the last sequence needs padding.

Round-robin with carried deficits has a closed form (what queue q has given before window w), so
no task needs another's state: documents are tokenised once into a shared table, queues are
numbered by partition totals, and each task cuts its own documents.

Every source has a queue, however many there are: windows are at least `LEAST_QUANTUM` tokens long for each source, so
that a mean quantum is worth a piece. The driver and the tasks hold one total for each source.

Null or empty text: one piece with the end id. Very long text: as many pieces as it needs; a task holds its ids whole. Empty table: no rows.
Null source: a source of its own, beside the empty one. Ties, that is repeated rows and equal doc_ids: packed as often as they
occur, one behind the other. Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, lean, materialise, running_total, small_table, table
from .tokens import binary_column, default_path, encoder, slices

SEQUENCE_TOKENS = 1024
WINDOW_TOKENS = 64 * SEQUENCE_TOKENS
#: Tokens that a window has for each source at least.
LEAST_QUANTUM = 1024

#: Bytes of text that a worker tokenises at once (or one longer text); it takes about 20 times as many.
TOKENISED_AT_ONCE = 2_000_000

#: Rows (one for each partition and queue, 16 bytes) that are broadcast at most; more are joined by a shuffle.
BROADCAST_BASES = 500_000

TOKENS = "doc_id long, queue int, part int, seq long, local_start long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue int"


class Schedule:
    """What each queue has given before a window; at most one phase for each queue that runs dry."""

    def __init__(self, totals: list[int], weights: list[float], window: int):
        self.totals = np.array(totals, np.float64)
        w = np.array(weights, np.float64)
        at, given, self.starts, self.phases = 0, np.zeros(len(totals)), [], []
        while (given < self.totals).any():
            live = (given < self.totals) & (w > 0)
            if not live.any():  # queues without a target come last, by size
                w = np.where(given < self.totals, self.totals, 0)
                live = w > 0
            rate = np.where(live, w, 0) / w[live].sum() * window
            self.starts.append(at)
            self.phases.append((at, given, rate))
            left = (self.totals - given)[live] / rate[live]
            at += max(1, int(np.ceil(left.min() - 1e-9)))
            given = self.before(at)

    def before(self, window: int) -> np.ndarray:
        at, given, rate = self.phases[max(0, bisect_right(self.starts, window) - 1)]
        return np.minimum(self.totals, np.floor(given + (window - at) * rate + 1e-6))

    def window_of(self, queue: int, position: int) -> int:
        k = bisect_right([p[1][queue] for p in self.phases], position) - 1
        at, given, rate = self.phases[k]
        w = at + int((position - given[queue]) / rate[queue]) if rate[queue] else at
        while self.before(w)[queue] > position:
            w -= 1
        while self.before(w + 1)[queue] <= position:
            w += 1
        return w


def queue_of(docs: DataFrame) -> tuple[DataFrame, list[str | None]]:
    """docs with a number for each source in `queue`, and the sources in that order. Null is a source of its own."""
    named = docs.withColumn("source", F.col("source").cast("string"))
    names = [r[0] for r in named.select("source").distinct().orderBy(F.col("source").asc_nulls_first()).collect()]
    numbers = small_table(docs.sparkSession, {"_source": names, "queue": list(range(len(names)))}, "_source string, queue int")
    numbers = F.broadcast(numbers) if len(names) <= BROADCAST_BASES else numbers
    return named.join(numbers, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), names


def tokenise(docs: DataFrame, path: str, end_id: int, lower_words: bool = False) -> DataFrame:
    """docs (doc_id, queue, text) to TOKENS; seq numbers a partition's rows; ids as the encoder's little-endian bytes, each text followed by end_id."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, part, given, seen = encoder(path, lower_words), TaskContext.get().partitionId(), {}, 0
        for b in slices(batches, TOKENISED_AT_ONCE):
            ids, sizes = enc.encode(b.column("text"), end_id)
            starts = []
            for q, n in zip(b.column("queue").to_pylist(), sizes.tolist(), strict=True):
                starts.append(given.get(q, 0))
                given[q] = starts[-1] + n
            cells = binary_column(ids.view(np.uint8), np.concatenate([[0], np.cumsum(sizes)]) * enc.dtype.itemsize)
            yield pa.record_batch([b.column("doc_id"), b.column("queue"), pa.array([part] * len(sizes), pa.int32()), pa.array(seen + np.arange(len(sizes))), pa.array(starts, pa.int64()), pa.array(sizes), cells], names=["doc_id", "queue", "part", "seq", "local_start", "n_tokens", "ids"])
            seen += len(sizes)
            del b, ids, cells
            give_back()

    return docs.select("doc_id", "queue", "text").mapInArrow(lean(run), TOKENS)


def pack(docs: DataFrame, path: str, end_id: int = 0, weights: dict[str, float] | None = None, window_tokens: int = WINDOW_TOKENS, sequence_tokens: int = SEQUENCE_TOKENS, least_quantum: int = LEAST_QUANTUM) -> DataFrame:
    """Pieces of all documents (doc_id, source, text) with their places in sequences.

    weights: target share of each source (None for the null one), by default its share of the corpus' tokens.
    """
    spark = docs.sparkSession
    docs, names = queue_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "source"))
    tokens = materialise(tokenise(docs, path, end_id).drop("seq"), "pack-tokens")
    parts = tokens.groupBy("part", "queue").agg(F.sum("n_tokens").alias("n"))
    totals = {r["queue"]: r["n"] for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return spark.createDataFrame([], PIECES)
    sizes = [totals.get(q, 0) for q in range(len(names))]
    share = [float(n) for n in sizes]
    if weights is not None:
        share = [float(weights.get(n, 0.0)) for n in names]
    plan = Schedule(sizes, share, max(window_tokens, least_quantum * len(names)))
    bases = running_total(parts, "part", ["n"], ["queue"]).withColumnRenamed("n_before", "base")
    few = parts.limit(BROADCAST_BASES + 1).count() <= BROADCAST_BASES
    placed = tokens.join(F.broadcast(bases) if few else bases, ["part", "queue"])

    def cut(batches):
        import pyarrow as pa

        known: dict[int, tuple[np.ndarray, int, np.ndarray]] = {}

        def window(w: int) -> tuple[np.ndarray, int, np.ndarray]:
            if w not in known:
                if len(known) * len(names) > 500_000:
                    known.clear()
                a = plan.before(w)
                known[w] = a, int(a.sum()), np.cumsum(plan.before(w + 1) - a)
            return known[w]

        for b in batches:
            out: list[tuple] = []
            for doc, q, local, n, base, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "queue", "local_start", "n_tokens", "base", "ids")), strict=True):
                ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                at, p0 = 0, base + local
                w = plan.window_of(q, p0)
                while at < n:
                    given, start, ends = window(w)
                    first = given[q]
                    stop = int(first + ends[q] - (ends[q - 1] if q else 0))
                    upto = min(n, stop - p0)
                    here = start + (int(ends[q - 1]) if q else 0) - int(first) + p0
                    while at < upto:
                        seq, off = divmod(here + at, sequence_tokens)
                        k = min(upto - at, sequence_tokens - off)
                        out.append((doc, at, k, zlib.crc32(ids[at : at + k]), n, seq, off, q))
                        at += k
                    w += 1
            cols = list(zip(*out, strict=True)) or [[]] * 8
            yield pa.record_batch([pa.array(c, pa.int64() if i < 7 else pa.int32()) for i, c in enumerate(cols)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"])

    return placed.select("doc_id", "queue", "local_start", "n_tokens", "base", "ids").mapInArrow(lean(cut), PIECES)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"))
