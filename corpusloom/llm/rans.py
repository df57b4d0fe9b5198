"""Token-id files coded with a static range asymmetric numeral system.

One frequency table, counted over all ids, is shared by all blocks. A block holds whole documents,
codes its ids in interleaved lanes, keeps the lanes' states at checkpoints, so that it can be
decoded from any of them, and carries a checksum of ids and of coded bytes. A folder holds all that a reader
needs: `blocks` (rows of a Parquet dataset, which gives every file system and lost executor what Spark's
commit gives), `table` (id, frequency) and `meta` (tokenizer's name, end id, precision, vocabulary).

Null or empty text: only the end id. Repeated doc_ids stay rows of their own, side by side; null doc_ids come first.
Empty table: no rows. Very long texts make a block of their own. Other columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import docs_of, lean, materialise, range_number, running_total, scratch, shuffle_partitions, small_table, split_points, table
from .packing import BROADCAST_BASES, tokenise
from .tokens import default_path, encoder, utf8_parts

PRECISION = 20
LANES = 1024
BLOCK_TOKENS = 262_144
CHECKPOINT_STEPS = 128
MAGIC = b"LRN1"
_HEAD = struct.Struct("<4s7I")
_LOW = np.uint64(1 << 31)

META = "tokenizer string, end_id int, precision int, vocabulary int"
BLOCKS = "part int, first_seq long, n_docs long, n_tokens long, payload binary"
READ = "part int, first_seq long, doc_id long, local_start long, n_tokens long, ids_crc32 long"


@dataclass
class Table:
    """Frequencies that sum to 2**PRECISION; every counted id has at least one slot."""

    freq: np.ndarray
    cum: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        counts = counts.astype(np.float64)
        seen = np.flatnonzero(counts)
        freq = np.zeros(len(counts), np.int64)
        if len(seen):
            room = (1 << PRECISION) - len(seen)
            share = counts[seen] / counts.sum() * room
            f = 1 + np.floor(share).astype(np.int64)
            rest = (1 << PRECISION) - int(f.sum())
            f[np.argsort(np.floor(share) - share, kind="stable")[:rest]] += 1
            freq[seen] = f
        return cls(freq.astype(np.uint64), np.concatenate(([0], np.cumsum(freq))).astype(np.uint64))

    def symbols(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))


def encode_block(ids: np.ndarray, doc_ids: list[int | None], sizes: list[int], t: Table, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> bytes:
    n = len(ids)
    steps = -(-n // lanes)
    state = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, bytes]] = []
    emitted = 0
    shift, low32, wide = np.uint64(31 - PRECISION + 32), np.uint64(0xFFFFFFFF), np.uint64(32)
    for s in range(steps - 1, -1, -1):
        x = ids[s * lanes : (s + 1) * lanes]
        k = len(x)
        f, c = t.freq[x], t.cum[x]
        st = state[:k]
        full = st >= (f << shift)
        if full.any():
            out = (st[full] & low32).astype("<u4")
            words.append(out)
            emitted += len(out)
            st = np.where(full, st >> wide, st)
        q, r = np.divmod(st, f)
        state[:k] = (q << np.uint64(PRECISION)) + r + c
        if s % every == 0:
            marks.append((emitted, state.astype("<u8").tobytes()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    marks.reverse()
    places = np.array([len(stream) - e for e, _ in marks], "<u4").tobytes()
    known = np.array([d is not None for d in doc_ids], np.uint8).tobytes()
    docs = zlib.compress(known + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(sizes, "<u4").tobytes(), 1)
    body = docs + places + b"".join(m for _, m in marks) + stream.tobytes()
    check = zlib.crc32(ids.astype("<u4"))
    return _HEAD.pack(MAGIC, n, len(sizes), lanes, every, len(docs), zlib.crc32(body), check) + body


def decode_block(payload: bytes, t: Table, symbols: np.ndarray, from_mark: int = 0, marks: int | None = None) -> tuple[np.ndarray, list[int | None], list[int]]:
    """ids from checkpoint `from_mark` on (of `marks` checkpoints, by default all), doc_ids and sizes."""
    magic, n, n_docs, lanes, every, len_docs, body_check, check = _HEAD.unpack_from(payload)
    body = memoryview(payload)[_HEAD.size :]
    if magic != MAGIC or zlib.crc32(body) != body_check:
        raise ValueError("the block is damaged")
    raw = zlib.decompress(body[:len_docs])
    known = np.frombuffer(raw, np.uint8, n_docs)
    doc_ids = [int(d) if k else None for k, d in zip(known, np.frombuffer(raw, "<i8", n_docs, n_docs), strict=True)]
    sizes = np.frombuffer(raw, "<u4", n_docs, 9 * n_docs).tolist()
    steps = -(-n // lanes)
    n_marks = -(-steps // every)
    places = np.frombuffer(body, "<u4", n_marks, len_docs)
    at = len_docs + 4 * n_marks
    states = np.frombuffer(body, "<u8", n_marks * lanes, at).reshape(n_marks, lanes)
    stream = np.frombuffer(body, "<u4", -1, at + 8 * n_marks * lanes) if n else np.zeros(0, "<u4")
    last = n_marks if marks is None else min(n_marks, from_mark + marks)
    out = np.empty(max(0, min(n, last * every * lanes) - from_mark * every * lanes), np.uint32)
    if len(out):
        state, pos = states[from_mark].astype(np.uint64), int(places[from_mark])
        slot_mask, bits, wide, done = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION), np.uint64(32), 0
        for s in range(from_mark * every, min(steps, last * every)):
            k = min(lanes, n - s * lanes)
            st = state[:k]
            slot = st & slot_mask
            x = symbols[slot]
            st = t.freq[x] * (st >> bits) + slot - t.cum[x]
            need = st < _LOW
            m = int(np.count_nonzero(need))
            if m:
                st[need] = (st[need] << wide) | stream[pos : pos + m]
                pos += m
            state[:k] = st
            out[done : done + k] = x
            done += k
    if from_mark == 0 and last == n_marks and zlib.crc32(out.astype("<u4")) != check:
        raise ValueError("the block's ids don't fit their checksum")
    return out, doc_ids, sizes


def count_ids(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """Counts over all ids; bounded by the vocabulary."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            n = sum(b.column("n_tokens").to_pylist())
            if n:
                raw, _ = utf8_parts(b.column("ids"))
                total += np.bincount(raw.view(f"<u{len(raw) // n}"), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    rows = tokens.select("ids", "n_tokens").mapInArrow(lean(run), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocabulary, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def in_order(tokens: DataFrame) -> DataFrame:
    """Rows with `part` and `seq` such that (part, seq) ascends with doc_id, nulls first.

    Input files that already follow each other by doc_id are kept; others are dealt by ranges of doc_id.
    """
    spark = tokens.sparkSession
    w = Window.partitionBy("part").orderBy("seq")
    steps = tokens.select("part", "seq", "doc_id").withColumn("last", F.lag("doc_id").over(w))
    spans = steps.groupBy("part").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.bool_and(F.coalesce(F.col("last") <= F.col("doc_id"), F.col("seq") == 0)).alias("up"), F.count("*").alias("n"), F.count("doc_id").alias("known"))
    spans = materialise(spans, "rans-spans")
    many = spans.limit(BROADCAST_BASES + 1).count() > BROADCAST_BASES
    byrange = Window.orderBy("lo")  # one row for each input partition, checked
    bad = many or spans.withColumn("prev", F.max("hi").over(byrange.rowsBetween(Window.unboundedPreceding, -1))).withColumn("rank", F.row_number().over(byrange)).select(F.max(F.when(~F.col("up") | (F.col("n") > F.col("known")) | (F.col("prev") >= F.col("lo")), 1).otherwise(0)).alias("bad")).first()["bad"]
    if not bad:
        ranks = spans.select("part", (F.row_number().over(byrange) - 1).alias("rank"))
        return tokens.join(F.broadcast(ranks), "part").select(F.col("rank").cast("int").alias("part"), "seq", "doc_id", "n_tokens", "ids")
    points = split_points(tokens, "doc_id", shuffle_partitions(spark))
    dealt = tokens.select(range_number(F.col("doc_id"), points).cast("int").alias("part"), F.lit(-1).cast("long").alias("seq"), "doc_id", "n_tokens", "ids")
    return dealt.repartition(shuffle_partitions(spark), "part").sortWithinPartitions("part", "doc_id")


def write_blocks(rows: DataFrame, t: Table, folder: str, block_tokens: int = BLOCK_TOKENS) -> None:
    """Rows in order to a dataset of blocks in the folder."""

    def run(batches):
        import pyarrow as pa

        ids: list[bytes] = []
        docs: list[int | None] = []
        sizes: list[int] = []
        key, filled, seen = None, 0, 0

        def block():
            x = np.concatenate([np.frombuffer(r, f"<u{len(r) // n}").astype(np.int64) for r, n in zip(ids, sizes, strict=True)])
            out = pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([len(docs)], pa.int64()), pa.array([len(x)], pa.int64()), pa.array([encode_block(x, docs, sizes, t)], pa.binary())], names=["part", "first_seq", "n_docs", "n_tokens", "payload"])
            ids.clear(), docs.clear(), sizes.clear()
            return out

        for b in batches:
            for part, seq, doc, n, raw in zip(*(b.column(c).to_pylist() for c in ("part", "seq", "doc_id", "n_tokens", "ids")), strict=True):
                if docs and (part != key[0] or filled >= block_tokens):
                    yield block()
                if not docs:
                    seen = 0 if key is None or key[0] != part else seen
                    key, filled = (part, seq if seq >= 0 else seen), 0
                ids.append(raw), docs.append(doc), sizes.append(n)
                filled, seen = filled + n, seen + 1
        if docs:
            yield block()

    rows.mapInArrow(lean(run), BLOCKS).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def read_blocks(blocks: DataFrame, t: Table) -> DataFrame:
    """Documents read back: ids before them in their block, number and checksum of their ids."""

    def run(batches):
        import pyarrow as pa

        symbols = t.symbols()
        for b in batches:
            for part, first, payload in zip(*(b.column(c).to_pylist() for c in ("part", "first_seq", "payload")), strict=True):
                x, docs, sizes = decode_block(payload, t, symbols)
                x = x.astype("<u4")
                ends = np.cumsum(sizes)
                starts = ends - np.array(sizes)
                yield pa.record_batch([pa.array([part] * len(docs), pa.int32()), pa.array([first] * len(docs), pa.int64()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x[i:j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())], names=["part", "first_seq", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    return blocks.select("part", "first_seq", "payload").mapInArrow(lean(run), READ)


def write_ids(docs: DataFrame, path: str, folder: str, end_id: int = 1, lower_words: bool = True) -> None:
    """Writes the ids of all documents (doc_id, text) in ascending doc_id order, and what it takes to read them, to the folder."""
    spark = docs.sparkSession
    raw = tokenise(docs_of(docs).withColumn("queue", F.lit(0)), path, end_id, lower_words)

    tokens = materialise(raw.select("part", "seq", "doc_id", "n_tokens", "ids"), "rans-tokens")
    vocabulary = max(encoder(path, lower_words).vocabulary, end_id + 1)
    t = Table.of(count_ids(tokens, vocabulary))
    write_blocks(in_order(tokens), t, folder)
    used = np.flatnonzero(t.freq)
    small_table(spark, {"id": used.tolist(), "freq": t.freq[used].tolist()}, "id int, freq long").coalesce(1).write.parquet(f"{folder}/table")
    small_table(spark, {"tokenizer": [os.path.basename(path)], "end_id": [end_id], "precision": [PRECISION], "vocabulary": [vocabulary]}, META).coalesce(1).write.parquet(f"{folder}/meta")


def read_table(spark: SparkSession, folder: str) -> Table:
    """The frequency table as the folder has it; at most one row for each id of the vocabulary."""
    meta = spark.read.schema(META).parquet(f"{folder}/meta").first()
    if meta["precision"] != PRECISION:
        raise ValueError(f"frequencies of {meta['precision']} bits can't be read")
    freq = np.zeros(meta["vocabulary"], np.int64)
    for r in spark.read.schema("id int, freq long").parquet(f"{folder}/table").collect():
        freq[r["id"]] = r["freq"]
    return Table(freq.astype(np.uint64), np.concatenate(([0], np.cumsum(freq))).astype(np.uint64))


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of a folder, from its files alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    rows = read_blocks(blocks, read_table(spark, folder)).join(starts_of(blocks), ["part", "first_seq"])
    return rows.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def starts_of(blocks: DataFrame) -> DataFrame:
    """Ids before each block: totals of parts first, then of the blocks in a part."""
    parts = running_total(blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")), "part", ["n"])
    w = Window.partitionBy("part").orderBy("first_seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = blocks.select("part", "first_seq", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)).alias("inside"))
    return inside.join(parts, "part").select("part", "first_seq", (F.col("inside") + F.col("n_before")).alias("base"))


def op9_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "rans-files")
    write_ids(table(spark, sf_dir, "documents"), default_path("word_bpe_49k.json"), folder)
    return read_ids(spark, folder)
