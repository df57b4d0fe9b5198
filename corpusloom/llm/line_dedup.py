"""Line dedup with two Bloom filters.

A line's key is the line without white space ([\\x20\\x09-\\x0D]) at its ends, A-Z lower-cased. A key of
at least `min_chars` code points found in at least `min_docs` documents loses its lines everywhere
but in the largest doc_id that holds it.

1. Every task adds the keys of its documents to a once-seen and a twice-seen filter (a key goes to the
   second when the first has it). Filters of tasks are merged segment by segment:
   twice = twice | twice' | once & once'. No key of two documents can be missing from it.
2. Only keys that the merged twice-seen filter holds, the suspected repeats, are shuffled, as
   128-bit digests with their doc_id; counting them confirms repeats exactly and picks the keeper.
3. Confirmed keys are handed to all tasks if there are at most `broadcast_keys`; else the lists of
   dropped keys are joined to the documents by doc_id and text. Keys that stand for a thousandth of all suspects or more
   (at most a thousand keys) are broadcast to that join, so that no key makes a hot task.

Each filter has 8 to 16 bits for each line of the corpus: 0.5 to 3 of 100 lines that occur once are suspected in
error. That holds up to MOST_BITS (128 MB a filter, 134 million lines). Beyond it the share of suspects grows, towards
all lines at some billions of them, and with it the shuffle of digests (32 bytes each); results stay the same.

Null or empty text: one empty line, kept. Very long texts: a task holds a text and its lines. A row is a document; repeated rows and
equal doc_ids count as often as they occur and keep their lines together if their doc_id is the largest; a null doc_id is the smallest.
Empty table: no rows. Other columns pass through, whatever their names; those named like this operator's results are replaced.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, materialise, table
from .tokens import slices

WHITE = " \t\n\x0b\x0c\r"

LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30
SEGMENTS = 64
HASHES = 3
#: Confirmed keys that are handed to all tasks at most (about 100 bytes each in a task).
BROADCAST_KEYS = 250_000


def line_keys(text: str | None, min_chars: int) -> tuple[list[str], list[tuple[int, bytes]]]:
    lines = (text or "").split("\n")
    found = []
    for i, line in enumerate(lines):
        key = line.strip(WHITE)
        if len(key) >= min_chars:
            found.append((i, key.encode().lower()))  # of bytes: A-Z only
    return lines, found


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def places(h: np.ndarray, bits: int) -> np.ndarray:
    """HASHES bit positions for each 64-bit hash, all in one segment: the segment comes from the high bits."""
    per = np.uint64(bits // SEGMENTS)
    base = (h >> np.uint64(58)) % np.uint64(SEGMENTS) * per
    step = (h >> np.uint64(29)) | np.uint64(1)
    return np.stack([base + (h + np.uint64(i) * step) % per for i in range(HASHES)])


def holds(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    p = places(h, bits)
    return ((bitmap[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def add(bitmap: np.ndarray, h: np.ndarray, bits: int) -> None:
    p = places(h, bits).ravel()
    np.bitwise_or.at(bitmap, p >> np.uint64(3), np.left_shift(np.uint8(1), (p & np.uint64(7)).astype(np.uint8)))


def hash64(keys: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def bits_for(docs: DataFrame) -> int:
    """8 to 16 bits for each line."""
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    n = docs.agg(F.sum(lines.cast("long")).alias("n")).first()["n"] or 0
    return min(MOST_BITS, max(LEAST_BITS, 1 << (8 * n - 1).bit_length() if n else 0))


def twice_filter(docs: DataFrame, min_chars: int, bits: int) -> np.ndarray:
    """The merged twice-seen filter, bits // 8 bytes."""
    schema = "segment int, part int, once binary, twice binary"

    def build(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for b in slices(batches):
            keys = [k for t in b.column("text").to_pylist() for k in {k for _, k in line_keys(t, min_chars)[1]}]
            if keys:
                h, n = np.unique(hash64(keys), return_counts=True)
                add(twice, h[(n > 1) | holds(once, h, bits)], bits)
                add(once, h, bits)
        per = bits // 8 // SEGMENTS
        rows = [(s, zlib.compress(once[s * per : (s + 1) * per].tobytes(), 1), zlib.compress(twice[s * per : (s + 1) * per].tobytes(), 1)) for s in range(SEGMENTS) if once[s * per : (s + 1) * per].any()]
        part = TaskContext.get().partitionId()
        if rows:
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["segment", "part", "once", "twice"])

    def merge(t):
        import pyarrow as pa

        once = twice = None
        for a, b in zip(t.column("once").to_pylist(), t.column("twice").to_pylist(), strict=True):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
        return pa.table([t.column("segment")[:1], t.column("part")[:1], pa.array([zlib.compress(once.tobytes(), 1)], pa.binary()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], names=["segment", "part", "once", "twice"])

    parts = docs.select("text").mapInArrow(lean(build), schema)
    some = parts.groupBy("segment", F.pmod("part", F.lit(256))).applyInArrow(lambda t: merge(t), schema)
    full = some.groupBy("segment").applyInArrow(lambda t: merge(t), schema)
    out = np.zeros(bits // 8, np.uint8)
    per = bits // 8 // SEGMENTS
    for r in full.select("segment", "twice").collect():
        out[r["segment"] * per : (r["segment"] + 1) * per] = np.frombuffer(zlib.decompress(bytes(r["twice"])), np.uint8)
    return out


def confirmed_repeats(docs: DataFrame, min_chars: int, min_docs: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(key, keeper, n) of confirmed keys and the (key, doc_id, text_hash) of all suspects, both written."""
    shared = docs.sparkSession.sparkContext.broadcast(twice_filter(docs, min_chars, bits).tobytes())

    def suspects(batches):
        import pyarrow as pa

        twice = np.frombuffer(shared.value, np.uint8)
        for b in slices(batches):
            ids, keys, hashes = [], [], []
            for d, t, x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "text_hash")), strict=True):
                own = list({k for _, k in line_keys(t, min_chars)[1]})
                if own:
                    hit = [digest(k) for k, x in zip(own, holds(twice, hash64(own), bits).tolist(), strict=True) if x]
                    keys += hit
                    ids += [d] * len(hit)
                    hashes += [x] * len(hit)
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(hashes, pa.int64())], names=["key", "doc_id", "text_hash"])

    found = materialise(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(lean(suspects), "key binary, doc_id long, text_hash long"), "line-suspects")
    shared.destroy()
    sure = found.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_docs)
    return materialise(sure, "line-repeats"), found


def drop_lists(found: DataFrame, sure: DataFrame) -> DataFrame:
    """(doc_id, text_hash, drop): the keys that documents lose. A list is never longer than its text has lines."""
    hot = F.col("n") >= found.count() / 1000
    parts = [found.join(x, "key") for x in (sure.filter(~hot), F.broadcast(sure.filter(hot)))]
    lost = parts[0].unionByName(parts[1]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id", "text_hash").agg(F.collect_set("key").alias("drop"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, bits: int | None = None, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """docs with `text` cut to its kept lines, plus n_lines, n_dropped, kept_sha256."""
    spark = docs.sparkSession
    new = ["n_lines", "n_dropped", "kept_sha256"]
    rest = [c for c in docs.columns if c not in (*new, "doc_id", "text")]
    # Other columns travel in one, so that none can clash with what is added here.
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*rest, F.lit(0).alias(f"0{''.join(rest)}")).alias("rest"))
    read = docs.select("doc_id", "text")
    sure, found = confirmed_repeats(read, min_chars, min_docs, bits or bits_for(read))
    few = sure.limit(broadcast_keys + 1).count() <= broadcast_keys
    if few:
        kept_in = spark.sparkContext.broadcast({bytes(r["key"]): r["keeper"] for r in sure.select("key", "keeper").toLocalIterator()})
        source = docs.withColumn("drop", F.lit(None).cast("array<binary>"))
    else:
        kept_in = None
        lists = drop_lists(found, sure).withColumnRenamed("doc_id", "id")
        source = docs.join(lists, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("text_hash")), "left").select("doc_id", "text", "rest", "drop")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def cut(batches):
        import pyarrow as pa

        repeats = kept_in.value if few else {}
        absent = object()
        for b in slices(batches):
            texts, n, dropped, sha = [], [], [], []
            for d, t, out in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "drop")), strict=True):
                lines, keys = line_keys(t, min_chars)
                listed = set(out or ())
                gone = set()
                for i, k in keys:
                    key = digest(k)
                    keeper = repeats.get(key, absent)
                    if key in listed or (keeper is not absent and keeper != d):
                        gone.add(i)
                kept = "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else t or ""
                texts.append(kept), n.append(len(lines)), dropped.append(len(gone)), sha.append(hashlib.sha256(kept.encode()).hexdigest())
            yield pa.record_batch([b.column("doc_id"), pa.array(texts, pa.string()), b.column("rest"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "text", "rest", *new])

    return source.mapInArrow(lean(cut), schema).select("doc_id", "text", *[F.col("rest").getField(c).alias(c) for c in rest], *new)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeats AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.line, k.pos, r.key IS NOT NULL AND r.keeper <> k.doc_id AS gone
  FROM keyed k LEFT JOIN repeats r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
