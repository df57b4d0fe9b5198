"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram is its letters' vectors bound by
multiplication, the first permuted twice, the second once; a document bundles (adds) the vectors of
all its trigrams; a language's prototype bundles its documents, each as the mean of its trigrams' vectors, so that long ones don't
outweigh others. A document gets the language of the prototype with the highest cosine.

Every letter of Unicode has a vector of its own, drawn by its code point; A-Z and other capitals are taken as small ones. What isn't
a letter is a word boundary. Ties go to the language that sorts first. All languages are learned; the driver
holds a prototype (4 KB) for each.

`und` with score 0: null text, text without a letter, and all texts if nothing could be learned.
Null lang: not learned from. Null doc_id: its number's text is empty, so it is learned from. Repeated rows count as often as they occur.
Very long text: all of it counts; a task holds about 20 bytes for each of its characters. Empty table: no rows. Only doc_id, text and, for learning, lang
are read; `keep_known` passes other columns through, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_or_shuffled, lean, materialise, table
from .tokens import slices

DIMENSIONS = 1024
SEED = 20_240_501
UNKNOWN = "und"
#: Trigrams of so many symbols at most are counted in a table (of texts that are worth one), others by sorting.
TABLE_SYMBOLS = 80
#: Trigram vectors that a worker remembers at most (1 KB each).
GRAMS = 32_768


class Letters:
    """Numbers and vectors of the letters that a worker has met; 0 is the boundary."""

    def __init__(self):
        self.number = np.full(0x110000, -1, np.int32)
        self.vectors = np.zeros((0, DIMENSIONS), np.int8)
        self.add([0])
        self.number[0] = 0
        self.known, self.rows = np.zeros(0, np.int64), np.zeros((0, DIMENSIONS), np.int8)

    def add(self, points: list[int]) -> None:
        own = np.stack([np.random.default_rng([SEED, p]).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1 for p in points]).astype(np.int8)
        self.vectors = np.concatenate([self.vectors, own])
        self.once, self.twice = np.roll(self.vectors, 1, 1), np.roll(self.vectors, 2, 1)

    def of(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.number[points]
        if (s < 0).any():
            new = np.unique(points[s < 0])
            letters = [p for p in new.tolist() if chr(p).isalpha()]
            self.number[new] = 0
            self.number[letters] = len(self.vectors) + np.arange(len(letters))
            if letters:
                self.add(letters)
            s = self.number[points]
        return s

    def bound(self, ids: np.ndarray) -> np.ndarray:
        """Vectors of trigrams: letters bound in order."""
        return self.twice[ids >> 42] * self.once[ids >> 21 & 0x1FFFFF] * self.vectors[ids & 0x1FFFFF]

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """Vectors of ascending trigrams; those met before are looked up."""
        if len(ids) > GRAMS // 2:
            return self.bound(ids)
        new = ids[~np.isin(ids, self.known, assume_unique=True)]
        if len(new):
            if len(self.known) + len(new) > GRAMS:
                self.known, self.rows, new = self.known[:0], self.rows[:0], ids
            at = np.searchsorted(self.known, new)
            self.known, self.rows = np.insert(self.known, at, new), np.insert(self.rows, at, self.bound(new), axis=0)
        return self.rows[np.searchsorted(self.known, ids)]


_STATE: dict[str, Letters] = {}


def letters() -> Letters:
    """Made once for each worker."""
    if "letters" not in _STATE:
        _STATE["letters"] = Letters()
    return _STATE["letters"]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of the whole text and their counts."""
    s = letters().of(text)
    if not s.any():
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    s = np.concatenate(([0], s, [0])).astype(np.int64)
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]  # runs of other characters are one boundary
    a, b, c = s[:-2], s[1:-1], s[2:]
    k = len(letters().vectors)
    if k > TABLE_SYMBOLS or len(a) < k**3 // 16:
        ids, counts = np.unique(a << 42 | b << 21 | c, return_counts=True)
        return ids, counts.astype(np.float32)
    n = np.bincount((a * k + b) * k + c, minlength=k**3)
    met = np.flatnonzero(n)
    return met // (k * k) << 42 | met // k % k << 21 | met % k, n[met].astype(np.float32)


def counted(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [trigrams(t) if t else (np.zeros(0, np.int64), np.zeros(0, np.float32)) for t in texts]


def vectors(texts: list[str | None], at_once: int = 128) -> np.ndarray:
    """Document vectors scaled to length 1; zero for texts without a letter."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i in range(0, len(texts), at_once):
        own = counted(texts[i : i + at_once])
        ids = np.unique(np.concatenate([a for a, _ in own]))
        for lo in range(0, len(ids), 8192):
            some = ids[lo : lo + 8192]
            counts = np.zeros((len(own), len(some)), np.float32)
            for k, (a, n) in enumerate(own):
                at = slice(*np.searchsorted(a, [some[0], some[-1] + 1]))
                counts[k, np.searchsorted(some, a[at])] = n[at]
            out[i : i + at_once] += counts @ letters().grams(some).astype(np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


class Profile:
    """Weights of the trigrams of a language's documents."""

    def __init__(self):
        self.parts, self.held = [(np.zeros(0, np.int64), np.zeros(0))], 0

    def add(self, ids: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((ids, n / n.sum(dtype=np.float64)))
        self.held += len(ids)
        if self.held > 500_000:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        ids, at = np.unique(np.concatenate([a for a, _ in self.parts]), return_inverse=True)
        self.parts, self.held = [(ids, np.bincount(at, np.concatenate([n for _, n in self.parts]), len(ids)))], 0
        return self.parts[0]

    def vector(self) -> np.ndarray:
        ids, n = self.merge()
        return sum((n[i : i + 4096] @ letters().bound(ids[i : i + 4096]).astype(np.float64) for i in range(0, len(ids), 4096)), np.zeros(DIMENSIONS))


def held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages of the learnable documents (doc_id, text, lang) and their unit prototypes, in order of name."""

    def bundle(batches):
        import pyarrow as pa

        total: dict[str, Profile] = {}
        for b in slices(batches):
            for (ids, n), g in zip(counted(b.column("text").to_pylist()), b.column("lang").to_pylist(), strict=True):
                if len(ids):
                    total.setdefault(g, Profile()).add(ids, n)
        for g, x in total.items():
            yield pa.record_batch([pa.array([g] * DIMENSIONS, pa.string()), pa.array(range(DIMENSIONS), pa.int32()), pa.array(x.vector(), pa.float64())], names=["lang", "dim", "x"])
        _STATE.clear()  # workers go on to other stages

    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("text", F.col("lang").cast("string").alias("lang"))
    names = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    place = {n: i for i, n in enumerate(names)}
    out = np.zeros((len(names), DIMENSIONS))
    for r in known.mapInArrow(lean(bundle), "lang string, dim int, x double").groupBy("lang", "dim").agg(F.sum("x").alias("x")).toLocalIterator():
        out[place[r["lang"]], r["dim"]] = r["x"]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return names, np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def identify(docs: DataFrame, learned: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs (doc_id, text, ...) to doc_id, lang_pred, score."""
    names, protos = learned
    protos = protos.astype(np.float32)

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            v = vectors(b.column("text").to_pylist())
            some = v.any(axis=1) & bool(len(names))
            cos = v @ protos.T if len(names) else np.zeros((len(v), 1), np.float32)
            best = cos.argmax(axis=1)
            pred = [names[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), some.tolist(), strict=True)]
            score = np.where(some, np.clip(cos[np.arange(len(v)), best], 0, 1), 0).astype(np.float64)
            yield pa.record_batch([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])
        _STATE.clear()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, learned: tuple[list[str], np.ndarray], min_score: float) -> DataFrame:
    """docs, all columns, without those that get no language or a cosine below min_score; if nothing was learned, without those that have no letter.

    Only the rejected rows' ids and text hashes come back from Python; texts stay in the JVM.
    """
    names, protos = learned
    protos = protos.astype(np.float32)

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            v = vectors(b.column("text").to_pylist())
            best = (v @ protos.T).max(axis=1) if len(names) else np.ones(len(v))
            yield b.select(["id", "hash"]).filter(pa.array(~(v.any(axis=1) & (best >= min_score))))
        _STATE.clear()

    text = F.col("text").cast("string")
    read = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    gone = read.mapInArrow(lean(run), "id long, hash long").distinct()
    gone = few_or_shuffled(materialise(gone, "language-rejects"))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["hash"]), "left_anti")


def crc32_mod4(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, prototypes(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
