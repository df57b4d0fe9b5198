"""The model slot: texts to vectors through any model, with cached vectors, a dimension check and failed rows.

A model is loaded once for each Python worker and gets texts in batches; texts whose vector is cached don't go to it. A row that fails (the model raises,
or gives another length or a number that isn't finite) gets zeros and a reason, the rest of its batch is kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: vectors of texts: a row for each text.
Predict = Callable[[list[str]], np.ndarray]

# US dollars for 1,000 tokens.
PRICES = {"small": 0.00002, "large": 0.00013, "ada": 0.0001}


@dataclass(frozen=True)
class Model:
    """`load` runs once in a worker and gives the function of texts."""

    name: str
    dims: int
    load: Callable[[], Predict]
    batch: int = 100
    price: float = PRICES["small"]


def _hashing(dims: int) -> Predict:
    import hashlib
    import re

    known: dict[str, int] = {}

    def vectors(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            for w in re.findall(r"[a-z0-9]+", t.lower()):
                if w not in known:
                    if len(known) > 1_000_000:
                        known.clear()
                    known[w] = int(hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()[:6], 16) % dims
                out[i, known[w]] += 1
        return out

    return vectors


def hashing(dims: int = 64) -> Model:
    """Counts of terms in hash buckets: the model where a caller brings none."""
    return Model("hashing", dims, lambda: _hashing(dims))


def letters() -> Model:
    """A toy of 26 numbers, for tests and as a pattern: shares of a to z; a text without any of them is an error."""

    def load() -> Predict:
        def vectors(texts: list[str]) -> np.ndarray:
            counts = np.array([[t.lower().count(chr(97 + k)) for k in range(26)] for t in texts], float)
            if not counts.sum(axis=1).all():
                raise ValueError("no letter in the text")
            return counts / counts.sum(axis=1, keepdims=True)

        return vectors

    return Model("letters", 26, load, batch=50)


def checked(predict: Predict, dims: int) -> Callable[[list[str]], tuple[np.ndarray, list[str]]]:
    """Vectors and reasons; if a batch fails, each of its rows is tried alone."""

    def one(texts: list[str]) -> np.ndarray:
        v = np.asarray(predict(texts), float)
        if v.shape != (len(texts), dims):
            raise ValueError(f"vectors of shape {v.shape} for {len(texts)} texts of {dims} dimensions")
        if not np.isfinite(v).all():
            raise ValueError("a vector has a number that isn't finite")
        return v

    def run(texts: list[str]) -> tuple[np.ndarray, list[str]]:
        try:
            return one(texts), [""] * len(texts)
        except Exception as whole:  # any error of a caller's model is a reason, not the end of the job
            if len(texts) == 1:
                return np.zeros((1, dims)), [f"{type(whole).__name__}: {whole}"[:200]]
            rows = [run([t]) for t in texts]
            return np.vstack([v for v, _ in rows]), [r[0] for _, r in rows]

    return run


def embed(chunks: DataFrame, model: Model, cached: DataFrame | None = None, text: str = "text") -> DataFrame:
    """chunks (content_hash, text, ...) with vector, cache_hit and embed_error.

    cached: (content_hash, vector), joined back by hash; a cached vector of another length isn't one. Null text: an error. Of several cached vectors of a hash the smallest is taken.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

    dims, load = model.dims, model.load

    def make():
        run = checked(load(), dims)

        def predict(texts: np.ndarray) -> dict[str, np.ndarray]:
            out, why = np.zeros((len(texts), dims)), np.full(len(texts), "", object)
            asked = [i for i, t in enumerate(texts) if t is not None]
            if asked:
                out[asked], why[asked] = run([texts[i] for i in asked])
            return {"vector": out, "error": why}

        return predict

    udf = predict_batch_udf(make, return_type=StructType().add("vector", ArrayType(DoubleType())).add("error", StringType()), batch_size=model.batch)
    if cached is None:
        d = chunks.withColumn("_cached", F.lit(None).cast("array<double>"))
    else:
        known = cached.filter(F.size("vector") == dims).groupBy("content_hash").agg(F.min(F.col("vector").cast("array<double>")).alias("_cached"))
        d = chunks.join(known, "content_hash", "left")
    d = d.withColumn("_made", udf(F.when(F.col("_cached").isNull(), F.col(text))))
    why = F.when(F.col("_cached").isNotNull(), None).when(F.col(text).isNull(), "no text").when(F.col("_made.error") != "", F.col("_made.error"))
    return d.withColumns({"vector": F.coalesce("_cached", "_made.vector"), "cache_hit": F.col("_cached").isNotNull(), "embed_error": why}).drop("_cached", "_made")


def spent(tokens: int, model: Model) -> float:
    return round(tokens / 1000 * model.price, 8)
