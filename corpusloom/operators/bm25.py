"""BM25: postings, statistics, scores and ranked hits. Terms are runs of [a-z0-9] of the lower-cased text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import written
from .arrow import lean, small_batches
from .best import Best

K1, B = 1.5, 0.75
#: Terms of all queries (one row for each query and term) that tasks get by value at most.
BROADCAST_TERMS = 1_000_000
#: Numbers in a block of the queries' matrix; rows of documents in a block.
MATRIX, ROWS = 4_000_000, 256
#: Terms with their document frequencies, or queries with their bounds, that are broadcast at most.
BROADCAST_STATS = 200_000


def terms(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.explode(X.bag(F.col("text"))).alias("term"))


def repeated(docs: DataFrame) -> bool:
    """Whether several rows share a doc_id, or lack one."""
    return docs.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0


def runs(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, columns to keep, dl, term, tf: each row's terms, counted in the row as runs of its sorted terms."""
    d = docs.select("doc_id", *keep, F.sort_array(X.bag(F.col("text"))).alias("s"))
    d = d.select("doc_id", *keep, "s", F.filter(F.transform("s", lambda x, i: F.when((i == 0) | (F.get("s", i - 1) != x), i)), lambda i: i.isNotNull()).alias("at"))
    found = F.transform("at", lambda a, i: F.struct(F.get("s", a).alias("term"), (F.coalesce(F.get("at", i + 1), F.size("s")) - a).cast("long").alias("tf")))
    return d.select("doc_id", *keep, F.size("s").alias("dl"), F.inline(found))


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, dl (its terms), term, tf; rows that share a doc_id are one document."""
    t = runs(docs)
    if not repeated(docs):
        return t
    length = docs.groupBy(F.col("doc_id").alias("_id")).agg(F.sum(F.size(X.bag(F.col("text")))).alias("dl"))
    t = t.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))
    return t.join(length, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "dl", "term", "tf")


def term_frequency(docs: DataFrame) -> DataFrame:
    return counted(docs).select("doc_id", "term", "tf")


def term_stats(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


def with_df(tf: DataFrame, most: int = BROADCAST_STATS) -> DataFrame:
    """tf (term, ...), a written table, with each term's df. The most frequent terms, up to `most`, are broadcast; only rows of rarer ones are shuffled."""
    df = written(tf.groupBy("term").agg(F.count("*").alias("df")), "bm25-df")
    power = F.floor(F.log2("df")).cast("int")
    often, n = 64, 0
    for r in sorted(df.groupBy(power.alias("power")).count().collect(), reverse=True):
        n += r["count"]
        if n > most:
            break
        often = r["power"]
    x = tf.join(F.broadcast(df.filter(power >= often)), "term", "left")
    rare = x.filter("df IS NULL").drop("df").join(df.filter(power < often), "term")
    return x.filter("df IS NOT NULL").select(*rare.columns).unionByName(rare)


def postings(docs: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """term, doc_id, tf, weight; of the terms in `asked` (term, ...) only, if given. Rows without a doc_id count in the statistics.

    A document's length travels with its terms, so lengths need no join; what nobody asks for is dropped
    before it is written, while counts and lengths stay those of the whole collection.
    """
    t = counted(docs)
    if asked is None:
        t = written(t, "bm25-tf")
        length = t.agg(F.sum("tf").alias("length"))  # one row
    else:
        t = written(t.join(asked.select("term").distinct(), "term", "left_semi"), "bm25-tf")
        length = docs.agg(F.sum(F.size(X.bag(F.col("text")))).alias("length"))
    col = docs.agg(F.count("*").alias("n")).join(F.broadcast(length)).select("n", (F.coalesce("length", F.lit(0)) / F.greatest("n", F.lit(1))).alias("avgdl"))
    x = with_df(t).filter("doc_id IS NOT NULL").join(F.broadcast(written(col, "bm25-collection")))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return x.select("term", "doc_id", "tf", F.round(weight, 6).alias("weight"))


def scores(queries: DataFrame, posted: DataFrame) -> DataFrame:
    """query_id, doc_id, score: weights summed over the query's terms, repeated terms included. Decimals keep the sum independent of order."""
    hit = terms(queries, "query_id").join(posted.filter("weight > 0"), "term")
    return hit.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight").cast("decimal(18,6)")).cast("double").alias("score"))


def min_max(hits: DataFrame, n_candidates: int | None = None) -> DataFrame:
    """Scores scaled to 0..1 in each query; the minimum is 0 if some candidate has no match. hits are read twice: for each query's bounds, and to be scaled."""
    lo = F.min("score") if n_candidates is None else F.when(F.count("*") < n_candidates, 0.0).otherwise(F.min("score"))
    bounds = written(hits.groupBy(F.col("query_id").alias("_query")).agg(lo.alias("_lo"), F.max("score").alias("_hi")), "bm25-bounds")
    bounds = F.broadcast(bounds) if bounds.limit(BROADCAST_STATS + 1).count() <= BROADCAST_STATS else bounds
    d = hits.join(bounds, F.col("query_id").eqNullSafe(F.col("_query"))).drop("_query")
    return d.withColumn("norm", F.when(F.col("_hi") > F.col("_lo"), F.round((F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")), 6)).otherwise(0.0)).drop("_lo", "_hi")


def top(hits: DataFrame, k: int, by: str = "score", key: str = "doc_id") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(by), key)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def collection(docs: DataFrame, names: DataFrame) -> tuple[int, float, dict[str, int]]:
    """Documents, mean length and the document frequency of the terms in `names` (term), in one scan."""
    d = docs.select(X.bag(F.col("text")).alias("bag"))
    t = d.select(F.size("bag").cast("long").alias("dl"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("bag"))).alias("term"))
    none = names.sparkSession.createDataFrame([("",)], "term string")  # stands for the document itself
    t = t.join(F.broadcast(names.unionByName(none)), "term", "left_semi")
    rows = {r["term"]: r for r in t.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("dl")).collect()}
    if "" not in rows:
        return 0, 0.0, {}
    n = rows[""]["df"]
    return n, rows[""]["dl"] / n, {x: r["df"] for x, r in rows.items() if x}


def query_blocks(asked: list[tuple[int, str, int]], number: dict[str, int], places: dict[int, int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Queries' numbers, their terms' numbers and the matrix of counts (terms x queries), a block for each few queries."""
    by: dict[int, list[tuple[int, int]]] = {}
    for q, term, n in asked:
        by.setdefault(places[q], []).append((number[term], n))
    out, some, met = [], [], set()
    for q in [*sorted(by), None]:
        new = {t for t, _ in by[q]} if q is not None else set()
        if some and (q is None or len(met | new) * (len(some) + 1) > MATRIX):
            terms_of = np.array(sorted(met))
            m = np.zeros((len(terms_of), len(some)))
            for j, x in enumerate(some):
                for t, n in by[x]:
                    m[np.searchsorted(terms_of, t), j] = n
            out.append((np.array(some), terms_of, m))
            some, met = [], set()
        if q is not None:
            some.append(q)
            met |= new
    return out


def _asked(queries: DataFrame) -> list[tuple[int, str, int]] | None:
    """Queries' terms with their counts; None if they are more than tasks get by value."""
    counted = terms(queries, "query_id").groupBy("query_id", "term").agg(F.count("*").alias("n"))
    asked = [(r["query_id"], r["term"], r["n"]) for r in counted.limit(BROADCAST_TERMS + 1).collect()]
    return asked if len(asked) <= BROADCAST_TERMS else None


def _by_scan(docs: DataFrame, asked: list[tuple[int, str, int]]) -> tuple[list[int], Callable[[Iterator], Iterator]] | None:
    """The queries' ids, and a function of batches (doc_id, lower-cased text) that gives, for blocks of queries and documents, the queries' numbers,
    the doc_ids and the matrix of scores, in millionths. Weights are whole numbers, so scores don't depend on order. None: there is nothing to find."""
    spark = docs.sparkSession
    names = sorted({t for _, t, _ in asked})
    total, mean, df = collection(docs, spark.createDataFrame([(t,) for t in names], "term string"))
    if not names or not total:
        return None
    number, ids = {t: i for i, t in enumerate(names)}, sorted({q for q, _, _ in asked})
    idf = np.log((total - np.array([df.get(t, 0) for t in names], float) + 0.5) / (np.array([df.get(t, 0) for t in names], float) + 0.5) + 1)
    shared = spark.sparkContext.broadcast((asked, number, ids, idf))
    small_batches(spark)

    def run(batches):
        asked, number, ids, idf = shared.value
        blocks = query_blocks(asked, number, {q: i for i, q in enumerate(ids)})
        find = re.compile("[a-z0-9]+").findall
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                own, dl = [], np.zeros(part.num_rows)
                for i, t in enumerate(part.column("text")):  # one text's words at a time
                    words = find(t.as_py())
                    dl[i] = len(words)
                    own.append(np.array([number[w] for w in words if w in number], np.int64))
                at = np.repeat(np.arange(len(own)), [len(x) for x in own]) * len(number) + np.concatenate(own)
                cell, tf = np.unique(at, return_counts=True)
                row, term = cell // len(number), cell % len(number)
                weight = idf[term] * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl[row] / mean))
                whole = np.floor(weight * 1e6 + 0.5)
                docs_of = part.column("doc_id").to_numpy(zero_copy_only=False)
                for q, terms_of, m in blocks:
                    place = np.minimum(np.searchsorted(terms_of, term), len(terms_of) - 1)
                    hit = terms_of[place] == term
                    used, col = np.unique(place[hit], return_inverse=True)
                    a = np.zeros((len(own), len(used)))
                    a[row[hit], col] = whole[hit]
                    yield q, docs_of, (a @ m[used]).T

    return ids, run


def _scanned(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))


_HITS = "query_id long, doc_id long, score double"


def all_scores(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, score of all documents (doc_id, text) that have a term of the query (query_id, text).

    Queries whose terms fit `BROADCAST_TERMS` go to the tasks by value, which score documents in blocks: nothing is shuffled. More queries, and documents of
    several rows, are joined with postings. Null doc_ids are never hits.
    """
    asked = _asked(queries)
    if asked is None or repeated(docs):
        return scores(queries, postings(docs, terms(queries, "query_id")))
    found = _by_scan(docs, asked)
    if found is None:
        return docs.sparkSession.createDataFrame([], _HITS)
    ids, blocks = found

    def run(batches):
        import pyarrow as pa

        for q, docs_of, s in blocks(batches):
            i, j = np.nonzero(s > 0)
            yield pa.record_batch([pa.array(np.array(ids, np.int64)[q[i]]), pa.array(docs_of[j]), pa.array(s[i, j] / 1e6)], names=["query_id", "doc_id", "score"])

    return _scanned(docs).mapInArrow(lean(run), _HITS)


def top_hits(docs: DataFrame, queries: DataFrame, k: int, allowed: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """query_id, doc_id, score, rank of the best k documents (doc_id, text) of each query (query_id, text), of the `allowed` (doc_id) only and of those `where` holds for, if given.

    Statistics are those of the whole collection. Queries whose terms fit `BROADCAST_TERMS` go to the tasks by value; a task scores its
    documents in blocks, as matrix products, and gives its best k for each query. Null doc_ids are never hits. More queries are joined with postings.
    """
    asked = _asked(queries)
    if asked is None:
        found = scores(queries, postings(docs, terms(queries, "query_id")))
        allowed = docs.filter(where).select("doc_id") if where is not None and allowed is None else allowed if where is None else allowed.join(docs.filter(where).select("doc_id"), "doc_id", "left_semi")
        found = found if allowed is None else found.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
        return top(found.filter("doc_id IS NOT NULL"), k)
    found = _by_scan(docs, asked)
    if found is None:
        return top(docs.sparkSession.createDataFrame([], _HITS), k)
    ids, blocks = found

    def run(batches):
        import pyarrow as pa

        best = Best(len(ids), k)
        for q, docs_of, s in blocks(batches):
            best.add(q, docs_of, np.where(s > 0, s, -np.inf))
        q, doc, s = best.rows()
        yield pa.record_batch([pa.array(np.array(ids, np.int64)[q]), pa.array(doc), pa.array(s / 1e6)], names=["query_id", "doc_id", "score"])

    some = docs if where is None else docs.filter(where)
    d = some if allowed is None else some.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
    return top(_scanned(d).mapInArrow(lean(run), _HITS), k)
