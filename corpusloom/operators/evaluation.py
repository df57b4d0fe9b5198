"""Ranking metrics of runs (query_id, rank, id) against relevance grades: rows (query_id, id, relevance), or `SameLabel`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Pairs:
    """Grades given as rows (query_id, id, relevance)."""

    def __init__(self, qrels: DataFrame):
        self.qrels = qrels

    def queries(self) -> DataFrame:
        return self.qrels.select("query_id")

    def graded(self, run: DataFrame) -> DataFrame:
        """run with `relevance`, null where there is no grade."""
        return run.join(self.qrels, ["query_id", "id"], "left")

    def totals(self, threshold: float) -> DataFrame:
        """query_id, total: how many grades of each query reach the threshold."""
        return self.qrels.groupBy("query_id").agg(F.count_if(F.col("relevance") >= threshold).alias("total"))

    def best(self, k: int) -> DataFrame:
        """query_id, relevance, _r of the k highest grades of each query."""
        w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "id")
        return self.qrels.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)


class SameLabel:
    """Grade `same` for items (id, label) of the label of a query (query_id, label), `own`, at least as high, for the query's own item.

    As `Pairs` of all queries and items of a label, which are as many as the square of a label's rows; they are never made: a hit's grade comes from its label, totals and
    best grades from the labels' sizes. Ids are unique, each query is an item, and nulls have no label.
    """

    def __init__(self, queries: DataFrame, items: DataFrame, own: float = 3.0, same: float = 1.0):
        self.labelled = queries.filter("label IS NOT NULL").select("query_id", "label")
        self.items, self.own, self.same = items, own, same

    def queries(self) -> DataFrame:
        return self.labelled.select("query_id")

    def graded(self, run: DataFrame) -> DataFrame:
        d = run.join(self.labelled.withColumnRenamed("label", "_asked"), "query_id", "left").join(self.items.select("id", F.col("label").alias("_label")), "id", "left")
        grade = F.when(F.col("query_id") == F.col("id"), F.lit(self.own)).otherwise(F.lit(self.same))
        return d.withColumn("relevance", F.when(F.col("_asked") == F.col("_label"), grade)).drop("_asked", "_label")

    def sizes(self) -> DataFrame:
        """query_id, n: how many items have the query's label."""
        return self.labelled.join(self.items.groupBy("label").agg(F.count("*").alias("n")), "label").select("query_id", "n")

    def totals(self, threshold: float) -> DataFrame:
        return self.sizes().select("query_id", (F.lit(int(self.own >= threshold)) + (F.col("n") - 1) * int(self.same >= threshold)).alias("total"))

    def best(self, k: int) -> DataFrame:
        d = self.sizes().select("query_id", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("_r"))
        return d.withColumn("relevance", F.when(F.col("_r") == 1, F.lit(self.own)).otherwise(F.lit(self.same)))


def grades(qrels: DataFrame | Pairs | SameLabel) -> Pairs | SameLabel:
    return Pairs(qrels) if isinstance(qrels, DataFrame) else qrels


def judged(run: DataFrame, qrels) -> DataFrame:
    once = Window.partitionBy("query_id", "id").orderBy("rank")
    run = run.withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n")
    return grades(qrels).graded(run).withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))


def everyone(run: DataFrame, qrels) -> DataFrame:
    """Queries of either, so that one that retrieved nothing counts, as 0."""
    return run.select("query_id").unionByName(grades(qrels).queries()).distinct()


def _at(df: DataFrame, ks: list[int]) -> DataFrame:
    return df.withColumn("k", F.explode(F.array(*map(F.lit, ks))))


def recall(run: DataFrame, qrels, ks: list[int], threshold: float = 1.0) -> DataFrame:
    """query_id, k, recall of all queries of run and qrels; 0 for a query without relevant documents or without hits."""
    total = grades(qrels).totals(threshold)
    found = _at(judged(run, qrels), ks).groupBy("query_id", "k").agg(F.count_if((F.col("rank") <= F.col("k")) & (F.col("relevance") >= threshold)).alias("found"))
    return _at(everyone(run, qrels), ks).join(found, ["query_id", "k"], "left").join(total, "query_id", "left").select("query_id", "k", F.round(F.coalesce(F.when(F.col("total") > 0, F.col("found") / F.col("total")), F.lit(0.0)), 6).alias("recall"))


def reciprocal_rank(run: DataFrame, qrels, threshold: float = 1.0) -> DataFrame:
    first = F.min(F.when(F.col("relevance") >= threshold, F.col("rank")))
    got = judged(run, qrels).groupBy("query_id").agg((1.0 / first).alias("rr"))
    return everyone(run, qrels).join(got, "query_id", "left").select("query_id", F.round(F.coalesce("rr", F.lit(0.0)), 6).alias("rr"))


def ndcg(run: DataFrame, qrels, ks: list[int]) -> DataFrame:
    gain = lambda r: (F.pow(F.lit(2.0), F.col("relevance")) - 1) / F.log2(F.col(r) + 1)
    got = _at(judged(run, qrels), ks).groupBy("query_id", "k").agg(F.sum(F.when(F.col("rank") <= F.col("k"), gain("rank")).otherwise(0.0)).alias("dcg"))
    best = _at(grades(qrels).best(max(ks)), ks).groupBy("query_id", "k").agg(F.sum(F.when(F.col("_r") <= F.col("k"), gain("_r")).otherwise(0.0)).alias("ideal"))
    both = _at(everyone(run, qrels), ks).join(got, ["query_id", "k"], "left").join(best, ["query_id", "k"], "left")
    return both.select("query_id", "k", F.round(F.coalesce(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")), F.lit(0.0)), 6).alias("ndcg"))


def wide(recalls: DataFrame, ndcgs: DataFrame, rr: DataFrame, ks: list[int]) -> DataFrame:
    """One row for each query, four decimals."""
    both = recalls.join(ndcgs, ["query_id", "k"])
    cols = [F.round(F.max(F.when(F.col("k") == k, F.col(m))), 4).alias(f"{m}_at_{k}") for m in ("recall", "ndcg") for k in ks]
    return both.groupBy("query_id").agg(*cols).join(rr.select("query_id", F.round("rr", 4).alias("mrr")), "query_id")
