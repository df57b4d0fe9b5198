"""Document versions and duplicate files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRATEGIES = ("replace", "keep_both", "soft_delete")


def without_known_files(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """First upload of each sha256 in the batch, unless it is known (active or not)."""
    w = Window.partitionBy("sha256").orderBy("parsed_at", "doc_id")
    d = docs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return d if known is None else d.join(known.select("sha256").distinct(), "sha256", "left_anti")


def chain(docs: DataFrame) -> DataFrame:
    """docs (doc_id, filename, parsed_at, strategy) with version, previous_doc_id, version_action, is_active.

    soft_delete retires the file's active version; what comes after starts anew at version 1. An unknown strategy replaces.
    """
    w = Window.partitionBy("filename").orderBy("parsed_at", "doc_id")
    s = F.when(F.col("strategy").isin(*STRATEGIES), F.col("strategy")).otherwise("replace")
    d = docs.withColumn("_s", s).withColumn("_life", F.coalesce(F.sum(F.when(F.col("_s") == "soft_delete", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    life = Window.partitionBy("filename", "_life").orderBy("parsed_at", "doc_id")
    d = d.withColumn("version", F.row_number().over(life)).withColumn("previous_doc_id", F.lag("doc_id").over(life)).withColumn("_next", F.lead("_s").over(life))
    action = F.when(F.col("_s") == "soft_delete", "soft_deleted").when(F.col("previous_doc_id").isNull(), "created").when(F.col("_s") == "keep_both", "kept_both").otherwise("replaced")
    active = (F.col("_s") != "soft_delete") & (F.col("_next").isNull() | (F.col("_next") == "keep_both"))
    return d.select(*docs.columns, "version", "previous_doc_id", action.alias("version_action"), active.alias("is_active"))
