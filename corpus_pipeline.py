"""A corpus from raw documents to packed sequences.

Stages take all rows their predecessor kept and, but for the last, return the columns of documents:
language ID drops texts without a recognisable language, line dedup cuts repeated lines, the Jaccard
join keeps the document with the smallest id of each group of near duplicates, decontamination
drops documents that hold benchmark passages, packing makes sequences with the sources' mixture.
Rows without a doc_id stay in all stages that decide by doc_id.

Null texts and texts without a letter go in the first stage. Very long texts are read whole everywhere. Repeated rows are decided
alike; of equal texts with different doc_ids the smallest id stays, rows that share one doc_id stay or go together.
An empty table gives an empty one, with its columns. Further columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import few_or_shuffled, materialise, table
from corpusloom.llm.decontam import decontaminate
from corpusloom.llm.jaccard import near_duplicates
from corpusloom.llm.langid import keep_known, prototypes
from corpusloom.llm.line_dedup import dedup_lines
from corpusloom.llm.packing import pack
from corpusloom.llm.tokens import default_path

#: A cosine that only texts without a language's trigrams stay below.
MIN_LANGUAGE_SCORE = 0.05


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the texts that get no language, or none with a cosine of MIN_LANGUAGE_SCORE; prototypes come from the labelled ones of them."""
    return keep_known(docs, prototypes(docs), MIN_LANGUAGE_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with lines of 20 or more characters that at least 3 documents hold kept in the last of them only; n_chars follows the text."""
    cut = dedup_lines(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the smallest doc_id of each group of near duplicates; documents without words are in no group and stay."""
    gone = near_duplicates(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = few_or_shuffled(materialise(gone, "near-copies"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a benchmark passage, re-parameterised or not."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, as op2_packing returns them."""
    return pack(docs, default_path("byte_bpe_50k.json"))


STAGES = [("language", language), ("lines", lines), ("near", near), ("benchmark", benchmark), ("packing", packing)]

#: Near duplicates, language profiles and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
