"""Ingest as one job: parse, version, chunk, validate, embed, store, with counts of each phase that are observed while the rows pass through the one write.

Tables below `path`: vectors (partitioned by namespace) and, when a run has ended, its row for each phase in phases. A run overwrites the partitions that it has rows
for and leaves the others; a namespace's records that the run doesn't bring stay, those it brings again are replaced.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as X
from ..sources import files
from ..sources.shared import written
from . import embedding, store, versions

PHASES = "run string, phase string, n_in long, n_out long, n_skipped long, n_failed long, cache_hits long, tokens long, cost_usd double, success_rate double"

#: What a record says about its chunk.
METADATA = ["doc_id", "version", "doc_ref_name", "page", "section_path", "text", "published_at", "source_url", "mime", "language", "checksum", "chunk_index", "chunk_type", "strategy", "created_at", "tenant_id", "corpus", "parent_id"]


def section_path(prefix: Column, name: Column) -> Column:
    """The headings of a title prefix `document > heading > ...`, without the document's name or its stem."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    first = F.substring_index(prefix, " > ", 1)
    rest = F.when(F.contains(prefix, F.lit(" > ")), F.substring(prefix, F.length(first) + F.lit(4), F.length(prefix))).otherwise("")
    return F.when((first == name) | (first == stem), rest).otherwise(F.coalesce(prefix, F.lit("")))


def records(chunks: DataFrame, created_at: int = 0) -> DataFrame:
    """chunks with a vector to namespace, id, vector, metadata (18 fields). Columns that chunks lack are taken as missing."""
    has = lambda name, kind, other: F.coalesce(F.col(name).cast(kind), F.lit(other).cast(kind)) if name in chunks.columns else F.lit(other).cast(kind)
    page = F.coalesce(F.array_min("page_numbers"), F.lit(0)) if "page_numbers" in chunks.columns else F.lit(0)
    text = has("text", "string", "")
    fields = {
        "doc_id": has("doc_id", "string", ""), "version": has("version", "int", 1), "doc_ref_name": has("filename", "string", ""), "page": page.cast("int"),
        "section_path": section_path(has("title_prefix", "string", ""), has("filename", "string", "")), "text": F.substring(text, 1, 1000), "published_at": ids.epoch(has("published_at", "string", "")), "source_url": has("source_url", "string", ""),
        "mime": files.mime(has("file_type", "string", "")), "language": has("language", "string", "en"), "checksum": F.substring(has("content_hash", "string", ""), 1, 16), "chunk_index": has("chunk_index", "int", 0), "chunk_type": has("chunk_type", "string", "text"),
        "strategy": has("strategy", "string", ""), "created_at": F.lit(created_at).cast("long"), "tenant_id": has("tenant_id", "string", "default"), "corpus": has("corpus", "string", "default"), "parent_id": has("parent_chunk_id", "string", ""),
    }
    d = chunks.select(ids.namespace(fields["tenant_id"], fields["corpus"]).alias("namespace"), F.struct(*[fields[k].alias(k) for k in METADATA]).alias("metadata"), "vector", "embed_error")
    m = F.col("metadata")
    return d.select("namespace", ids.vector_id(m["doc_id"], m["version"], m["page"], m["chunk_index"]).alias("id"), "vector", "metadata", "embed_error")


def counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    return df.observe(seen, *[c.alias(k) for k, c in counts.items()]), seen


def seen(counts: Observation) -> dict[str, int]:
    """What was observed; zeros if no row came so far, as Spark then leaves the phase out, with its counts."""
    try:
        return defaultdict(int, counts.get)
    except Py4JJavaError:
        return defaultdict(int)


def _folder(spark: SparkSession, path: str):
    """A path and its file system, as Hadoop has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    at, system = _folder(spark, path)
    return system.exists(at)


def run(uploads: DataFrame, path: str, chunk: Callable[[DataFrame], DataFrame], model: embedding.Model, cached: DataFrame | None = None, known: DataFrame | None = None, least_chars: int = 10, most_tokens: int = 8191) -> DataFrame:
    """uploads (doc_id, text, filename, file_type, parsed_at, strategy, tenant_id, corpus) into the tables below `path`; gives a row for each phase.

    chunk: documents (doc_id, text, ...) to doc_id, chunk_index, text, token_count. cached: (content_hash, vector). known: uploads by (sha256) that are there already. Null or blank text:
    rejected. A chunk is skipped if it is short, long, or has content that another chunk of the run with a smaller (doc_id, chunk_index) has. A zero vector isn't stored: skipped, or
    failed if it comes with a reason. No uploads: a row of zeros for each phase.
    """
    spark = uploads.sparkSession
    n = F.count("*")
    good = F.coalesce(F.trim("text"), F.lit("")) != ""
    up, parse = counted(uploads, "parse", n_in=n, n_out=F.count_if(good))
    fresh = versions.without_known_files(up.filter(good).withColumn("sha256", F.sha2("text", 256)), known)
    chained, version = counted(versions.chain(fresh), "version", n_in=n, n_out=F.count_if("is_active"))
    docs = chained.filter("is_active").select(F.col("doc_id").cast("long").alias("doc_id"), "filename", "file_type", "version", "tenant_id", "corpus", X.language(F.col("text")).alias("language"), "text")
    docs = written(docs, "ingest-documents")  # they are chunked, and described by their records; parse and version are counted in this pass
    chunks = chunk(docs.select("doc_id", "text", "file_type", F.col("filename").alias("title")))
    chunks, made = counted(chunks.withColumn("content_hash", F.sha2("text", 256)), "chunk", n_out=n)
    bad = F.when(F.length("text") < least_chars, "empty").when(F.col("token_count") > most_tokens, "too_long")
    first = Window.partitionBy("content_hash").orderBy("doc_id", "chunk_index")
    checked = chunks.withColumn("_bad", bad).filter("_bad IS NULL").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_bad", "_n")
    vectors = embedding.embed(checked, model, cached)
    made_now = ~F.col("cache_hit")
    vectors, embed = counted(vectors, "embed", n_in=n, n_failed=F.count_if(F.col("embed_error").isNotNull()), cache_hits=F.count_if("cache_hit"), tokens=F.coalesce(F.sum(F.when(made_now, F.col("token_count"))), F.lit(0)))
    rows = records(vectors.join(docs.drop("text"), "doc_id"))
    rows, stored = counted(rows, "store", n_in=n, n_zero=F.count_if(~F.exists("vector", lambda x: x != 0)), n_failed=F.count_if(F.col("embed_error").isNotNull()))
    write_namespaces(store.non_zero(rows, "vector").drop("embed_error"), f"{path}/vectors")

    p, v, c, e, s = map(seen, (parse, version, made, embed, stored))
    name, rate = uuid.uuid4().hex, lambda a, b: round(a / b, 6) if b else 1.0
    out = [
        ("parse", p["n_in"], p["n_out"], p["n_in"] - p["n_out"], 0, 0, 0, 0.0, rate(p["n_out"], p["n_in"])),
        ("version", p["n_out"], v["n_out"], p["n_out"] - v["n_out"], 0, 0, 0, 0.0, 1.0),
        ("chunk", v["n_out"], c["n_out"], 0, 0, 0, 0, 0.0, 1.0),
        ("embed", c["n_out"], e["n_in"] - e["n_failed"], c["n_out"] - e["n_in"], e["n_failed"], e["cache_hits"], e["tokens"], embedding.spent(e["tokens"], model), rate(e["n_in"] - e["n_failed"], e["n_in"])),
        ("store", s["n_in"], s["n_in"] - s["n_zero"], s["n_zero"] - s["n_failed"], s["n_failed"], 0, 0, 0.0, rate(s["n_in"] - s["n_failed"], s["n_in"])),
    ]
    phases = spark.createDataFrame([(name, *r) for r in out], PHASES)
    phases.coalesce(1).write.mode("append").parquet(f"{path}/phases")
    return phases


def write_namespaces(rows: DataFrame, at: str) -> None:
    """Upsert records (namespace, id, ...): the namespaces of `rows` are rewritten with the records they had and these, the newer of equal ids.

    The new records are written first, so the job that makes them runs once; the merge reads only the touched partitions.
    """
    spark = rows.sparkSession
    new = f"{at}-new-{uuid.uuid4().hex}"
    rows.write.partitionBy("namespace").parquet(new)
    fresh = spark.read.schema(rows.schema).parquet(new)
    touched = fresh.select("namespace").distinct()
    if _exists(spark, at):
        old = spark.read.schema(rows.schema).parquet(at)
        both = store.upsert(old.join(F.broadcast(touched), "namespace", "left_semi").select(*rows.columns), fresh.select(*rows.columns), ["namespace", "id"])
        merged = f"{at}-merged-{uuid.uuid4().hex}"
        both.write.partitionBy("namespace").parquet(merged)  # what is read is not what is written over
        fresh = spark.read.schema(rows.schema).parquet(merged)
    store.write_partitions(fresh.select(*rows.columns), at)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The records below `path`."""
    return spark.read.parquet(f"{path}/vectors")


def clear_namespace(spark: SparkSession, path: str, namespace: str, confirm: str | None = None) -> None:
    """Take all records out of a namespace; only if its name is given twice."""
    if confirm != namespace:
        raise ValueError(f"to clear {namespace!r} give its name as confirm, too")
    at = f"{path}/vectors"
    rows = spark.read.parquet(at)
    if not rows.filter(F.col("namespace") == namespace).limit(1).count():
        raise LookupError(f"no namespace {namespace!r}")
    # an overwrite of the one partition with nothing: dynamic mode would leave it, so the folder goes by Hadoop's own file system
    folder, system = _folder(spark, f"{at}/namespace={namespace}")
    system.delete(folder, True)
