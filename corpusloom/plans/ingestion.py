"""Queries that chunk, validate, embed and store documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bm25, chunking, dense, embedding, ingest, store
from ..sources.shared import shared_folder
from . import sqltext as S
from .documents import docs
from .registry import query, table


def chunks(spark, d):
    return chunking.fixed(table(spark, d, "documents"))


@query(f"WITH {S.CHUNKS} SELECT doc_id, chunk_index, sha256(text) AS h FROM chunks")
def chunk_fixed_size(spark, d):
    return chunks(spark, d).select("doc_id", "chunk_index", F.sha2("text", 256).alias("h"))


@query(f"""WITH docw AS (SELECT doc_id, {S.words('text')} AS w FROM documents), c AS (SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, w[k * 355 + 1:k * 355 + 393] AS p FROM docw, LATERAL (SELECT unnest(range(0, 1 + CAST(ceil(greatest(len(w) - 393, 0) / 355.0) AS BIGINT))) AS k) WHERE len(w) > 0)
SELECT doc_id, chunk_index, sha256(array_to_string(p, ' ')) AS h FROM c WHERE CAST(round_even(len(p) * 1.3, 0) AS INTEGER) >= 50""")
def chunk_fixed_overlap(spark, d):
    return chunking.fixed(table(spark, d, "documents"), overlap=50).select("doc_id", "chunk_index", F.sha2("text", 256).alias("h"))


@query()
def chunk_sentence(spark, d):
    return chunking.sentence(table(spark, d, "documents"))


@query()
def chunk_recursive(spark, d):
    return chunking.recursive(table(spark, d, "documents"))


@query()
def chunk_semantic(spark, d):
    return chunking.semantic(table(spark, d, "documents"))


@query()
def semantic_breaks(spark, d):
    return chunking.semantic_breaks(table(spark, d, "documents"))


@query()
def chunk_hierarchical(spark, d):
    return chunking.hierarchical(table(spark, d, "documents"))


@query()
def chunk_tree_expand(spark, d):
    return chunking.expanded(table(spark, d, "documents")).select("doc_id", "chunk_id", "child", "parent", F.length("parent_text").alias("n_parent"))


def table_docs(spark, d):
    """Orders of each customer as a Markdown table below a heading."""
    row = F.concat(F.lit("| "), F.col("o_orderkey"), F.lit(" | "), F.col("o_orderpriority"), F.lit(" |"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))).alias("r"))
    return o.select("doc_id", F.concat(F.lit("# Orders\nSome words first.\n| key | priority |\n| --- | --- |\n"), F.array_join("r.r", "\n"), F.lit("\nEnd.")).alias("text"))


@query("SELECT o_custkey AS doc_id, 2 AS first_line, CAST(count(*) + 2 AS INTEGER) AS n_lines, TRUE AS has_separator FROM orders GROUP BY ALL")
def table_blocks(spark, d):
    return chunking.table_blocks(table_docs(spark, d)).select("doc_id", "first_line", "n_lines", "has_separator")


@query()
def chunk_tables(spark, d):
    return chunking.table_chunks(table_docs(spark, d), limit=60)


@query("SELECT o_custkey AS doc_id, CAST(count(*) + 5 AS BIGINT) AS n_lines, 'Orders' AS heading FROM orders GROUP BY ALL")
def chunk_headings(spark, d):
    return chunking.headings(table_docs(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max("heading").alias("heading"))


@query()
def chunk_pipeline(spark, d):
    t = docs(spark, d).withColumn("title", F.col("source"))
    return chunking.chunk_job(t).select("doc_id", "new_index", "strategy", "chunk_type", "content_hash", "token_count")


_C = f"WITH {S.CHUNKS}, h AS (SELECT *, sha256(text) AS content_hash, {S.tokens('text')} AS token_count FROM chunks)"


def hashed(spark, d):
    return chunks(spark, d).withColumn("content_hash", F.sha2("text", 256))


@query(f"{_C} SELECT doc_id, chunk_index, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, content_hash ORDER BY chunk_index) AS n FROM h) WHERE n = 1")
def chunk_dedup(spark, d):
    return chunking.first_of(hashed(spark, d), ["doc_id", "content_hash"], ["chunk_index"]).select("doc_id", "chunk_index", "content_hash")


@query(f"{_C} SELECT doc_id, chunk_index, chunk_index % 3 = 1 AS is_table, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index % 3 = 1, chunk_index) - 1 AS INTEGER) AS new_index FROM h")
def chunk_reindex(spark, d):
    return chunking.reindex(chunks(spark, d).withColumn("is_table", F.col("chunk_index") % 3 == 1)).select("doc_id", "chunk_index", "is_table", "new_index")


@query(f"{_C} SELECT doc_id, count(*) AS n_chunks, CAST(sum(token_count) AS BIGINT) AS tokens, min(token_count) AS lo, max(token_count) AS hi, CAST(floor(avg(token_count)) AS BIGINT) AS mean, count(*) - count(DISTINCT content_hash) AS duplicates FROM h GROUP BY ALL")
def chunk_report(spark, d):
    return hashed(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("token_count").alias("tokens"), F.min("token_count").alias("lo"), F.max("token_count").alias("hi"), F.floor(F.avg("token_count")).alias("mean"), (F.count("*") - F.count_distinct("content_hash")).alias("duplicates"))


@query(f"{_C} SELECT doc_id, chunk_index, 'text' AS kind FROM h UNION ALL SELECT o_custkey, 0, 'table' FROM orders GROUP BY o_custkey")
def chunk_union(spark, d):
    t = chunking.table_blocks(table_docs(spark, d)).select("doc_id", F.lit(0).alias("chunk_index"), F.lit("table").alias("kind"))
    return chunks(spark, d).select("doc_id", "chunk_index", F.lit("text").alias("kind")).unionByName(t)


_KNOWN = "content_hash IN (SELECT sha256(text) FROM chunks JOIN labels USING (doc_id) WHERE quality = 0)"


def known(spark, d):
    poor = table(spark, d, "labels").filter("quality = 0").select("doc_id")
    return hashed(spark, d).join(poor, "doc_id", "left_semi").select("content_hash").distinct()


@query(f"{_C} SELECT doc_id, chunk_index FROM h WHERE NOT ({_KNOWN})")
def dedup_known_hashes(spark, d):
    return hashed(spark, d).join(known(spark, d), "content_hash", "left_anti").select("doc_id", "chunk_index")


@query(f"{_C} SELECT doc_id, chunk_index, {_KNOWN} AS hit FROM h")
def embed_cache_hits(spark, d):
    cached = known(spark, d).withColumn("hit", F.lit(True))
    return hashed(spark, d).join(cached, "content_hash", "left").select("doc_id", "chunk_index", F.coalesce("hit", F.lit(False)).alias("hit"))


_VALID = f"""{_C}, a AS (SELECT doc_id, chunk_index, content_hash, token_count, CASE WHEN length(text) < 10 THEN 'empty' WHEN token_count > 500 THEN 'too_long' END AS r0, row_number() OVER (PARTITION BY (length(text) >= 10 AND token_count <= 500), content_hash ORDER BY doc_id, chunk_index) AS n FROM h),
v AS (SELECT doc_id, chunk_index, coalesce(r0, CASE WHEN n > 1 THEN 'duplicate' END) AS skip_reason FROM a)"""


def validated(spark, d):
    c = hashed(spark, d).withColumn("r0", F.when(F.length("text") < 10, "empty").when(F.col("token_count") > 500, "too_long"))
    w = Window.partitionBy(F.col("r0").isNull(), "content_hash").orderBy("doc_id", "chunk_index")
    return c.withColumn("n", F.row_number().over(w)).select("doc_id", "chunk_index", F.coalesce("r0", F.when(F.col("n") > 1, "duplicate")).alias("skip_reason"))


@query(f"{_VALID} SELECT * FROM v")
def chunk_validation(spark, d):
    return validated(spark, d)


@query(f"{_VALID} SELECT coalesce(skip_reason, 'valid') AS outcome, count(*) AS n FROM v GROUP BY ALL")
def chunk_validation_report(spark, d):
    return validated(spark, d).groupBy(F.coalesce("skip_reason", F.lit("valid")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"{_C} SELECT count(*) AS n_input, count(*) FILTER (WHERE {_KNOWN}) AS cache_hits, CAST(sum(token_count) AS BIGINT) AS tokens, round(sum(token_count) / 1000.0::DOUBLE * 0.00002, 8) AS cost_usd, CAST(ceil(count(*) / 100.0) AS BIGINT) AS batches FROM h")
def embed_cost_report(spark, d):
    rates = F.create_map(*[F.lit(x) for kv in {"small": 0.00002, "large": 0.00013, "ada": 0.0001}.items() for x in kv])
    cached = known(spark, d).withColumn("hit", F.lit(True))
    return hashed(spark, d).join(cached, "content_hash", "left").agg(F.count("*").alias("n_input"), F.count_if("hit").alias("cache_hits"), F.sum("token_count").alias("tokens"), F.round(F.sum("token_count") / 1000.0 * rates[F.lit("small")], 8).alias("cost_usd"), F.ceil(F.count("*") / 100.0).alias("batches"))


@query(f"SELECT doc_id, CAST(len({S.bag('text')}) AS DOUBLE) AS mass, len(list_distinct(list_transform({S.bag('text')}, lambda t: CAST('0x' || substring(md5(t), 1, 6) AS INTEGER) % 64))) AS n_buckets FROM documents")
def embed_hashing(spark, d):
    e = table(spark, d, "documents").select("doc_id", dense.hashed_embedding(F.col("text")).alias("v"))
    return e.select("doc_id", F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("mass"), F.size(F.filter("v", lambda x: x > 0)).cast("long").alias("n_buckets"))


@query(f"{_C} SELECT doc_id, chunk_index, 1 AS version FROM h WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT doc_id, chunk_index, 2 FROM h WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def corpus_upsert(spark, d):
    c = chunks(spark, d)
    again = c.join(table(spark, d, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    v = lambda x, n: x.select("doc_id", "chunk_index", F.lit(n).alias("version"))
    return store.upsert(v(c, 1), v(again, 2), ["doc_id", "chunk_index"])


@query(f"{_C} SELECT doc_id, chunk_index FROM h WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def corpus_delete_doc(spark, d):
    return store.delete_ids(chunks(spark, d), table(spark, d, "labels").filter("toxic = 1"), "doc_id").select("doc_id", "chunk_index")


@query()
def ingest_summary(spark, d):
    """Documents to chunks, vectors and postings: what each phase made."""
    c = chunking.chunk_job(docs(spark, d).withColumn("title", F.col("source")))
    stored = F.exists(dense.hashed_embedding(F.col("text")), lambda x: x != 0)
    # counts of each document, then of all: chunks are made once, and no row of a chunk or a posting is shuffled
    by_doc = c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(stored).alias("vectors"))
    total = by_doc.agg(*[x for p in ("chunks", "vectors") for x in (F.coalesce(F.sum(p), F.lit(0)).alias(p), F.count_if((F.col(p) > 0) & F.col("doc_id").isNotNull()).alias(f"{p}_docs"))])
    made = total.select(F.inline(F.array(*[F.struct(F.lit(p).alias("phase"), F.col(p).alias("rows"), F.col(f"{p}_docs").alias("docs")) for p in ("chunks", "vectors")])))
    t = bm25.term_frequency(table(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("n"))
    return made.unionByName(t.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("doc_id").alias("docs")).select(F.lit("postings").alias("phase"), "rows", "docs"))


def uploads(spark, d):
    """documents as uploads, two of a file name, the later replacing the earlier."""
    kind = F.element_at(F.array(*map(F.lit, ["pdf", "docx", "csv", "html", "txt", "xlsx"])), (F.col("doc_id") % 6 + 1).cast("int"))
    t = table(spark, d, "documents").withColumn("filename", F.concat(F.lit("file-"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit(".txt")))
    return t.select("doc_id", "text", "filename", kind.alias("file_type"), F.col("doc_id").alias("parsed_at"), F.lit("replace").alias("strategy"), F.col("lang").alias("tenant_id"), F.col("source").alias("corpus"))


_INGEST = f"""WITH up AS (SELECT doc_id, text, lang, source, sha256(text) AS h FROM documents WHERE trim(coalesce(text, '')) <> ''),
once AS (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1),
act AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY doc_id // 2 ORDER BY doc_id DESC) = 1),
docw AS (SELECT doc_id, {S.words('text')} AS w FROM act),
c AS (SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, array_to_string(w[k * 393 + 1:(k + 1) * 393], ' ') AS text FROM docw, LATERAL (SELECT unnest(range(0, CAST(ceil(len(w) / 393.0) AS BIGINT))) AS k) WHERE CAST(round_even(len(w[k * 393 + 1:(k + 1) * 393]) * 1.3, 0) AS INTEGER) >= 50),
m AS (SELECT *, {S.tokens('text')} AS n, sha256(text) AS h, doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS poor FROM c),
v AS (SELECT * FROM m WHERE length(text) >= 10 QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, chunk_index) = 1),
k AS (SELECT v.*, v.h IN (SELECT sha256(text) FROM ({S.CHUNK_ROWS}) WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)) AS hit FROM v),
e AS (SELECT *, NOT hit AND len({S.bag('text')}) = 0 AS blank FROM k),
f AS (SELECT (SELECT count(*) FROM documents) AS n0, (SELECT count(*) FROM up) AS n1, (SELECT count(*) FROM act) AS n2, (SELECT count(*) FROM m) AS n3, (SELECT count(*) FROM v) AS n4, (SELECT count(*) FROM e WHERE hit) AS hits, (SELECT coalesce(sum(n), 0) FROM e WHERE NOT hit) AS tokens, (SELECT count(*) FROM e WHERE blank) AS zero)"""


@query(f"""{_INGEST}
SELECT 'parse' AS phase, n0 AS n_in, n1 AS n_out, n0 - n1 AS n_skipped, 0::BIGINT AS n_failed, 0::BIGINT AS cache_hits, 0::BIGINT AS tokens, 0::DOUBLE AS cost_usd, round(n1 / n0::DOUBLE, 6) AS success_rate FROM f
UNION ALL SELECT 'version', n1, n2, n1 - n2, 0, 0, 0, 0, 1 FROM f UNION ALL SELECT 'chunk', n2, n3, 0, 0, 0, 0, 0, 1 FROM f
UNION ALL SELECT 'embed', n3, n4, n3 - n4, 0, hits, CAST(tokens AS BIGINT), round(tokens / 1000::DOUBLE * 0.00002, 8), 1 FROM f UNION ALL SELECT 'store', n4, n4 - zero, zero, 0, 0, 0, 0, 1 FROM f""")
def ingest_phases(spark, d):
    """Uploads to stored vectors in one job: a row for each phase. Vectors of the chunks of poor documents are cached."""
    known = hashed(spark, d).join(table(spark, d, "labels").filter("quality = 0").select("doc_id"), "doc_id", "left_semi").select("content_hash").distinct()
    cached = known.withColumn("vector", F.array_repeat(F.lit(1.0), 64))
    return ingest.run(uploads(spark, d), shared_folder(spark, "ingest"), chunking.fixed, embedding.hashing(), cached).drop("run")
