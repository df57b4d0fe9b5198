"""Queries over documents: text functions, identifiers, statistics, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as X
from ..operators import chunking, versions
from ..sources import files
from . import sqltext as S
from .registry import query, table

_TYPE_SQL = "['pdf', 'docx', 'csv', 'html', 'txt', 'xlsx'][doc_id % 6 + 1]"


def docs(spark, d):
    """documents with a file name and type, as an upload would have."""
    t = table(spark, d, "documents")
    kind = F.element_at(F.array(*map(F.lit, ["pdf", "docx", "csv", "html", "txt", "xlsx"])), (F.col("doc_id") % 6 + 1).cast("int"))
    return t.withColumn("file_type", kind).withColumn("filename", F.concat_ws(".", "source", "file_type"))


_D = f"d AS (SELECT *, {_TYPE_SQL} AS file_type, source || '.' || {_TYPE_SQL} AS filename FROM documents)"


@query(f"SELECT doc_id, lower(regexp_replace(trim(lang), '[^a-z0-9_-]', '_', 'g')) || '__' || lower(source) AS namespace, lower(lang) AS tenant, lower(source) AS corpus FROM documents")
def namespace_resolve(spark, d):
    x = table(spark, d, "documents").select("doc_id", ids.namespace(F.col("lang"), F.col("source")).alias("namespace"))
    t, c = ids.parse_namespace(F.col("namespace"))
    return x.select("doc_id", "namespace", t.alias("tenant"), c.alias("corpus"))


@query("SELECT doc_id, doc_id || ':1:' || (doc_id % 7) || ':' || n_chars AS vid, CAST(doc_id AS VARCHAR) AS p_doc, 1 AS p_version, CAST(doc_id % 7 AS INTEGER) AS p_page, CAST(n_chars AS INTEGER) AS p_chunk FROM documents")
def vector_id_roundtrip(spark, d):
    x = table(spark, d, "documents").select("doc_id", ids.vector_id(F.col("doc_id"), F.lit(1), F.col("doc_id") % 7, F.col("n_chars")).alias("vid"))
    p = ids.parse_vector_id(F.col("vid"))
    return x.withColumn("p", p).select("doc_id", "vid", F.col("p.doc_id").alias("p_doc"), F.col("p.version").alias("p_version"), F.col("p.page").alias("p_page"), F.col("p.chunk_index").alias("p_chunk"))


@query(f"WITH {S.CHUNKS} SELECT doc_id, chunk_index, substring(text, 1, 1000) AS text, substring(sha256(text), 1, 16) AS checksum, 0 AS page, coalesce(lang, 'en') AS language, 'text/plain' AS mime, lower(lang) || '__' || lower(source) AS namespace FROM chunks")
def vector_metadata(spark, d):
    c = chunking.fixed(table(spark, d, "documents")).join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    page = F.coalesce(F.array_min(F.array().cast("array<int>")), F.lit(0))
    return c.select("doc_id", "chunk_index", F.substring("text", 1, 1000).alias("text"), F.substring(F.sha2("text", 256), 1, 16).alias("checksum"), page.alias("page"), F.coalesce("lang", F.lit("en")).alias("language"), files.mime(F.lit("txt")).alias("mime"), ids.namespace(F.col("lang"), F.col("source")).alias("namespace"))


@query(f"WITH {_D} SELECT doc_id, CASE WHEN lower(source) = lower(replace(replace(source, '_', ' '), '-', ' ')) THEN source ELSE source || ' | ' || replace(replace(source, '_', ' '), '-', ' ') END AS prefix FROM d")
def title_prefix(spark, d):
    stem = F.translate(F.regexp_replace("filename", r"\.[^.]*$", ""), "_-", "  ")
    return docs(spark, d).select("doc_id", F.concat_ws(" | ", F.col("source"), F.when(F.lower("source") != F.lower(stem), stem)).alias("prefix"))


@query("SELECT doc_id, source || ' > ' || lang AS path FROM documents")
def section_path(spark, d):
    x = docs(spark, d).withColumn("prefix", F.concat_ws(" | ", F.lit("File.Stem"), "source", "lang")).withColumn("stem", F.lit("file.stem"))
    return x.select("doc_id", F.array_join(F.filter(F.split("prefix", r" \| "), lambda p: F.lower(F.trim(p)) != F.col("stem")), " > ").alias("path"))


@query(f"WITH {S.CHUNKS} SELECT doc_id, chunk_index, length(text) AS char_count, sha256(text) AS content_hash, source || chr(10) || chr(10) || text AS text_with_title, CASE WHEN chunk_index % 2 = 0 THEN 'p. ' || (chunk_index + 1) ELSE 'pp. ' || (chunk_index + 1) || '-' || (chunk_index + 2) END AS pages FROM chunks")
def chunk_derived_fields(spark, d):
    c = chunking.fixed(table(spark, d, "documents")).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    k = F.col("chunk_index")
    c = c.withColumn("nums", F.when(k % 2 == 0, F.array(k + 1)).otherwise(F.array(k + 1, k + 2)))
    lo, hi = F.array_min("nums").cast("string"), F.array_max("nums").cast("string")
    return c.select("doc_id", "chunk_index", F.length("text").cast("long").alias("char_count"), F.sha2("text", 256).alias("content_hash"), F.concat("source", F.lit("\n\n"), "text").alias("text_with_title"), F.when(lo == hi, F.concat(F.lit("p. "), lo)).otherwise(F.concat(F.lit("pp. "), lo, F.lit("-"), hi)).alias("pages"))


@query(f"WITH {_D} SELECT doc_id, filename FROM d WHERE file_type = 'csv' AND contains(lower(filename), 'src1') ORDER BY doc_id DESC")
def doc_list(spark, d):
    return docs(spark, d).filter((F.col("file_type") == "csv") & F.contains(F.lower("filename"), F.lower(F.lit("SRC1")))).select("doc_id", "filename").orderBy(F.desc("doc_id"))


_POLICY_SQL = f"(regexp_matches(lower(source || ' ' || substring(text, 1, 500)), '\\b(policy|regulation|compliance|directive|bylaw|statute|ordinance|agreement|contract|procedure|guideline)\\b') OR len(list_filter({str(X.POLICY_KEYWORDS)}, lambda k: contains(substring(lower(text), 1, 2000), k))) >= 3)"


@query(f"SELECT doc_id, {_POLICY_SQL} AS is_policy FROM documents")
def policy_detect(spark, d):
    return table(spark, d, "documents").select("doc_id", X.is_policy(F.col("source"), F.col("text")).alias("is_policy"))


@query(f"WITH {_D} SELECT doc_id, CASE WHEN file_type IN ('csv', 'xlsx') THEN 'fixed_size' WHEN file_type = 'txt' THEN 'sentence_based' WHEN {_POLICY_SQL} THEN 'hierarchical' ELSE 'recursive' END AS strategy FROM d")
def chunk_strategy_route(spark, d):
    return docs(spark, d).select("doc_id", chunking.strategy(F.col("file_type"), F.col("source"), F.col("text")).alias("strategy"))


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '…' ELSE text END AS preview, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '…' ELSE text END AS snippet, substring(sha256(text), 1, 16) AS sha FROM documents")
def doc_detail(spark, d):
    cut = lambda n: F.when(F.length("text") > n, F.concat(F.substring("text", 1, n), F.lit("…"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", cut(500).alias("preview"), cut(200).alias("snippet"), F.substring(F.sha2("text", 256), 1, 16).alias("sha"))


@query(f"SELECT count(*) AS n_docs, CAST(sum(len({S.words('text')})) AS BIGINT) AS n_words, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM documents")
def doc_stats(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n_docs"), F.sum(F.size(X.words(F.col("text")))).alias("n_words"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes"))


@query(f"WITH {_D} SELECT file_type, count(*) AS n FROM d GROUP BY ALL")
def doc_stats_by_type(spark, d):
    return docs(spark, d).groupBy("file_type").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT source AS doc, doc_id // 4096 AS part, count(*) AS n, sum(length(text)) AS c, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS h FROM documents WHERE trim(text) <> '' GROUP BY ALL)
SELECT doc, CAST(sum(n) AS BIGINT) AS n_pages, CAST(sum(c) AS BIGINT) AS n_chars, sha256(string_agg(h, '' ORDER BY part)) AS full_sha FROM r GROUP BY ALL""")
def doc_page_totals(spark, d):
    """A source's documents as the pages of one file. The file's hash is that of its parts' hashes, a part's that of its at most 4,096 pages' hashes: no text is gathered."""
    p = table(spark, d, "documents").filter(F.trim("text") != "").select(F.col("source").alias("doc"), "doc_id", F.floor(F.col("doc_id") / 4096).alias("part"), F.length("text").alias("c"), F.sha2("text", 256).alias("h"))
    joined = lambda key: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "h"))), lambda x: x["h"]), ""), 256).alias("h")
    r = p.groupBy("doc", "part").agg(F.count("*").alias("n"), F.sum("c").alias("c"), joined("doc_id"))
    return r.groupBy("doc").agg(F.sum("n").alias("n_pages"), F.sum("c").alias("n_chars"), joined("part").alias("full_sha"))


@query(f"WITH {S.CHUNKS} SELECT doc_id, chunk_index, sha256(text) AS h FROM chunks WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def chunk_page_subset(spark, d):
    pages = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    return chunking.fixed(table(spark, d, "documents").join(pages, "doc_id", "left_semi")).select("doc_id", "chunk_index", F.sha2("text", 256).alias("h"))


@query(f"SELECT doc_id, {S.tokens('text')} AS tokens, {S.tokens('text')} <= 512 AS fits FROM documents")
def token_counts(spark, d):
    n = X.token_count(F.col("text"))
    return table(spark, d, "documents").select("doc_id", n.alias("tokens"), (n <= 512).alias("fits"))


@query(f"SELECT doc_id, CASE WHEN {S.tokens('text')} <= 100 THEN text ELSE rtrim(substring(text, 1, CAST(floor(length(text) * 100.0::DOUBLE / ({S.tokens('text')})) AS BIGINT))) END AS text FROM documents")
def token_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", X.truncate(F.col("text"), 100).alias("text"))


@query("SELECT conv_id, turn, greatest(1, CAST(trunc(length(text) / 3.8::DOUBLE) AS INTEGER)) AS tokens FROM conversations")
def approx_tokens(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.approx_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, CASE WHEN length(trim(text)) < 20 THEN NULL WHEN regexp_matches(substring(text, 1, 500), '[一-鿿]') THEN 'zh' WHEN regexp_matches(substring(text, 1, 500), '[Ѐ-ӿ]') THEN 'ru' WHEN regexp_matches(substring(text, 1, 500), '[؀-ۿ]') THEN 'ar' WHEN length(regexp_replace(substring(text, 1, 500), '[^\\x00-\\x7F]', '', 'g')) / length(substring(text, 1, 500)) >= 0.85 THEN 'en' END AS lang_guess FROM documents")
def lang_heuristic(spark, d):
    return table(spark, d, "documents").select("doc_id", X.language(F.col("text")).alias("lang_guess"))


@query("SELECT doc_id, sha256(text) AS full_hash, substring(sha256(text), 1, 12) AS short_hash, sha256(doc_id || ':0:' || text) AS chunk_hash, sha256(regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g')) AS norm_hash FROM documents")
def content_hashes(spark, d):
    h = F.sha2("text", 256)
    return table(spark, d, "documents").select("doc_id", h.alias("full_hash"), F.substring(h, 1, 12).alias("short_hash"), F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":0:"), "text"), 256).alias("chunk_hash"), X.normalised_hash(F.col("text")).alias("norm_hash"))


@query()
def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.chunk_sentences(F.col("text"))).alias("pos", "sentence"))


@query("SELECT event_id, CAST(epoch(CAST(strftime(ts, '%Y-%m-%d') AS TIMESTAMP)) AS BIGINT) AS day_epoch, CAST(0 AS BIGINT) AS bad_epoch FROM events")
def date_epoch(spark, d):
    return table(spark, d, "events").select("event_id", ids.epoch(F.date_format("ts", "yyyy-MM-dd")).alias("day_epoch"), ids.epoch(F.concat(F.lit("bad-"), "event_type")).alias("bad_epoch"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def pdf_date(spark, d):
    return table(spark, d, "orders").select("o_orderkey", ids.pdf_date(F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("+00'00'"))).alias("iso"))


@query("SELECT doc_id, text AS clean FROM (SELECT item_id AS doc_id, trim(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '\\s+', ' ', 'g')) AS text FROM benchmark)")
def query_sanitize(spark, d):
    """Control characters go, white space collapses; NFKC by an Arrow function for rows that aren't ASCII only."""
    import unicodedata

    @F.pandas_udf("string")
    def nfkc(s):
        return s.map(lambda x: unicodedata.normalize("NFKC", x))

    b = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    plain, other = b.filter(~F.col("text").rlike(r"[^\x00-\x7F]")), b.filter(F.col("text").rlike(r"[^\x00-\x7F]")).withColumn("text", nfkc("text"))
    clean = F.trim(F.regexp_replace(F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"\s+", " "))
    return plain.unionByName(other).select("doc_id", clean.alias("clean")).filter(F.length("clean").between(1, 4000))


@query(f"SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+'), lambda x: regexp_full_match(x, '[a-z]{{2,}}') AND x NOT IN {S.in_list(X.SPARSE_STOP_WORDS)}) AS terms FROM benchmark")
def bm25_query_tokens(spark, d):
    """Terms of all queries; a word with any letter outside a-z is none."""
    return table(spark, d, "benchmark").select("item_id", X.without(X.letters_only(F.col("text")), X.SPARSE_STOP_WORDS).alias("terms"))


@query(f"SELECT doc_id, greatest(1, CAST(round_even(({S.tokens('text')}) / 462.0, 0) AS INTEGER)) AS n_chunks FROM documents")
def chunk_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", F.greatest(F.lit(1), F.bround(X.token_count(F.col("text")) / F.lit(462.0)).cast("int")).alias("n_chunks"))


@query(f"""WITH firsts AS (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents)
SELECT doc_id, source FROM firsts WHERE n = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)""")
def doc_dedup_sha(spark, d):
    t = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("parsed_at"))
    known = t.join(table(spark, d, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    return versions.without_known_files(t, known).select("doc_id", "source")


_UP = "u AS (SELECT doc_id, source AS filename, CASE WHEN doc_id % 11 = 3 THEN 'keep_both' WHEN doc_id % 13 = 5 THEN 'soft_delete' ELSE 'replace' END AS s FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1)"
_CHAIN = f"""WITH {_UP}, l AS (SELECT *, coalesce(sum(CASE WHEN s = 'soft_delete' THEN 1 ELSE 0 END) OVER (PARTITION BY filename ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM u),
v AS (SELECT doc_id, filename, s, CAST(row_number() OVER w AS INTEGER) AS version, lag(doc_id) OVER w AS previous_doc_id, lead(s) OVER w AS nxt FROM l WINDOW w AS (PARTITION BY filename, life ORDER BY doc_id)),
c AS (SELECT doc_id, filename, version, previous_doc_id, CASE WHEN s = 'soft_delete' THEN 'soft_deleted' WHEN previous_doc_id IS NULL THEN 'created' WHEN s = 'keep_both' THEN 'kept_both' ELSE 'replaced' END AS version_action, s <> 'soft_delete' AND (nxt IS NULL OR nxt = 'keep_both') AS is_active FROM v)"""


def uploads(spark, d):
    s = F.when(F.col("doc_id") % 11 == 3, "keep_both").when(F.col("doc_id") % 13 == 5, "soft_delete").otherwise("replace")
    t = table(spark, d, "documents").select("doc_id", F.col("source").alias("filename"), F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("parsed_at"), s.alias("strategy"))
    return versions.chain(versions.without_known_files(t))


@query(f"{_CHAIN} SELECT * FROM c")
def doc_versions(spark, d):
    return uploads(spark, d).select("doc_id", "filename", "version", "previous_doc_id", "version_action", "is_active")


@query(f"{_CHAIN} SELECT doc_id, filename, version FROM c WHERE is_active")
def doc_active(spark, d):
    return uploads(spark, d).filter("is_active").select("doc_id", "filename", "version")


@query(f"{_CHAIN} SELECT count(*) AS total, count(*) FILTER (WHERE is_active) AS active, count(*) FILTER (WHERE NOT is_active) AS inactive FROM c")
def version_stats(spark, d):
    return uploads(spark, d).agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("inactive"))


@query("SELECT doc_id, text_hash, n_copies FROM (SELECT doc_id, sha256(text) AS text_hash, count(*) OVER (PARTITION BY sha256(text)) AS n_copies, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1 AND n_copies > 1")
def doc_exact_dups(spark, d):
    """Counted by a grouped sum, so a text with very many copies is combined before it is shuffled."""
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies")).filter("n_copies > 1").select("doc_id", "text_hash", "n_copies")


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", files.html_title(F.col("html")).alias("title"))


@query()
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", files.html_text(F.col("html")).alias("text"))


@query()
def file_manifest_validate(spark, d):
    """Pages and documents as files with their bytes, some with another extension than they should have."""
    p = table(spark, d, "pages").select(F.concat(F.lit("in/"), "page_id", F.when(F.col("page_id") % 9 == 4, ".pdf").otherwise(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    t = docs(spark, d).select(F.concat(F.lit("in/"), "doc_id", F.lit("."), "file_type").alias("path"), F.col("text").cast("binary").alias("content"))
    return files.validate(p.unionByName(t).withColumn("length", F.octet_length("content").cast("long")))


@query()
def doc_scan_status(spark, d):
    p = table(spark, d, "pages").select(F.concat(F.lit("in/"), "page_id", F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    t = docs(spark, d).select(F.concat(F.lit("in/"), "doc_id", F.lit("."), "file_type").alias("path"), F.col("text").cast("binary").alias("content"))
    s = files.scan(p.unionByName(t).withColumn("length", F.octet_length("content").cast("long")))
    return s.select("path", "parser", "status", "fallback_used", F.length("text").alias("n_chars"))
