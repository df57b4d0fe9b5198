"""Queries over ranked hits: BM25, fusion, reranking, context control, packing. The query set is the whole `benchmark` table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import blended, bm25, dense, sparse_index
from ..operators import retrieval as R
from ..sources.shared import shared_folder, written
from . import sqltext as S
from .registry import query, table


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def found(spark, d):
    """query_id, doc_id, score of all matches."""
    return bm25.all_scores(docs(spark, d), asked(spark, d))


def hits(spark, d, k=50):
    """query_id, id, score, rank of the best k documents."""
    return bm25.top_hits(docs(spark, d), asked(spark, d), k).withColumnRenamed("doc_id", "id")


_TOP = f"WITH {S.BM25}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores)"
_HITS = f"{_TOP}, hits AS (SELECT query_id, doc_id AS id, score, rank FROM ranked WHERE rank <= 50)"


@query(f"WITH {S.BM25} SELECT doc_id, term, tf FROM tf")
def term_freq(spark, d):
    return bm25.term_frequency(docs(spark, d))


@query(f"WITH {S.BM25} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY ALL")
def bm25_term_stats(spark, d):
    return bm25.term_stats(bm25.term_frequency(docs(spark, d)))


@query(f"WITH {S.BM25} SELECT term, doc_id, tf, weight FROM postings")
def bm25_postings(spark, d):
    return bm25.postings(docs(spark, d))


@query(f"WITH {S.BM25} SELECT doc_id, count(*) AS nnz, round(CAST(sum(CAST(weight AS DECIMAL(18, 6))) AS DOUBLE), 3) AS total, min(term) AS first_term FROM postings WHERE weight > 0 GROUP BY ALL")
def bm25_sparse_vectors(spark, d):
    """Vectors as parallel arrays, terms ascending; reported by size, weight and first term."""
    v = bm25.postings(docs(spark, d)).filter("weight > 0").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("v"))
    v = v.select("doc_id", F.col("v.term").alias("indices"), F.col("v.weight").alias("values"))
    return v.select("doc_id", F.size("indices").cast("long").alias("nnz"), F.round(F.aggregate("values", F.lit(0).cast("decimal(28,6)"), lambda s, x: (s + x.cast("decimal(18,6)")).cast("decimal(28,6)")).cast("double"), 3).alias("total"), F.get("indices", F.lit(0)).alias("first_term"))


@query(f"WITH {S.BM25}, w AS (SELECT doc_id, term, weight, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS n FROM postings) SELECT doc_id, term, weight FROM w WHERE n <= 128")
def sparse_topk_terms(spark, d):
    w = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term")
    return bm25.postings(docs(spark, d)).withColumn("n", F.row_number().over(w)).filter("n <= 128").select("doc_id", "term", "weight")


@query(f"WITH {S.BM25} SELECT * FROM scores")
def bm25_scores(spark, d):
    return found(spark, d)


@query(f"{_TOP} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 10")
def bm25_topk(spark, d):
    return hits(spark, d, 10).withColumnRenamed("id", "doc_id")


@query(f"{_TOP} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 10")
def bm25_index_topk(spark, d):
    """Through the stored index: built, loaded, asked."""
    at = shared_folder(spark, "sparse-index")
    sparse_index.build(docs(spark, d), at)
    return sparse_index.top_hits(sparse_index.load(spark, at), asked(spark, d), 10)


@query(f"WITH {S.BM25} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY ALL")
def bm25_index_terms(spark, d):
    """Term statistics of a stored index."""
    at = shared_folder(spark, "sparse-index")
    sparse_index.build(docs(spark, d), at)
    return sparse_index.load(spark, at).terms


@query(f"WITH {S.BM25}, ok AS (SELECT * FROM scores WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ok) WHERE rank <= 10")
def bm25_allowlist(spark, d):
    """Statistics stay those of the whole collection."""
    allowed = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    return bm25.top_hits(docs(spark, d), asked(spark, d), 10, allowed)


@query(f"""WITH {S.BM25}, n AS (SELECT query_id, doc_id, score, CASE WHEN count(*) OVER w < (SELECT count(*) FROM documents) THEN 0 ELSE min(score) OVER w END AS lo, max(score) OVER w AS hi FROM scores WINDOW w AS (PARTITION BY query_id))
SELECT query_id, doc_id, score, CASE WHEN hi > lo THEN round((score - lo) / (hi - lo), 6) ELSE 0 END AS norm FROM n""")
def bm25_minmax(spark, d):
    return bm25.min_max(written(found(spark, d), "bm25-scores"), docs(spark, d).count())


def vector_hits(spark, d, k=50):
    """Dense arm of hybrid queries: hashed term counts of queries and documents, cosine."""
    v = docs(spark, d).select(F.col("doc_id").alias("vec_id"), dense.hashed_embedding(F.col("text")).alias("vector"))
    q = asked(spark, d).select("query_id", dense.hashed_embedding(F.col("text")).alias("vector"))
    return dense.top_k(q, v, k).withColumnRenamed("vec_id", "id")


def _hashed(rel: str, key: str) -> str:
    bucket = "CAST('0x' || substring(md5(t), 1, 6) AS INTEGER) % 64"
    return f"(SELECT {key} AS k, list_transform(range(0, 64), lambda i: CAST(len(list_filter(b, lambda x: x = i)) AS DOUBLE)) AS v FROM (SELECT {key}, list_transform({S.bag('text')}, lambda t: {bucket}) AS b FROM {rel}))"


_EVERY = f"""dv AS (SELECT q.k AS query_id, x.k AS id, CASE WHEN list_sum(q.v) = 0 OR list_sum(x.v) = 0 THEN 0 ELSE round(list_cosine_similarity(q.v, x.v), 6) END AS score FROM {_hashed('benchmark', 'item_id')} q CROSS JOIN {_hashed('documents', 'doc_id')} x)"""
_DENSE = f"""{_EVERY},
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dv) WHERE rank <= 50)"""
_RRF = f"""{_HITS}, {_DENSE}, nd AS (SELECT query_id, count(*) AS n FROM dense GROUP BY 1), ns AS (SELECT query_id, count(*) AS n FROM hits GROUP BY 1),
f AS (SELECT coalesce(dense.query_id, hits.query_id) AS query_id, coalesce(dense.id, hits.id) AS id, dense.rank AS dense_rank, hits.rank AS sparse_rank FROM dense FULL JOIN hits ON dense.query_id = hits.query_id AND dense.id = hits.id),
fused AS (SELECT f.query_id, id, dense_rank, sparse_rank, round(1.0::DOUBLE / (60 + coalesce(dense_rank, coalesce(nd.n, 0) + 1)) + 1.0::DOUBLE / (60 + coalesce(sparse_rank, coalesce(ns.n, 0) + 1)), 8) AS rrf_score FROM f LEFT JOIN nd USING (query_id) LEFT JOIN ns USING (query_id))"""


@query(f"{_RRF} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id) AS rank FROM fused")
def rrf_fusion(spark, d):
    return R.rrf(vector_hits(spark, d), hits(spark, d))


@query(f"{_RRF} SELECT query_id, id, rrf_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id) AS rank FROM fused) WHERE rank <= 20")
def hybrid_topk(spark, d):
    """Twenty of the fused list, as a caller that then reranks takes them."""
    return R.rrf(vector_hits(spark, d), hits(spark, d)).filter("rank <= 20").select("query_id", "id", "rrf_score", "rank")


@query(f"""WITH {S.BM25}, {_EVERY}, b AS (SELECT dv.query_id, dv.id, round(dv.score + coalesce(round(scores.score * (1 - 0.7::DOUBLE), 8), 0), 8) AS score FROM dv LEFT JOIN scores ON dv.query_id = scores.query_id AND dv.id = scores.doc_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b) WHERE rank <= 10""")
def blended_topk(spark, d):
    """Both scores of every document; the lists of the two arms aren't cut before they are added."""
    return blended.top_k(docs(spark, d), asked(spark, d), 0.7, 10)


_EN = "(SELECT * FROM documents WHERE lang = 'en')"
_MODES = f"""{_TOP}, sp AS (SELECT query_id, doc_id AS id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE doc_id IN (SELECT doc_id FROM {_EN}) QUALIFY rank <= 50),
dv AS (SELECT q.k AS query_id, x.k AS id, CASE WHEN list_sum(q.v) = 0 OR list_sum(x.v) = 0 THEN 0 ELSE round(list_cosine_similarity(q.v, x.v), 6) END AS score FROM {_hashed('benchmark', 'item_id')} q CROSS JOIN {_hashed(_EN, 'doc_id')} x),
de AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dv QUALIFY rank <= 50),
j AS (SELECT coalesce(de.query_id, sp.query_id) AS query_id, coalesce(de.id, sp.id) AS id, de.rank AS dense_rank, sp.rank AS sparse_rank, de.score AS dense_score, sp.score AS sparse_score FROM de FULL JOIN sp ON de.query_id = sp.query_id AND de.id = sp.id),
n AS (SELECT query_id, count(dense_rank) AS nd, count(sparse_rank) AS ns FROM j GROUP BY ALL),
m AS (SELECT 'dense' AS mode, query_id, id, dense_rank, CAST(NULL AS BIGINT) AS sparse_rank, dense_score, CAST(NULL AS DOUBLE) AS sparse_score, dense_score AS score FROM j WHERE dense_rank IS NOT NULL
UNION ALL SELECT 'hybrid_bm25', query_id, id, dense_rank, sparse_rank, dense_score, sparse_score, round(1.0::DOUBLE / (60 + coalesce(dense_rank, nd + 1)) + 1.0::DOUBLE / (60 + coalesce(sparse_rank, ns + 1)), 8) FROM j JOIN n USING (query_id)
UNION ALL SELECT 'hybrid_splade', query_id, id, dense_rank, sparse_rank, dense_score, sparse_score, round(coalesce(dense_score, 0) + coalesce(round(sparse_score * (1 - 0.7::DOUBLE), 8), 0), 8) FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY mode, query_id ORDER BY score DESC, id) AS rank FROM m QUALIFY rank <= 10)
SELECT r.*, CASE WHEN dense_rank IS NOT NULL THEN lang END AS lang, CASE WHEN sparse_rank IS NOT NULL THEN 'bm25:' ELSE '' END || source AS source, CASE WHEN sparse_rank IS NOT NULL THEN CAST(n_chars AS VARCHAR) END AS n_chars FROM r JOIN documents ON id = doc_id"""


@query(_MODES)
def hybrid_modes(spark, d):
    """All three modes over documents that a filter allows; it holds in both arms before their best 50 are taken, of which 10 stay."""
    t = table(spark, d, "documents").withColumn("language", F.col("lang"))
    where = R.predicate({"language": {"$eq": "en"}})
    allowed = t.filter(where)
    given = lambda rows, **fields: rows.join(allowed.select("doc_id", F.create_map(*[x for k, c in fields.items() for x in (F.lit(k), c.cast("string"))]).alias("metadata")), F.col("id") == F.col("doc_id")).drop("doc_id")
    q = asked(spark, d)
    v = allowed.select(F.col("doc_id").alias("vec_id"), dense.hashed_embedding(F.col("text")).alias("vector"))
    near = written(dense.top_k(q.select("query_id", dense.hashed_embedding(F.col("text")).alias("vector")), v, 50).withColumnRenamed("vec_id", "id"), "hybrid-dense")
    words = written(bm25.top_hits(t, q, 50, where=where).withColumnRenamed("doc_id", "id"), "hybrid-sparse")
    arms = given(near, lang=F.col("lang"), source=F.col("source")), given(words, source=F.concat(F.lit("bm25:"), F.col("source")), n_chars=F.col("n_chars"))
    found = [R.hybrid(*arms, mode=m) for m in R.MODES]
    every = found[0].unionByName(found[1]).unionByName(found[2])
    return every.select("mode", "query_id", "id", "dense_rank", "sparse_rank", "dense_score", "sparse_score", "score", "rank", *[F.col("metadata")[k].alias(k) for k in ("lang", "source", "n_chars")])


_TEXTS = f"{_HITS}, h AS (SELECT query_id, id, score, rank, text FROM hits JOIN documents ON id = doc_id WHERE rank <= 10)"
_LEX = f"""{_TEXTS}, c AS (SELECT query_id, id, term, count(*) AS tf FROM (SELECT query_id, id, unnest({S.bag('text')}) AS term FROM h) GROUP BY ALL),
qc AS (SELECT query_id, term, count(*) AS qtf FROM qt GROUP BY ALL), qn AS (SELECT query_id, sum(qtf * qtf) AS qn FROM qc GROUP BY ALL), cn AS (SELECT query_id, id, sum(tf * tf) AS cn FROM c GROUP BY ALL),
dot AS (SELECT query_id, id, sum(tf * qtf) AS dot FROM c JOIN qc USING (query_id, term) GROUP BY ALL),
lex AS (SELECT h.query_id, h.id, h.score, h.rank, coalesce(round(dot / sqrt(CAST(qn AS DOUBLE) * cn), 6), 0) AS lexical FROM h LEFT JOIN dot USING (query_id, id) LEFT JOIN qn USING (query_id) LEFT JOIN cn USING (query_id, id))"""


def with_text(spark, d, k=10):
    """The best k of each query with their texts, written once: what reads them several times doesn't search again."""
    return written(written(hits(spark, d, k), "hits").join(docs(spark, d), F.col("id") == F.col("doc_id")).drop("doc_id"), "hits-text")


def lexical(spark, d):
    q = asked(spark, d).withColumnRenamed("text", "query")
    return R.lexical_scores(q, with_text(spark, d))


@query(f"{_LEX} SELECT query_id, id, lexical, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, rank) AS new_rank FROM lex) WHERE new_rank <= 5")
def rerank_topk(spark, d):
    return R.rerank(lexical(spark, d), "lexical").select("query_id", "id", "lexical", "new_rank")


@query(f"{_LEX} SELECT query_id, id, score AS original_score, rank - new_rank AS position_change FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, rank) AS new_rank FROM lex) WHERE new_rank <= 5")
def rerank_delta(spark, d):
    return R.rerank(lexical(spark, d), "lexical").select("query_id", "id", F.col("score").alias("original_score"), "position_change")


@query(f"{_LEX} SELECT query_id, count(*) AS n_in, least(count(*), 5) AS n_out, round(avg(lexical), 5) AS mean, min(lexical) AS lo, max(lexical) AS hi FROM lex GROUP BY ALL")
def rerank_report(spark, d):
    return lexical(spark, d).groupBy("query_id").agg(F.count("*").alias("n_in"), F.least(F.count("*"), F.lit(5)).alias("n_out"), F.round(F.avg("lexical"), 5).alias("mean"), F.min("lexical").alias("lo"), F.max("lexical").alias("hi"))


@query(f"{_LEX} SELECT query_id, id, lexical FROM lex WHERE lexical >= 0.3")
def context_relevance(spark, d):
    return R.gate(lexical(spark, d), F.col("lexical"), 0.3).select("query_id", "id", "lexical")


@query(f"{_HITS} SELECT query_id, id, score FROM hits WHERE score >= 20")
def context_gate(spark, d):
    return R.gate(hits(spark, d), F.coalesce(F.lit(None).cast("double"), F.col("score")), 20.0).select("query_id", "id", "score")


@query(f"""{_TEXTS}, c AS (SELECT query_id, id, rank, term, count(*) AS tf FROM (SELECT query_id, id, rank, unnest({S.bag('text')}) AS term FROM h) GROUP BY ALL), n AS (SELECT query_id, id, sum(tf * tf) AS n FROM c GROUP BY ALL)
SELECT * FROM (SELECT a.query_id, a.id AS id_a, b.id AS id_b, round(sum(a.tf * b.tf) / sqrt(CAST(any_value(na.n) AS DOUBLE) * any_value(nb.n)), 6) AS cosine FROM c a JOIN c b ON a.query_id = b.query_id AND a.term = b.term AND a.rank < b.rank JOIN n na ON na.query_id = a.query_id AND na.id = a.id JOIN n nb ON nb.query_id = b.query_id AND nb.id = b.id GROUP BY a.query_id, a.id, b.id) WHERE cosine >= 0.95""")
def context_neardup_pairs(spark, d):
    return R.near_pairs(with_text(spark, d))


@query()
def context_dedup(spark, d):
    return R.dedup_context(with_text(spark, d)).select("query_id", "id", "rank", "score")


@query()
def context_control(spark, d):
    """Gate, dedup, lexical relevance; queries that keep nothing are flagged."""
    kept = R.dedup_context(R.gate(with_text(spark, d), F.col("score"), 20.0))
    q = asked(spark, d).withColumnRenamed("text", "query")
    kept = R.gate(R.lexical_scores(q, kept), F.col("lexical"), 0.1).groupBy("query_id").agg(F.count("*").alias("n_kept"))
    return asked(spark, d).select("query_id").join(kept, "query_id", "left").select("query_id", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), F.col("n_kept").isNull().alias("no_relevant_documents"))


_COST = "greatest(1, CAST(trunc(length(text) / 3.8::DOUBLE) AS INTEGER))"


@query(f"""{_TEXTS}, r AS (SELECT query_id, id, {_COST} AS cost, sum({_COST}) OVER (PARTITION BY query_id ORDER BY score DESC, id) AS used FROM h)
SELECT query_id, id, cost, CAST(used AS BIGINT) AS used, used > 6000 AS truncated FROM r WHERE used - cost < 6000""")
def context_pack(spark, d):
    return R.pack(with_text(spark, d), 6000, X.approx_tokens(F.col("text")), [F.desc("score"), F.col("id")]).select("query_id", "id", "cost", "used", "truncated")


@query(f"SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT conv_id, turn, sum({_COST}) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM conversations) WHERE used <= 2000")
def history_trim(spark, d):
    return R.trim_history(table(spark, d, "conversations")).select("conv_id", "turn", "used")


@query(f"{_TEXTS} SELECT query_id, id, round(score, 4) AS score, substring(text, 1, 200) AS snippet, '—' AS page FROM h")
def citations(spark, d):
    return with_text(spark, d).select("query_id", "id", F.round("score", 4).alias("score"), F.substring("text", 1, 200).alias("snippet"), F.coalesce(F.lit(None).cast("string"), F.lit("—")).alias("page"))


@query(f"{_TEXTS} SELECT query_id, id, round(score * (1 - 0.5::DOUBLE + 0.5 * pow(0.5, (id % 90) / 30.0::DOUBLE)), 6) AS decayed FROM h")
def decay_rescore(spark, d):
    """Our formula, as none is given: half of the score halves every 30 days of age."""
    age = F.col("id") % 90
    return with_text(spark, d).select("query_id", "id", F.round(F.col("score") * (1 - 0.5 + 0.5 * F.pow(F.lit(0.5), age / 30.0)), 6).alias("decayed"))


@query(f"""{_LEX}, s AS (SELECT query_id, count(*) AS retrieved FROM hits GROUP BY ALL), r AS (SELECT query_id, least(count(*), 5) AS reranked, count(*) FILTER (WHERE lexical >= 0.3) AS relevant FROM lex GROUP BY ALL)
SELECT item_id AS query_id, coalesce(retrieved, 0) AS retrieved, coalesce(reranked, 0) AS reranked, coalesce(relevant, 0) AS relevant FROM benchmark LEFT JOIN s ON s.query_id = item_id LEFT JOIN r ON r.query_id = item_id""")
def guardrail_audit(spark, d):
    s = hits(spark, d).groupBy("query_id").agg(F.count("*").alias("retrieved"))
    r = lexical(spark, d).groupBy("query_id").agg(F.least(F.count("*"), F.lit(5)).alias("reranked"), F.count_if(F.col("lexical") >= 0.3).alias("relevant"))
    j = asked(spark, d).select("query_id").join(s, "query_id", "left").join(r, "query_id", "left")
    return j.select("query_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("retrieved", "reranked", "relevant")])
