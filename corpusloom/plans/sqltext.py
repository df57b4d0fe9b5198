"""Pieces of SQL that several oracles share."""

from __future__ import annotations


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> '')"


def tokens(c: str) -> str:
    return f"CASE WHEN coalesce({c}, '') = '' THEN 0 ELSE greatest(1, CAST(round_even(len({words(c)}) * 1.3, 0) AS INTEGER)) END"


def bag(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


#: docs cut into windows of 393 words (512 tokens), windows under 50 tokens left out.
CHUNKS = f"""docw AS (SELECT doc_id, source, lang, {words('text')} AS w FROM documents),
chunks AS (SELECT doc_id, source, lang, CAST(k AS INTEGER) AS chunk_index, array_to_string(w[k * 393 + 1:(k + 1) * 393], ' ') AS text
  FROM docw, LATERAL (SELECT unnest(range(0, CAST(ceil(len(w) / 393.0) AS BIGINT))) AS k)
  WHERE CAST(round_even(len(w[k * 393 + 1:(k + 1) * 393]) * 1.3, 0) AS INTEGER) >= 50)"""

#: BM25 over documents: weight of each term in each document, six decimals.
BM25 = f"""tok AS (SELECT doc_id, unnest({bag('text')}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY ALL),
col AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl) * 1.0 / (SELECT count(*) FROM documents) AS avgdl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
postings AS (SELECT tf.term, tf.doc_id, tf.tf, round(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)), 6) AS weight
  FROM tf JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN col),
qt AS (SELECT item_id AS query_id, unnest({bag('text')}) AS term FROM benchmark),
scores AS (SELECT query_id, doc_id, CAST(sum(CAST(weight AS DECIMAL(18, 6))) AS DOUBLE) AS score FROM qt JOIN postings USING (term) WHERE weight > 0 GROUP BY ALL)"""

#: Cosine of every vec_id that 50 divides against all vectors, best 10.
DENSE = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 50 = 0),
dense_all AS (SELECT query_id, vec_id, label, round(list_cosine_similarity(qv, CAST(embedding AS DOUBLE[])), 6) AS score FROM q CROSS JOIN embeddings),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM dense_all) WHERE rank <= 10)"""

#: The same chunks as one query, for use within others.
CHUNK_ROWS = f"WITH {CHUNKS} SELECT * FROM chunks"
