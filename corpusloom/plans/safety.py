"""Queries that screen documents, queries and answers. An answer is an assistant turn, its context the turn before."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import safety as G
from . import sqltext as S
from .registry import query, table


def re2(patterns: list[str]) -> str:
    return "'(?i)(?:" + ")|(?:".join(patterns).replace("'", "''") + ")'"


def _toxic(c: str) -> str:
    parts = [f"CASE WHEN regexp_matches({c}, {re2([G.term_pattern(t).replace(chr(92) + ' ', ' ')])}) THEN '{n}' END" for n, t in G.TOXIC.items()]
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string({_toxic('text')}, ',') AS categories FROM documents")
def toxicity_flags(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(G.toxic_categories(F.col("text")), ",").alias("categories"))


def _numbers(c: str, patterns: list[str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({c}, {re2([p])}) THEN {i + 1} END" for i, p in enumerate(patterns)) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string({_numbers('text', G.INJECTION)}, ',') AS injections, array_to_string({_numbers('text', G.JAILBREAK)}, ',') AS jailbreaks FROM documents")
def injection_flags(spark, d):
    j = lambda p: F.array_join(F.transform(G.matched(F.col("text"), p), lambda x: x.cast("string")), ",")
    return table(spark, d, "documents").select("doc_id", j(G.INJECTION).alias("injections"), j(G.JAILBREAK).alias("jailbreaks"))


_INTENT = "CASE WHEN trim(text) = '' THEN 'out_of_scope' " + " ".join(f"WHEN regexp_matches(text, {re2(p)}) THEN '{n}'" for p, n in ((G.GREETING, "greeting"), (G.CASUAL, "casual"), (G.OUT_OF_SCOPE, "out_of_scope"), (G.DOCUMENT, "document"), (G.KNOWLEDGE, "knowledge"))) + f" WHEN len({S.words('text')}) >= 3 THEN 'knowledge' ELSE 'casual' END"


@query(f"SELECT conv_id, turn, {_INTENT} AS intent FROM conversations WHERE role = 'user'")
def intent_route(spark, d):
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", G.intent(F.col("text")).alias("intent"))


_BLOCK = f"CASE WHEN length(text) > 2000 THEN 'too_long' WHEN greatest(1, CAST(trunc(length(text) / 3.8::DOUBLE) AS INTEGER)) > 500 THEN 'too_many_tokens' WHEN len({S.words('text')}) > 300 THEN 'too_many_words' WHEN len({_toxic('text')}) > 0 THEN 'toxic' WHEN regexp_matches(text, {re2(G.INJECTION)}) THEN 'prompt_injection' WHEN regexp_matches(text, {re2(G.JAILBREAK)}) THEN 'jailbreak' END"


@query(f"SELECT doc_id, {_BLOCK} AS block_reason FROM documents")
def input_screen(spark, d):
    return table(spark, d, "documents").select("doc_id", G.block_reason(F.col("text")).alias("block_reason"))


@query(f"SELECT coalesce({_BLOCK}, {_INTENT}) AS route, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY ALL")
def query_route_counts(spark, d):
    u = table(spark, d, "conversations").filter("role = 'user'")
    return u.groupBy(F.coalesce(G.block_reason(F.col("text")), G.intent(F.col("text"))).alias("route")).agg(F.count("*").alias("n"))


@query("SELECT source, count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.-]+')) AS n_email FROM documents GROUP BY ALL")
def pii_types_by_source(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("text").rlike(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+")).alias("n_email"))


@query("SELECT doc_id, regexp_replace(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.-]*[A-Za-z0-9_]', '[EMAIL_REDACTED]', 'g') AS text FROM documents")
def pii_email_mask(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]*[A-Za-z0-9_]", "[EMAIL_REDACTED]").alias("text"))


@query()
def pii_mask(spark, d):
    return G.mask(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "masked", F.array_join("pii_types", ",").alias("types"))


def answers(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("context", F.coalesce(F.lag("text").over(w), F.lit("")))
    # every second answer cites two sources of which one is supplied
    said = F.when(F.col("turn") % 4 == 1, F.concat("text", F.lit(" [Source 1] and [source 9]."))).otherwise(F.col("text"))
    return c.filter("role = 'assistant'").select(F.concat_ws(":", "conv_id", "turn").alias("answer_id"), said.alias("answer"), "context", F.lit(3).alias("n_sources"))


_A = "a AS (SELECT conv_id || ':' || turn AS answer_id, CASE WHEN turn % 4 = 1 THEN text || ' [Source 1] and [source 9].' ELSE text END AS answer, context FROM (SELECT *, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS context FROM conversations) WHERE role = 'assistant')"
_KNOWN = f"list_filter({S.bag('context')}, lambda x: x NOT IN {S.in_list(X.ANSWER_STOP_WORDS)})"


@query()
def pii_spans_by_source(spark, d):
    """Spans and documents of all nine types, by source."""
    return G.pii_counts(table(spark, d, "documents").select("source", "text"), "source")


@query(f"""WITH {_A}, s AS (SELECT answer_id, context, {_KNOWN} AS known, unnest(list_filter(list_transform(string_split(regexp_replace(answer, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS s FROM a),
t AS (SELECT *, list_distinct(list_filter({S.bag('s')}, lambda x: x NOT IN {S.in_list(X.ANSWER_STOP_WORDS)})) AS t FROM s),
ok AS (SELECT answer_id, context, CASE WHEN len({S.words('s')}) < 4 OR starts_with(lower(s), 'sources') OR len(t) = 0 THEN 1 WHEN len(list_intersect(t, known)) / len(t)::DOUBLE >= 0.35 THEN 1 ELSE 0 END AS ok FROM t)
SELECT answer_id, round(CASE WHEN any_value(context) = '' THEN 0 ELSE avg(ok) END, 6) AS groundedness FROM ok GROUP BY answer_id""")
def groundedness(spark, d):
    return G.groundedness(answers(spark, d))


@query(f"""WITH {_A}, e AS (SELECT answer_id, lower(context) AS c, list_filter(list_distinct(regexp_extract_all(regexp_replace(answer, '[À-ÖØ-öø-ÿŒœ]', '_', 'g'), '\\b(?:[A-Z][a-zA-Z]{{2,}}(?:\\s+[A-Z][a-zA-Z]{{2,}})*|\\d[\\d,.]*%?)\\b')), lambda x: length(x) > 2) AS es FROM a)
SELECT answer_id, rate, rate >= 0.5 AS detected FROM (SELECT answer_id, round(CASE WHEN len(es) = 0 THEN 0 ELSE len(list_filter(es, lambda x: NOT contains(c, lower(x)))) / len(es)::DOUBLE END, 6) AS rate FROM e)""")
def hallucination(spark, d):
    """Word boundaries are those of Unicode; the SQL gets them by making other letters word characters."""
    return G.hallucination(answers(spark, d))


@query(f"WITH {_A} SELECT answer_id, CASE WHEN contains(answer, '[Source 1]') THEN '1' ELSE '' END AS valid, CASE WHEN contains(answer, '[Source 1]') THEN '9' ELSE '' END AS invalid, regexp_replace(answer, '(?i)\\[Source\\s+9\\]', '', 'g') AS clean FROM a")
def citation_check(spark, d):
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return G.citations(answers(spark, d)).select("answer_id", join("valid").alias("valid"), join("invalid").alias("invalid"), "clean")


@query()
def answer_safety(spark, d):
    return G.answer_safety(answers(spark, d)).select("answer_id", "action", "groundedness", "rate", F.sha2("text", 256).alias("text_sha"), F.array_join("pii_types", ",").alias("pii_types"))
