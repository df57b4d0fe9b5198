"""Screening of queries and answers: personal data, toxicity, injections, intents, grounding, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import folds

# Terms of each toxic category.
TOXIC = {
    "profanity": ["fuck", "shit", "asshole", "bastard", "bitch", "cunt", "dick", "piss off", "motherfucker"],
    "hate_speech": ["kill all", "subhuman", "go back to your country", "racial slur", "ethnic cleansing"],
    "violence": ["kill you", "i will kill", "bomb the", "shoot up", "murder you", "beat you up", "burn it down"],
    "abuse": ["you are worthless", "you are stupid", "shut up idiot", "you idiot"],
}

# Patterns of prompt injections and of jailbreaks.
INJECTION = [
    r"ignore\s+(all\s+)?(previous|prior|above)\s+instructions?",
    r"disregard\s+(all\s+)?(previous|prior|above)\s+instructions?",
    r"forget\s+(your\s+)?(system\s+prompt|instructions?|rules)",
    r"you\s+are\s+now\s+(dan|an?\s+unrestricted)",
    r"act\s+as\s+an?\s+unrestricted\s+ai",
    r"your\s+new\s+instructions?\s+(are|is)",
    r"new\s+system\s+prompt",
    r"reveal\s+(your\s+)?(system\s+prompt|hidden\s+instructions)",
    r"repeat\s+(the\s+)?(system\s+prompt|instructions)\s+(verbatim|exactly)",
    r"override\s+(your\s+)?(guidelines|instructions|rules)",
]
JAILBREAK = [
    r"pretend\s+(you\s+are|to\s+be)\s+an?\s+ai\s+(with\s+no|without)\s+restrictions",
    r"pretend\s+you\s+have\s+no\s+(rules|restrictions|filters)",
    r"in\s+a\s+fictional\s+world\s+where\s+(rules|laws)\s+don'?t\s+exist",
    r"hypothetically,?\s+if\s+you\s+had\s+no\s+restrictions",
    r"role\s*play\s+as\s+an?\s+ai\s+(with\s+no|without)\s+(rules|restrictions)",
    r"translate\s+this\s+to\s+base64.{0,40}(then|and)\s+(execute|run|decode)",
    r"decode\s+(this\s+)?base64.{0,40}(then|and)\s+(execute|run|follow)",
    r"do\s+anything\s+now",
    r"developer\s+mode\s+enabled",
    r"jailbreak",
]

# Patterns of intents, in the order in which they are tried.
GREETING = [r"^\s*(hi|hello|hey|good\s+(morning|afternoon|evening)|greetings|yo)\b[\s!.,]*$"]
CASUAL = [r"\bhow\s+are\s+you\b", r"\bwhat'?s\s+up\b", r"\bthank\s*(you|s)\b", r"\bwho\s+are\s+you\b", r"\bwhat\s+can\s+you\s+do\b", r"\bgood\s*bye\b|\bbye\b", r"\bhow'?s\s+it\s+going\b"]
OUT_OF_SCOPE = [r"\bwrite\s+(me\s+)?a\s+(poem|story|song|joke)\b", r"\bwho\s+(won|is\s+the\s+president|is\s+the\s+prime\s+minister)\b", r"\bwhat'?s\s+the\s+weather\b", r"\bgive\s+me\s+(dating|relationship|dietary|medical|legal)\s+advice\b", r"\bhow\s+do\s+i\s+(lose\s+weight|cook|bake)\b", r"\brecommend\s+a\s+(movie|book|restaurant)\b", r"\btrivia\b"]
DOCUMENT = [r"\bin\s+the\s+(document|file|report|pdf)\b", r"\baccording\s+to\s+the\s+(document|file|report)\b", r"\bsummarize\b.*\b(document|file|report)\b", r"\bthis\s+(document|file|pdf)\b"]
KNOWLEDGE = [r"\bpolicy|policies\b", r"\bcompliance\b", r"\bdocument|report|guideline|procedure|sop\b", r"\baccording to\b", r"\bwhat\s+(does|is|are)\b.*\b(policy|process|procedure|rule)\b", r"\bsection\s+\d", r"\brisk\s+assessment\b"]

# Patterns of personal data, in order.
PII = {
    "PAN": r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",
    "EMAIL": r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    "EMPLOYEE_ID": r"(?i)\bEMP[-_]?\d{3,10}\b",
    "CUSTOMER_ID": r"(?i)\bCUST[-_]?\d{3,10}\b",
    "CREDIT_CARD": r"\b(?:\d[ -]?){13,16}\b",
    "AADHAAR": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "ADDRESS": r"(?i)\b\d{1,5}\s+[A-Za-z0-9.,'\s]{3,40}(?:street|st\.|road|rd\.|avenue|ave\.|lane|ln\.|drive|dr\.|block|sector)[A-Za-z0-9.,'\s]{0,40}\b\d{5,6}\b",
    "PHONE": r"(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{2,4}\)?[-.\s]?)?\d{3,4}[-.\s]?\d{3,4}\b",
    "BANK_ACCOUNT": r"\b\d{9,18}\b",
}
# Digits of a match, limits of a query, what counts as an entity.
_DIGITS = {"CREDIT_CARD": (13, 16), "PHONE": (7, 13), "BANK_ACCOUNT": (9, 18)}

LIMITS = {"chars": 2000, "tokens": 500, "words": 300, "documents": 10}

_ENTITY = r"(?U)\b(?:[A-Z][a-zA-Z]{2,}(?:\s+[A-Z][a-zA-Z]{2,})*|\d[\d,.]*%?)\b"


def any_of(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(text.rlike("(?i)(?:" + ")|(?:".join(patterns) + ")"), F.lit(False))


def term_pattern(terms: list[str]) -> str:
    return r"\b(?:" + "|".join(t.replace(" ", r"\ ") for t in terms) + r")\b"


def toxic_categories(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(any_of(text, [term_pattern(t)]), name) for name, t in TOXIC.items()]))


def matched(text: Column, patterns: list[str]) -> Column:
    """Numbers (from 1) of the patterns found."""
    return F.array_compact(F.array(*[F.when(any_of(text, [p]), i + 1) for i, p in enumerate(patterns)]))


def intent(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.when(F.trim(t) == "", "out_of_scope").when(any_of(t, GREETING), "greeting").when(any_of(t, CASUAL), "casual").when(any_of(t, OUT_OF_SCOPE), "out_of_scope").when(any_of(t, DOCUMENT), "document").when(any_of(t, KNOWLEDGE), "knowledge").when(F.size(X.words(t)) >= 3, "knowledge").otherwise("casual")


def block_reason(text: Column, n_documents: Column | None = None) -> Column:
    """First failed check of a query, or null."""
    t = F.coalesce(text, F.lit(""))
    r = F.when(F.length(t) > LIMITS["chars"], "too_long").when(X.approx_tokens(t) > LIMITS["tokens"], "too_many_tokens").when(F.size(X.words(t)) > LIMITS["words"], "too_many_words")
    if n_documents is not None:
        r = r.when(n_documents > LIMITS["documents"], "too_many_documents")
    return r.when(F.size(toxic_categories(t)) > 0, "toxic").when(any_of(t, INJECTION), "prompt_injection").when(any_of(t, JAILBREAK), "jailbreak")


def _found(text: str, order: int, kind: str) -> str:
    """Spans of one pattern as an array of start, size, order, end, type: what lies between matches and the matches themselves, laid end to end."""
    pattern = PII[kind]
    pattern = 'r"' + ("(?iU)" + pattern.removeprefix("(?i)") if pattern.startswith("(?i)") else "(?U)" + pattern) + '"'
    a, x, end, m = (folds.name() for _ in range(4))
    digits = f"regexp_replace({m}, r'(?U)\\D', '')"
    lo, hi = _DIGITS.get(kind, (0, 0))
    good = f"length({digits}) BETWEEN {lo} AND {hi}" + (f" AND luhn_check({digits})" if kind == "CREDIT_CARD" else "") if hi else "true"
    step = f"named_struct('at', {a}.at + length({x}.p) + length({x}.m), 'out', concat({a}.out, array(named_struct('start', {a}.at + length({x}.p), 'm', {x}.m))))"
    laid = lambda hits: f"aggregate(zip_with(slice(split({text}, {pattern}), 1, size({hits})), {hits}, (p, m) -> named_struct('p', p, 'm', m)), named_struct('at', 0, 'out', CAST(array() AS array<struct<start:int,m:string>>)), ({a}, {x}) -> {step}, {end} -> {end}.out)"
    span = lambda h: folds.let(f"{h}.m", lambda t: f"if({good.replace(m, t)}, named_struct('start', {h}.start, 'size', -length({t}), 'order', {order}, 'end', {h}.start + length({t}), 'type', '{kind}'), NULL)")
    return folds.let(f"regexp_extract_all({text}, {pattern}, 0)", lambda hits: f"array_compact({folds.each(laid(hits), span)})")


def pii_spans(text: str) -> str:
    """SQL of the spans of all types in a text column, as array of type, start, end (places from 0): by start, then the longer one, then the order of PII; one that overlaps an earlier is left out."""
    a, x, end = folds.name(), folds.name(), folds.name()
    every = f"array_sort(concat({', '.join(_found(text, i, k) for i, k in enumerate(PII))}))"
    step = f"if({x}.start >= {a}.at, named_struct('at', {x}.end, 'out', concat({a}.out, array(named_struct('type', {x}.type, 'start', {x}.start, 'end', {x}.end)))), {a})"
    none = "CAST(array() AS array<struct<type:string,start:int,end:int>>)"
    kept = f"aggregate({every}, named_struct('at', 0, 'out', {none}), ({a}, {x}) -> {step}, {end} -> {end}.out)"
    return f"if({text} RLIKE r'[\\p{{Nd}}@]', {kept}, {none})"  # every pattern needs a digit of any script or an @


def mask(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with `pii_spans` (type, start, end), `masked` and `pii_types`, on the JVM. Null text: no spans, masked is null. A card number in other digits than 0-9 isn't taken for one."""
    d = rows.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("pii_spans", F.expr(pii_spans("_t")))
    before = lambda i: f"if({i} = 0, 0, get(pii_spans, {i} - 1).end)"
    parts = folds.each_at("pii_spans", lambda s, i: f"concat(substring(_t, {before(i)} + 1, {s}.start - {before(i)}), '[', {s}.type, '_REDACTED]')")
    masked = F.when(F.size("pii_spans") == 0, F.col(text)).otherwise(F.expr(f"concat(array_join({parts}, ''), substring(_t, get(pii_spans, size(pii_spans) - 1).end + 1, length(_t)))"))
    return d.withColumns({"masked": masked, "pii_types": F.array_distinct("pii_spans.type")}).drop("_t")


def pii_counts(rows: DataFrame, by: str, text: str = "text") -> DataFrame:
    """by, type, n_spans, n_rows of all types."""
    found = mask(rows, text).select(by, F.col("pii_spans.type").alias("t"))
    each = found.select(by, F.explode(F.transform(F.array_distinct("t"), lambda k: F.struct(k.alias("type"), F.size(F.filter("t", lambda x: x == k)).alias("n")))).alias("c"))
    return each.groupBy(by, F.col("c.type").alias("type")).agg(F.sum("c.n").alias("n_spans"), F.count("*").alias("n_rows"))


def groundedness(answers: DataFrame, threshold: float = 0.35) -> DataFrame:
    """answers (answer_id, answer, context): share of sentences with enough of their words in the context.

    Sentences of fewer than 4 words, those that start with `sources` and those of stop words alone pass. No sentence: 1; no context: 0.
    """
    known = X.without(X.bag(F.col("context")), X.ANSWER_STOP_WORDS)
    s = answers.select("answer_id", F.coalesce("context", F.lit("")).alias("context"), F.array_distinct(known).alias("known"), F.explode_outer(X.sentences(F.col("answer"))).alias("s"))
    s = s.withColumn("t", F.array_distinct(X.without(X.bag(F.col("s")), X.ANSWER_STOP_WORDS)))
    easy = (F.size(X.words(F.col("s"))) < 4) | F.lower("s").startswith("sources") | (F.size("t") == 0)
    ok = easy | (F.size(F.array_intersect("t", "known")) / F.size("t") >= threshold)
    score = F.when(F.first("context") == "", 0.0).otherwise(F.coalesce(F.avg(F.when(F.col("s").isNotNull(), ok.cast("double"))), F.lit(1.0)))
    return s.groupBy("answer_id").agg(F.round(score, 6).alias("groundedness"))


def entities(text: Column) -> Column:
    return F.filter(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_ENTITY), F.lit(0))), lambda e: F.length(e) > 2)


def hallucination(answers: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Share of an answer's names and numbers that its context lacks."""
    e = answers.select("answer_id", F.lower(F.coalesce("context", F.lit(""))).alias("c"), F.explode_outer(entities(F.col("answer"))).alias("e"))
    rate = F.round(F.coalesce(F.avg(F.when(F.col("e").isNotNull(), (~F.contains("c", F.lower("e"))).cast("double"))), F.lit(0.0)), 6)
    return e.groupBy("answer_id").agg(rate.alias("rate")).withColumn("detected", F.col("rate") >= threshold)


def citations(answers: DataFrame) -> DataFrame:
    """answers (answer_id, answer, n_sources): valid and invalid [Source N] numbers, and the answer without the invalid marks."""
    cited = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(r"(?i)\[Source\s+(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))))
    a = answers.withColumn("cited", cited).withColumn("valid", F.filter("cited", lambda n: n.between(1, F.col("n_sources")))).withColumn("invalid", F.array_except("cited", "valid"))
    clean = F.aggregate("invalid", F.coalesce("answer", F.lit("")), lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"(?i)\[Source\s+"), n.cast("string"), F.lit(r"\]")), F.lit("")))
    return a.withColumn("clean", clean)


def answer_safety(answers: DataFrame) -> DataFrame:
    """answers (answer_id, answer, context, n_sources) to action and text: block, disclaim, clean, mask, in that order."""
    d = citations(answers).join(groundedness(answers), "answer_id").join(hallucination(answers), "answer_id")
    action = F.when(F.col("detected"), "blocked_hallucination").when(F.size(toxic_categories(F.col("clean"))) > 0, "blocked_toxic").when(F.col("groundedness") < 0.75, "disclaimer").otherwise("passed")
    d = d.withColumn("action", action)
    return mask(d, "clean").select("answer_id", "action", "groundedness", "rate", "invalid", F.when(F.col("action").startswith("blocked"), None).otherwise(F.col("masked")).alias("text"), "pii_types")
