"""Text expressions: words, token counts, hashes, sentences, language and policy signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the sparse-vector tokeniser.
SPARSE_STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "did", "not", "this", "that", "it", "its", "as", "by", "from", "up", "out", "if", "so", "no", "we", "you", "he", "she", "they", "i", "my", "your", "our"]

# Stop words of the answer checks.
ANSWER_STOP_WORDS = ["the", "a", "an", "is", "are", "was", "were", "in", "on", "of", "to", "and", "or", "for", "with", "this", "that", "it", "as", "by", "at", "be", "has", "have", "had", "not", "but", "from", "into", "your", "you", "i", "we", "they", "he", "she"]

# Words of policy and legal texts.
POLICY_TITLE = r"(?i)\b(policy|regulation|compliance|directive|bylaw|statute|ordinance|agreement|contract|procedure|guideline)\b"
POLICY_KEYWORDS = ["policy", "policies", "regulation", "regulations", "regulatory", "compliance", "compliant", "legislation", "legislative", "statute", "statutes", "act ", "acts ", "bylaw", "bye-law", "ordinance", "directive", "directives", "procedure", "procedures", "protocol", "protocols", "guideline", "guidelines", "framework", "frameworks", "clause", "clauses", "section", "sections", "article ", "articles ", "schedule", "schedules", "appendix", "annex", "terms and conditions", "terms of service", "privacy policy", "data protection", "contract", "agreement", "obligation", "obligations", "liability", "indemnity", "warranty", "warranties"]


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def token_count(text: Column) -> Column:
    """1.3 tokens a word, half to even, at least 1; 0 for null and empty."""
    n = F.greatest(F.lit(1), F.bround(F.size(words(text)) * F.lit(1.3)).cast("int"))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(n)


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), (F.length(F.coalesce(text, F.lit(""))) / F.lit(3.8)).cast("int"))


def truncate(text: Column, max_tokens: int) -> Column:
    """Cut by the share of characters that max_tokens are of the text's tokens."""
    n = token_count(text)
    return F.when(n <= max_tokens, text).otherwise(F.rtrim(F.substring(text, F.lit(1), F.floor(F.length(text) * F.lit(float(max_tokens)) / n).cast("int"))))


def bag(text: Column) -> Column:
    """Runs of [a-z0-9] of the lower-cased text: what is left between the others, which takes half the time of matching each."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def without(tokens: Column, stop: list[str]) -> Column:
    return F.filter(tokens, lambda x: ~x.isin(*stop))


def letters_only(text: Column) -> Column:
    """Words of two or more of a-z, between word boundaries of Unicode."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b([a-z]{2,})\b"), F.lit(1))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), F.trim), lambda s: s != "")


def chunk_sentences(text: Column) -> Column:
    """Breaks before a capital or a quote, and at blank lines."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+(?=[A-Z\"])|(?<=\n)\s*\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def normalised_hash(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")), r"\s+", " "), 256)


def language(text: Column) -> Column:
    """A script's language by its first 500 characters; null if too short or unclear."""
    t = F.substring(text, 1, 500)
    ascii_share = F.length(F.regexp_replace(t, r"[^\x00-\x7F]", "")) / F.length(t)
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) < 20, None).when(t.rlike("[一-鿿]"), "zh").when(t.rlike("[Ѐ-ӿ]"), "ru").when(t.rlike("[؀-ۿ]"), "ar").when(ascii_share >= 0.85, "en")


def is_policy(title: Column, text: Column) -> Column:
    head = F.lower(F.concat_ws(" ", title, F.substring(text, 1, 500)))
    sample = F.substring(F.lower(F.coalesce(text, F.lit(""))), 1, 2000)
    hits = F.size(F.filter(F.array(*map(F.lit, POLICY_KEYWORDS)), lambda k: F.contains(sample, k)))
    return head.rlike(POLICY_TITLE) | (hits >= 3)
