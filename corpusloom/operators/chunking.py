"""Splitting documents into chunks: one function for each strategy, and the job that routes between them.

All take documents (doc_id, text, ...) and give (doc_id, chunk_index, text). Fixed windows are array
arithmetic, greedy strategies the folds of `folds`; all of it runs inside a document's row on the JVM. Chunks under `min_tokens` are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import folds

SIZE, OVERLAP, MIN_TOKENS = 512, 50, 50
SEMANTIC_OVERLAP, PERCENTILE = int(SIZE * 0.15), 95
TIERS = (2048, 512, 128)
TABLE_TOKENS = 600


def fixed(docs: DataFrame, size: int = SIZE, overlap: int = 0, min_tokens: int = MIN_TOKENS) -> DataFrame:
    w = int(size / 1.3)
    step = w - int(min(overlap, size // 2) / 1.3)
    d = docs.select("doc_id", X.words(F.coalesce("text", F.lit(""))).alias("w")).filter(F.size("w") > 0)
    last = F.ceil(F.greatest(F.size("w") - w, F.lit(0)) / F.lit(step)).cast("int")
    d = d.select("doc_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    part = F.slice("w", F.col("chunk_index") * step + 1, w)
    d = d.select("doc_id", "chunk_index", part.alias("p"))
    n = F.greatest(F.lit(1), F.bround(F.size("p") * F.lit(1.3)).cast("int"))
    return d.select("doc_id", "chunk_index", F.array_join("p", " ").alias("text"), n.alias("token_count")).filter(F.col("token_count") >= min_tokens)


def _given(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _kept(chunks: str, min_tokens: int, rare: bool = True) -> str:
    """Chunks (text, token_count) of at least `min_tokens` that aren't blank."""
    measured = folds.each(chunks, lambda c: f"named_struct('text', {c}, 'token_count', {folds.n_tokens(c, rare)})")
    return folds.those(measured, lambda c: f"{c}.token_count >= {max(min_tokens, 1)} AND {folds.strip(f'{c}.text')} <> ''")


def _ruled(docs: DataFrame, rule: Callable[[bool], str], min_tokens: int) -> DataFrame:
    found = _given(docs).select("doc_id", F.posexplode(F.expr(folds.either("text", lambda rare: _kept(rule(rare), min_tokens, rare)))).alias("chunk_index", "c"))
    return found.select("doc_id", "chunk_index", "c.text", "c.token_count")


def sentence(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, min_tokens: int = MIN_TOKENS) -> DataFrame:
    return _ruled(docs, lambda rare: folds.sentence_chunks("text", size, overlap, rare), min_tokens)


def recursive(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, min_tokens: int = MIN_TOKENS) -> DataFrame:
    return _ruled(docs, lambda rare: folds.recursive_chunks("text", size, overlap, rare), min_tokens)


def semantic(docs: DataFrame, size: int = SIZE, overlap: int = SEMANTIC_OVERLAP, min_tokens: int = MIN_TOKENS) -> DataFrame:
    return _ruled(docs, lambda rare: folds.semantic_chunks("text", size, overlap, PERCENTILE, rare), min_tokens)


def tiers(docs: DataFrame, sizes: tuple[int, int, int] = TIERS) -> DataFrame:
    """docs with `parents` (texts), `children` (up: number of the parent, t) and `grandchildren` (up: number of the child, t), all in order."""
    by = lambda build: F.expr(f"if(_rare, {build(True)}, {build(False)})")
    cut = lambda texts, t, size, rare: f"flatten({folds.each_at(texts, lambda x, i: folds.each(folds.recursive_chunks(x + t, size, 0, rare), lambda c: f"named_struct('up', {i}, 't', {c})"))})"
    below = lambda texts, t, size: by(lambda rare: cut(texts, t, size, rare))
    d = docs.withColumn("_rare", F.expr(folds.has_rare("text")))
    d = d.withColumn("parents", by(lambda rare: folds.recursive_chunks("text", sizes[0], 0, rare)))
    return d.withColumn("children", below("parents", "", sizes[1])).withColumn("grandchildren", below("children", ".t", sizes[2])).drop("_rare")


def tier_rows(key: str | None = None) -> str:
    """Parents, children and grandchildren of `tiers` as one array: chunk_id, parent_chunk_id, chunk_type, text."""
    named = lambda letter, i: f"concat({f"CAST({key} AS STRING), ':', " if key else ''}'{letter}', CAST({i} AS STRING))"
    row = lambda me, up, kind, t: f"named_struct('chunk_id', {me}, 'parent_chunk_id', {up}, 'chunk_type', '{kind}', 'text', {t})"
    p = folds.each_at("parents", lambda t, i: row(named("P", i), "CAST(NULL AS STRING)", "parent", t))
    c = folds.each_at("children", lambda x, i: row(named("C", i), named("P", f"{x}.up"), "child", f"{x}.t"))
    g = folds.each_at("grandchildren", lambda x, i: row(named("G", i), named("C", f"{x}.up"), "grandchild", f"{x}.t"))
    return f"concat({p}, {g}, {c})"


def hierarchical(docs: DataFrame) -> DataFrame:
    """doc_id, chunk_id, parent_chunk_id, chunk_type, text of all three tiers."""
    return tiers(_given(docs)).select("doc_id", F.inline(F.expr(tier_rows("doc_id"))))


def expanded(docs: DataFrame) -> DataFrame:
    """Grandchildren of docs (doc_id, text) with the texts of their child and parent, within each document's row: as `expand_tree` of `hierarchical`."""
    up = lambda g: f"get(children, {g}.up)"
    row = lambda g, i: f"named_struct('chunk_id', concat(doc_id, ':G', {i}), 'child', concat(doc_id, ':C', {g}.up), 'parent', concat(doc_id, ':P', {up(g)}.up), 'text', {g}.t, 'child_text', {up(g)}.t, 'parent_text', get(parents, {up(g)}.up))"
    return tiers(_given(docs)).select("doc_id", F.inline(F.expr(folds.each_at("grandchildren", row))))


def expand_tree(chunks: DataFrame) -> DataFrame:
    """Each grandchild with the texts of its child and its parent."""
    up = lambda a: chunks.select(F.col("chunk_id").alias(a), F.col("parent_chunk_id").alias(f"{a}_parent"), F.col("text").alias(f"{a}_text"))
    g = chunks.filter("chunk_type = 'grandchild'").select("doc_id", "chunk_id", F.col("parent_chunk_id").alias("child"), "text")
    return g.join(up("child"), "child").join(up("parent").drop("parent_parent"), F.col("child_parent") == F.col("parent")).select("doc_id", "chunk_id", "child", "parent", "text", "child_text", "parent_text")


def semantic_breaks(docs: DataFrame) -> DataFrame:
    """Similarity of each sentence with the one before, and whether it starts a chunk."""
    d = _given(docs).select("doc_id", F.expr(folds.similarities(folds.sentences("text"))).alias("sims"))
    d = d.select("doc_id", F.expr(folds.threshold("sims", PERCENTILE)).alias("cut"), F.posexplode("sims").alias("i", "similarity"))
    return d.select("doc_id", (F.col("i") + 1).alias("sentence"), "similarity", (F.col("similarity") < F.col("cut")).alias("breaks"))


def lines(docs: DataFrame, col: str = "text") -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce(col, F.lit("")), "\n")).alias("line_no", "line"))


def headings(docs: DataFrame) -> DataFrame:
    """Each line with the nearest heading at or before it: # to ######, or 3 to 10 words in capitals."""
    line = F.trim("line")
    capital = (line == F.upper(line)) & (line != F.lower(line)) & F.size(X.words(line)).between(3, 10) & line.rlike(r"^[A-Z][A-Z0-9 ,.&'-]+$")
    found = F.when(line.rlike(r"^#{1,6} +\S"), F.regexp_replace(line, r"^#{1,6} +", "")).when(capital, line)
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines(docs).withColumn("heading", F.last(found, ignorenulls=True).over(w))


def table_blocks(docs: DataFrame, col: str = "text") -> DataFrame:
    """Runs of lines like |...|: doc_id, first line, number of lines, text, whether the second is a separator."""
    return docs.select("doc_id", F.coalesce(col, F.lit("")).alias("text")).select("doc_id", F.inline(F.expr(folds.tables("text"))))


def table_chunks(docs: DataFrame, col: str = "text", limit: int = TABLE_TOKENS) -> DataFrame:
    """Tables up to `limit` tokens whole; longer ones in batches of rows, each below the header."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(col, F.lit("")).alias("text"))
    d = d.select("doc_id", F.explode(F.expr(folds.tables("text"))).alias("t"))
    return d.select("doc_id", F.col("t.first_line").alias("first_line"), F.inline(F.expr(folds.table_parts("t", limit))))


def strategy(file_type: Column, title: Column, text: Column) -> Column:
    return F.when(file_type.isin("csv", "xlsx"), "fixed_size").when(file_type == "txt", "sentence_based").when(X.is_policy(title, text), "hierarchical").otherwise("recursive")


def first_of(chunks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return chunks.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def reindex(chunks: DataFrame) -> DataFrame:
    """Text chunks 0..n-1, then table chunks."""
    w = Window.partitionBy("doc_id").orderBy("is_table", "chunk_index")
    return chunks.withColumn("new_index", F.row_number().over(w) - 1)


def fixed_chunks(text: str, size: int) -> str:
    """Windows of words, as `fixed` cuts them."""
    width = int(size / 1.3)
    cut = lambda w: folds.each(f"sequence(0, CAST((size({w}) - 1) DIV {width} AS INT))", lambda j: f"array_join(slice({w}, {j} * {width} + 1, {width}), ' ')")
    return folds.let(folds.those(f"split({text}, r'\\s+')", lambda w: f"{w} <> ''"), lambda w: f"if(size({w}) > 0, {cut(w)}, CAST(array() AS array<string>))")


def chunk_job(docs: DataFrame) -> DataFrame:
    """docs (doc_id, file_type, title, text) to routed, deduplicated, numbered chunks: one pass, each document within its row.

    A chunk stays if none of its document's chunks of that type before it has its content. Text chunks are numbered first, then those of tables.
    """
    text = F.col("text")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), strategy(F.col("file_type"), F.col("title"), text).alias("strategy"), F.coalesce(text, F.lit("")).alias("whole"))
    d = tiers(d.withColumn("text", F.when(F.col("strategy") == "hierarchical", F.col("whole")).otherwise("")))
    row = lambda kind, t, n: f"named_struct('chunk_type', {kind}, 'content_hash', sha2({t}, 256), 'text', {t}, 'token_count', {n})"
    of = lambda chunks: folds.each(_kept(chunks, MIN_TOKENS), lambda c: row("'text'", f"{c}.text", f"{c}.token_count"))
    of_tiers = folds.each(tier_rows(), lambda r: row(f"{r}.chunk_type", f"{r}.text", folds.n_tokens(f"{r}.text")))
    routed = f"CASE strategy WHEN 'hierarchical' THEN {of_tiers} WHEN 'fixed_size' THEN {of(fixed_chunks('whole', SIZE))} WHEN 'sentence_based' THEN {of(folds.sentence_chunks('whole', SIZE, OVERLAP))} ELSE {of(folds.recursive_chunks('whole', SIZE, OVERLAP))} END"
    tables = folds.each(f"flatten({folds.each(folds.tables('whole'), lambda t: folds.table_parts(t, TABLE_TOKENS))})", lambda p: row("'table'", f"{p}.text", folds.n_tokens(f"{p}.text")))
    every = folds.let(f"concat({routed}, {tables})", lambda c: folds.first_of_each(c, lambda x: f"named_struct('type', {x}.chunk_type, 'hash', {x}.content_hash)"))
    d = d.select("doc_id", "strategy", F.posexplode(F.expr(every)).alias("new_index", "c")).select("doc_id", "new_index", "strategy", "c.*")
    table = F.col("chunk_type") == "table"
    return d.withColumn("strategy", F.when(table, "table").otherwise(F.col("strategy"))).withColumn("is_table", table)
