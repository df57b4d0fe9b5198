"""Steps of the chunk rules that take less than a fold a word: the same results as the folds and the plain rules."""

import random

import plain_chunks as plain
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking, folds

SPACES = [" "] * 60 + ["  ", "\n", "\n\n", "\t", " \n", "\r\n", "\x0b"]


def prose(rnd, n, spaces):
    word = lambda: rnd.choice(["alpha", "Beta", "gamma.", "Delta!", "x", "Ü?", "–", "a|b", "9.", "word" * 5])
    return "".join(word() + rnd.choice(spaces) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(18)
    lines = [" ".join(["w"] * n) for n in (29, 30, 31, 47, 48, 49, 129, 512, 513, 3000)] + [" " + "w  " * 700, "\t".join("w" * 600), "w " * 300 + "\t" + " w" * 300]
    every = " ".join(f"term{i}" for i in range(40))
    return lines + [f"{every}. {every} {every}. {every.upper()}. Same same same. Same other same.", *(prose(rnd, n, s) for n in (5, 80, 700, 4000) for s in ([" "], SPACES) for _ in range(3))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("rule, by", [(chunking.sentence, plain.by_sentence), (chunking.recursive, plain.recursive), (chunking.semantic, plain.semantic)])
@pytest.mark.parametrize("size, overlap", [(512, 50), (30, 12), (30, 0), (12, 30)])
def test_rules_without_rare_white_space(docs, texts, rule, by, size, overlap):
    got = sorted((r.doc_id, r.chunk_index, r.text, r.token_count) for r in rule(docs, size, overlap, 0).collect())
    assert got == [(i, k, c, plain.tokens(c)) for i, t in enumerate(texts) for k, c in enumerate(c for c in by(t, size, overlap) if c.strip())]


def test_tree_without_rare_white_space(docs, texts):
    want = sorted((i, f"{i}:{k}", f"{i}:{up}", t) for i, x in enumerate(texts) for k, up, kind, t in plain.hierarchy(x) if kind == "grandchild")
    assert sorted(map(tuple, chunking.expanded(docs).select("doc_id", "chunk_id", "child", "text").collect())) == want


def test_words_of_a_line_are_cut_by_their_numbers(spark):
    """no fold over single words where each is one token."""
    d = spark.createDataFrame([(" ".join(f"w{i}" for i in range(n)),) for n in range(1, 70)], "t string")
    for size, overlap in ((5, 0), (5, 4), (7, 3)):
        units = folds.each("array_remove(split(t, ' '), '')", lambda s: folds.unit(s, "1", str(folds.JOIN)))
        r = d.select(F.expr(folds.runs(units, size, overlap)).alias("a"), F.expr(f"{folds.windows('t', size, overlap)}.t").alias("b")).collect()
        assert all(x.a == x.b for x in r)


def test_similarity_sorts_without_a_comparator(spark):
    """word counts by Spark's own array functions; terms that many sentences share go by a fold of their sum."""
    sql = folds.similarities(folds.sentences("text"))
    assert "array_sort" not in sql
    shared = " ".join(f"t{i} t{i}" for i in range(folds.FEW_TERMS + 3))
    said = f"{shared}. {shared.title()} x. A b c a. A a d. ?! Zz. Zz"
    got = spark.createDataFrame([(said,)], "text string").select(F.expr(sql).alias("s")).first().s
    assert got == plain.similarities(plain.sentences(said)) and max(got) > 0.9 and 0 in got


def test_rare_white_space_is_found(spark):
    d = spark.createDataFrame([(f"a{c}b", c in folds.RARE) for c in (*folds.WHITE, "x", "é", "ß", "日")], "t string, rare boolean")
    assert d.filter(F.expr(f"{folds.has_rare('t')} <> rare")).count() == 0
    tokens = d.select("t", F.expr(folds.n_tokens("t")).alias("n"), F.expr(folds.n_tokens("t", False)).alias("clean"), "rare").collect()
    assert all(r.n == plain.tokens(r.t) and (r.rare or r.clean == r.n) for r in tokens)
