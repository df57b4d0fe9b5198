"""What the Jaccard join writes follows the sets that can have partners and the distinct texts, however many shingles are repeated."""

import random

from pyspark.sql import functions as F

from corpusloom.llm import jaccard


def written_by(monkeypatch, docs, **how):
    frames, write = {}, jaccard.materialise
    monkeypatch.setattr(jaccard, "materialise", lambda df, tag, *more: frames.setdefault(tag, write(df, tag, *more)))
    found = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs, **how).collect()}
    return found, frames


def test_sets_without_partners_are_not_written(spark, monkeypatch):
    """A full filter of fixed size took all shingles for repeated ones, so that all sets and all their shingles were written and posted."""
    r = random.Random(4)
    plain = [" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(300)]
    near = [t.rsplit(" ", 2)[0] for t in plain[:20]]
    docs = spark.createDataFrame(list(enumerate(plain + near)), "doc_id long, text string").repartition(4)
    found, frames = written_by(monkeypatch, docs, filter_bits=1 << 12, frequent=64)
    assert found == {i: i - 300 if i >= 300 else i for i in range(320)}
    assert frames["jaccard-sets"].filter("prefix IS NOT NULL").count() == 40
    assert frames["jaccard-sets"].agg(F.max(F.size("tokens"))).first()[0] == 54
    assert frames["jaccard-postings"].count() <= 40 * (14 + jaccard.MAX_MATCH)


def test_equal_texts_are_written_once(spark, monkeypatch):
    """Copies in different partitions were sets of their own, all of whose shingles were repeated."""
    docs = spark.range(0, 400, 1, 8).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d e f g h i "), F.col("id") % 10).alias("text"))
    found, frames = written_by(monkeypatch, docs)
    assert found == {i: i % 10 for i in range(400)}
    assert frames["jaccard-sets"].count() == 10


def test_packs_and_ranges_of_any_size(spark, monkeypatch):
    r = random.Random(5)
    base = [" ".join(f"w{r.randrange(50)}" for _ in range(40)) for _ in range(40)]
    texts = [*base, *[t + " end" for t in base], *[t.upper() for t in base], "", "w1 w2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {i: i % 40 for i in range(120)} | {120: 120, 121: 121}
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == want
    monkeypatch.setattr(jaccard, "PACK", 50)
    monkeypatch.setattr(jaccard, "RANGE", 10)
    monkeypatch.setattr(jaccard, "PACK_DOCS", 2)
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == want


def test_pipeline_near_writes_equal_texts_once(spark, monkeypatch):
    import corpus_pipeline

    frames, write = {}, jaccard.materialise
    monkeypatch.setattr(jaccard, "materialise", lambda df, tag, *more: frames.setdefault(tag, write(df, tag, *more)))
    docs = spark.range(0, 80, 1, 8).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d e f g h i "), F.col("id") % 10).alias("text"), F.lit("en").alias("lang"))
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == list(range(10))
    assert frames["jaccard-sets"].count() == 10
