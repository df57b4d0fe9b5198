"""The model slot, the records and the ingest job: failed rows, cached vectors, counts of each phase, upserts of touched namespaces."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking, embedding, ingest

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def chunks(spark):
    texts = ["abc abc", "zz", "123", None, "Hello", ""]
    return spark.createDataFrame([(i, t, t and sha(t), "x") for i, t in enumerate(texts)], "id long, text string, content_hash string, error string").repartition(2)


def test_two_models_through_one_slot(spark, chunks):
    a = {r.id: r for r in embedding.embed(chunks, embedding.hashing()).collect()}
    assert [len(a[i].vector) for i in range(6)] == [64] * 6 and sum(a[0].vector) == 2 and max(a[0].vector) == 2 and sum(a[5].vector) == 0
    assert [a[i].embed_error for i in range(6)] == [None, None, None, "no text", None, None] and a[0].error == "x"
    cached = spark.createDataFrame([(sha("zz"), [0.5] * 26), (sha("zz"), [0.25] * 26), (sha("Hello"), [1.0]), ("other", [0.0] * 26)], "content_hash string, vector array<double>")
    b = {r.id: r for r in embedding.embed(chunks, embedding.letters(), cached).collect()}
    assert b[0].vector[:3] == [1 / 3] * 3 and b[1].vector == [0.25] * 26 and b[4].vector[11] == 0.4
    assert [b[i].cache_hit for i in range(6)] == [False, True, False, False, False, False]  # one of another length is no hit
    assert b[2].embed_error == "ValueError: no letter in the text" and b[2].vector == [0.0] * 26 and b[5].embed_error.startswith("ValueError") and b[0].embed_error is None


def test_dimension_check():
    run = embedding.checked(lambda ts: np.ones((len(ts), 3)) if "long" not in ts else np.ones((len(ts), 4)), 3)
    v, why = run(["a", "long", "b"])
    assert v.tolist() == [[1] * 3, [0] * 3, [1] * 3] and why[0] == why[2] == "" and "shape (1, 4)" in why[1]
    v, why = embedding.checked(lambda ts: np.full((len(ts), 2), np.nan), 2)(["a"])
    assert v.tolist() == [[0, 0]] and "finite" in why[0]


def test_records(spark):
    d = spark.createDataFrame([(7, "t" * 1500, [4, 2], "Manual > Setup > Tools", "Manual.pdf", "pdf", "2024-01-02", "abcdef" * 5, 3, "Acme Inc", "docs")], "doc_id long, text string, page_numbers array<int>, title_prefix string, filename string, file_type string, published_at string, content_hash string, chunk_index int, tenant_id string, corpus string")
    r = ingest.records(d.withColumns({"vector": F.array(F.lit(1.0)), "embed_error": F.lit(None).cast("string")}), created_at=5).first()
    assert (r.namespace, r.id) == ("acme_inc__docs", "7:1:2:3") and r.metadata.asDict().keys() == set(ingest.METADATA) and len(ingest.METADATA) == 18
    m = r.metadata
    assert (m.page, m.section_path, len(m.text), m.published_at, m.mime, m.language, m.checksum, m.created_at, m.parent_id) == (2, "Setup > Tools", 1000, 1704153600, "application/pdf", "en", "abcdefabcdefabcd", 5, "")


def words(docs):
    return chunking.fixed(docs, size=13, min_tokens=1)  # windows of ten words


def test_job(spark, tmp_path):
    say = lambda k: " ".join(f"word{k}x{i}" for i in range(10))
    rows = [(1, say(1) + " " + say(2), "a.txt", "n1"), (2, say(1), "b.txt", "n1"), (3, None, "c.txt", "n1"), (4, "  ", "d.txt", "n1"), (5, say(5), "e.txt", "n1"), (6, say(6), "e.txt", "n1"), (7, say(6), "f.txt", "n2"), (8, "0123 456789 01", "g.txt", "n2"), (9, "short", "h.txt", "n2")]
    up = lambda rows: spark.createDataFrame([(i, t, f, "txt", i, "replace", "t", ns, "x") for i, t, f, ns in rows], "doc_id long, text string, filename string, file_type string, parsed_at long, strategy string, tenant_id string, corpus string, vector string").repartition(3)
    cached = spark.createDataFrame([(sha(say(2)), [2.0] + [0.0] * 25)], "content_hash string, vector array<double>")
    at = str(tmp_path / "store")
    got = {r.phase: r for r in ingest.run(up(rows), at, words, embedding.letters(), cached).collect()}
    # 3 and 4 are blank; 7 repeats 6; 6 replaces 5; the window of 2 repeats one of 1; 9 is short; 8 has no letter
    assert [(p, *got[p][2:7]) for p in got] == [("parse", 9, 7, 2, 0, 0), ("version", 7, 5, 2, 0, 0), ("chunk", 5, 6, 0, 0, 0), ("embed", 6, 3, 2, 1, 1), ("store", 4, 3, 0, 1, 0)]
    assert got["embed"].tokens == 13 + 13 + 4 and got["embed"].success_rate == 0.75 and got["embed"].cost_usd == round(30 / 1000 * 0.00002, 8)
    stored = lambda: {r.id: r for r in ingest.stored(spark, at).collect()}
    first = stored()
    assert set(first) == {"1:1:0:0", "1:1:0:1", "6:2:0:0"} and first["1:1:0:1"].vector[0] == 2.0 and {r.namespace for r in first.values()} == {"t__n1"}
    ingest.run(up([(20, say(20), "z.txt", "n2")]), at, words, embedding.letters())
    assert set(stored()) == {*first, "20:1:0:0"}
    ingest.run(up([(1, say(1) + " " + say(3), "a.txt", "n1")]), at, words, embedding.letters())
    again = stored()
    assert set(again) == {*first, "20:1:0:0"} and again["1:1:0:1"].metadata.checksum == sha(say(3))[:16] and again["6:2:0:0"].vector == first["6:2:0:0"].vector
    assert spark.read.parquet(f"{at}/phases").groupBy("run").count().agg(F.count("*"), F.min("count")).first()[:] == (3, 5)
    with pytest.raises(ValueError, match="confirm"):
        ingest.clear_namespace(spark, at, "t__n2")
    ingest.clear_namespace(spark, at, "t__n2", confirm="t__n2")
    assert set(stored()) == set(first)
    with pytest.raises(LookupError):
        ingest.clear_namespace(spark, at, "t__n2", confirm="t__n2")
    nothing = ingest.run(up(rows).limit(0), at, words, embedding.letters()).collect()
    assert [r.n_in for r in nothing] == [0] * 5 and set(stored()) == set(first)
