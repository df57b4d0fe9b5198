"""Blended search over all documents: a document far down both arms can be the best of their sum."""

import math
import re
from collections import Counter

import pytest

from corpusloom.operators import blended, bm25, dense


def plain(docs, queries, k, alpha=0.7):
    """Brute force over (id, text) and (query_id, text)."""
    import hashlib

    bag = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    vector = lambda t: Counter(int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % 64 for w in bag(t))
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    counted = [(i, Counter(bag(t)), vector(t)) for i, t in docs]
    mean = sum(sum(c.values()) for _, c, _ in counted) / len(counted)
    out = {}
    for q, text in queries:
        found = []
        for i, c, v in counted:
            a, s = vector(text), 0.0
            norm = size(a) * size(v)
            for w in bag(text):
                df = sum(w in o for _, o, _ in counted)
                if c[w]:
                    s += round(math.log((len(docs) - df + 0.5) / (df + 0.5) + 1) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)), 6)
            found.append((round((round(sum(a[x] * v[x] for x in a) / norm, 6) if norm else 0.0) + round(s * (1 - alpha), 8), 7), i))
        out[q] = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
    return out


@pytest.fixture(scope="module")
def rows():
    # many short texts lead the dense arm, many long ones the sparse one; 900 is in neither's first 50
    short = [(i, "apple") for i in range(60)]
    long = [(100 + i, "berry berry berry berry " + " ".join(f"x{j}" for j in range(30))) for i in range(60)]
    return [*short, *long, (900, "apple apple berry y1"), (901, ""), (902, None), *[(1000 + i, f"other{i} words{i % 7}") for i in range(300)]], [(1, "apple berry"), (2, "berry x1 x2"), (3, "words3"), (4, "?!"), (5, None)]


def found(spark, docs, queries, k):
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "query_id long, text string")
    out = {}
    for r in blended.top_k(d, q, 0.7, k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((round(r.score, 7), r.id))
    return out


def test_all_documents_are_blended(spark, rows):
    want = plain(*rows, 10)
    assert want[1][0][1] == 900
    assert found(spark, *rows, 10) == want


def test_joined_is_the_same(spark, rows, monkeypatch):
    monkeypatch.setattr(bm25, "BROADCAST_TERMS", 2)
    assert found(spark, *rows, 10) == plain(*rows, 10)
    monkeypatch.setattr(dense, "BROADCAST_NUMBERS", 64)
    assert found(spark, *rows, 10) == plain(*rows, 10)


def test_query_is_its_sql(spark):
    import duckdb

    import __spark_entry__ as e

    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet'")
    want = sorted(con.execute(e.oracle_sql()["blended_topk"]).fetchall())
    got = e.queries()["blended_topk"](spark, at).select("query_id", "id", "score", "rank")
    assert sorted(map(tuple, got.collect())) == want and len(want) > 0
