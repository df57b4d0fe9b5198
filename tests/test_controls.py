"""Context control against a plain walk through each query's hits; answers that take each way through the safety checks."""

import hashlib
import random
import re
from collections import Counter
from math import sqrt

from pyspark.sql import functions as F

from corpusloom.operators import retrieval as R
from corpusloom.operators import safety


def bag(t):
    return Counter(re.findall(r"[a-z0-9]+", (t or "").lower()))


def cosine(a, b):
    dot = sum(n * b[t] for t, n in a.items())
    return round(dot / sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())), 6) if dot else 0.0


def test_context_control(spark):
    rnd = random.Random(9)
    base = [" ".join(rnd.choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(30)) for _ in range(8)]
    near = lambda t: " ".join(w if rnd.random() > 0.04 else "other" for w in t.split())
    hits = []
    for q in range(6):
        for rank in range(1, 26):
            t = rnd.choice(base)
            t = rnd.choice([t, near(t), t.upper(), f"  {t} ", near(t), "", None, f"unlike {q} {rank}"])
            hits.append((q, 100 * q + rank, rank, float(30 - rank), t))
    queries = [(q, base[q] if q < 4 else "nothing alike") for q in range(6)] + [(9, None)]
    h = spark.createDataFrame(hits, "query_id long, id long, rank int, score double, text string").repartition(3)
    qs = spark.createDataFrame(queries, "query_id long, query string")
    want = set()
    for q, asked in queries:
        kept, seen = [], set()
        for _, i, _, score, t in sorted(x for x in hits if x[0] == q):
            key = hashlib.sha256(re.sub(r"\s+", " ", (t or "").strip().lower()).encode()).hexdigest()
            if score < 8 or key in seen:
                continue
            seen.add(key)
            if any(cosine(bag(t), bag(k)) >= 0.95 for _, k in kept):
                continue
            kept.append((i, t))
        want |= {(q, i) for i, t in kept if cosine(bag(t), bag(asked)) >= 0.1}
    found = R.gate(R.lexical_scores(qs, R.dedup_context(R.gate(h, F.col("score"), 8.0))), F.col("lexical"), 0.1)
    assert {(r.query_id, r.id) for r in found.collect()} == want and 0 < len(want) < len(hits) // 3


def test_each_way_through_answer_safety(spark):
    known = "The Retention Policy keeps customer records for seven years in the archive of the company."
    toxic = next(iter(safety.TOXIC.values()))[0]
    rows = [
        ("passed", "The retention policy keeps customer records for seven years. [source 1]", known),
        ("masked", "The retention policy keeps customer records for seven years. Write me@you.org", known + " Write me@you.org"),
        ("cited", "The retention policy keeps customer records for seven years. [source 7]", known),
        ("unfounded", "bicycles are usually painted green before they leave a factory hall.", known),
        ("names", "Napoleon Bonaparte met Julius Caesar in Constantinople during 1999.", known),
        ("toxic", f"The retention policy keeps customer records {toxic} for seven years.", known + f" {toxic}"),
        ("empty", "", known), ("null", None, None),
    ]
    d = spark.createDataFrame([(*r, 3) for r in rows], "answer_id string, answer string, context string, n_sources int")
    got = {r.answer_id: r for r in safety.answer_safety(d).collect()}
    assert {k: r.action for k, r in got.items()} == {"passed": "passed", "masked": "passed", "cited": "passed", "unfounded": "disclaimer", "names": "blocked_hallucination", "toxic": "blocked_toxic", "empty": "passed", "null": "disclaimer"}
    assert got["names"].text is None and got["toxic"].text is None
    assert "[EMAIL_REDACTED]" in got["masked"].text and got["masked"].pii_types == ["EMAIL"]
    assert got["cited"].invalid == [7] and "source 7" not in got["cited"].text and "[source 1]" in got["passed"].text
