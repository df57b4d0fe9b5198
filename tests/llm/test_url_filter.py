"""URL rules against brute force: nulls, odd urls, colliding digests, lists beyond the limit, clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import url_filter as U


def plain(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([len(rest), *(rest.index(c) for c in "/?#" if c in rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([len(path), *(path.index(c) for c in "?#" if c in path)])]
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


URLS = [None, "", "no scheme", "https://", "https:///p", "http://COM", "http://com/", "http://x.com?q=a.net/es/", "HTTPS://Www.Example.COM/en/1#t", "http://example.com/en", "http://EXAMPLE.com/en/x?y=://net/es/", "ftp://a.b.net/fr/1", "http://notexample.com/en/", "http://net./es/", "http://é.Ünet/es/", "http://a..net/es/é", "http://.net/fr/", "x://" + "a." * 3000 + "net/es/" + "p" * 50000, "http://example.com:80/en/"]


@pytest.fixture(scope="module")
def pages(spark):
    rnd = random.Random(5)
    some = [f"http://{'.'.join(rnd.choice(['a', 'bb', 'net', 'example', 'com']) for _ in range(rnd.randint(1, 4)))}{rnd.choice(['', '/', '/en/', '/en/a', '/es/', '/e', '/fr/x'])}{rnd.choice(['', '?q', '#f'])}" for _ in range(300)]
    urls = URLS + some + some[:20]
    return spark.createDataFrame([(i if i % 50 else None, u, "r", "v", "e", 7) for i, u in enumerate(urls)], "page_id long, url string, rule string, verdict string, _e string, k int").repartition(3)


@pytest.fixture(scope="module")
def rules(spark):
    rnd = random.Random(6)
    more = {(".".join(rnd.choice(["a", "bb", "net", "example", "com"]) for _ in range(rnd.randint(1, 3))), rnd.choice(["", "/", "/e", "/en/", "/fr/"])): rnd.choice(["allow", "block", "grey"]) for _ in range(40)}
    return [(h, p, v) for (h, p), v in ({(h, p): v for h, p, v in U.RULES} | more).items()]


def test_url_rules(spark, pages, rules):
    odd = [(None, "/", "block"), ("", "/", "block"), ("net", "es", "block"), ("a/b", "", "block"), ("bb", "/zz", None), ("COM", "/q/", "allow"), ("com", "/q/", "block")]
    known = [*rules, ("com", "/q/", "block")]
    table = spark.createDataFrame(rules + odd, "host string, path string, verdict string")
    rows = pages.collect()
    want = sorted(((r.page_id, r.url, *plain(r.url, known)) for r in rows), key=repr)
    for how in ({}, {"bits": 3}, {"list_bytes": 0}):
        got = U.judge(pages, table, **how).select("page_id", "url", "host", "path", "rule", "verdict").collect()
        assert sorted(map(tuple, got), key=repr) == want, how
    kept = U.judge(pages, table)
    assert set(kept.columns) == {*pages.columns, "host", "path"} and kept.agg(F.sum("k")).first()[0] == 7 * len(rows)


def test_no_rules_no_pages(spark, pages):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    for limit in (1000, -1):
        assert {tuple(r) for r in U.judge(pages, none, default="unknown", list_bytes=limit).select("rule", "verdict").collect()} == {(None, "unknown")}
    assert U.judge(pages.limit(0), spark.createDataFrame(U.RULES, "host string, path string, verdict string")).count() == 0


def test_column_named_like_a_result(spark):
    d = spark.createDataFrame([("https://b.net/fr/1", 1)], "host string, path int")
    got = U.judge(d, spark.createDataFrame(U.RULES, "host string, path string, verdict string"), url="host").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [("b.net", "/fr/1", "net/fr/", "block")]


def test_digests_are_sparks(spark):
    import xxhash

    texts = ["", "a", "net/es/", "é" * 50]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()]
    assert np.array(got, np.int64).view(np.uint64).tolist() == [xxhash.xxh64_intdigest(t.encode(), U.SEED) for t in texts]
