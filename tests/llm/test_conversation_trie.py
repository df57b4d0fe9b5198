"""The conversation trie against brute force: nulls, ties, repeated rows, copies, long conversations, blocks of a few turns."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import conversation_trie as C

SCHEMA = "conv_id long, turn long, role string, text string, depth string, s1 string, place int"


def turns_of(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    return {c: [(r, x) for *_, r, x in sorted(t)] for c, t in convs.items()}


def plain(convs):
    """Nodes of {conv_id: turns}."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    for path, cs in members.items():
        under = [p for p in members if p[: len(path)] == path]
        kids = [p for p in under if len(p) == len(path) + 1]
        leaves = [p for p in under if not any(q != p and q[: len(p)] == p for q in under)]
        own = lambda p: (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        ended = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(path))
        out[min(cs), len(path)] = (min(members[path[:-1]]) if path else None, len(cs), len(kids), len(leaves), sum(map(own, under)), hashlib.sha256(ended.encode()).hexdigest())
    return out


def lend(convs):
    out = {}
    for c, turns in convs.items():
        h, first = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20 * (1 if c >= 0 else -1))
        out[c] = convs.get(first, [])[:h] + turns[h:]
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    say = ["hello there", "", None, "a b\tc", "é  ü", "x " * 3000]
    out = [(c, t, rnd.choice(["user", None, "assistant"]), rnd.choice(say)) for c in range(-25, 70) for t in range(rnd.choice([1, 1, 2, 3, 5])) if c not in (20, -20)]
    out += [(c, t, "user", "same") for c in range(100, 140) for t in range(3)]  # copies
    out += [(200, t % 7 if t % 5 else None, "user", f"turn {t % 11}") for t in range(60)]  # ties and null turns
    out += [(201, t % 7 if t % 5 else None, "user", f"turn {t % 11}") for t in range(60)] * 2  # repeated rows
    out += [(300, t, "user", f"long {t}") for t in range(40)] + [(301, t, "user", f"long {t}") for t in range(31)] + [(None, 1, "user", "nobody")]
    return out


@pytest.fixture(scope="module")
def conversations(spark, rows):
    return spark.createDataFrame([(*r, "d", "s", 1) for r in rows], SCHEMA).repartition(5)


def check(df, want):
    got = df.collect()
    assert len(got) == len(want)
    assert {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got} == want


@pytest.mark.parametrize("block", [C.BLOCK, 4])
def test_trie(conversations, rows, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    check(C.prefix_trie(conversations), plain(turns_of(rows)))
    check(C.trie(C.branched(conversations)), plain(lend(turns_of(rows))))


def test_numbering_over_ranges(spark):
    one = spark.range(3000).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit("t").alias("text"))
    two = one.withColumn("conv_id", F.lit(8)).limit(10)
    got = C.numbered(C.digests(one.unionByName(two))).filter("conv_id = 7").select("turn", "place").collect()
    assert len(got) == 3000 and all(r.turn == r.place for r in got)


def test_empty(spark):
    assert C.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.trie(C.branched(spark.createDataFrame([], SCHEMA))).count() == 0
