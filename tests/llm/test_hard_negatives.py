"""Hard negatives against brute force: nulls, copies, ties, repeated ids, large numbers, other lengths; the tree's own laws."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, v array<bigint>, pivot string, part string, n int"


def plain(rows, anchor, k=5, low=80, high=100):
    best = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and None not in v and sum(x * x for x in v) < 2**62:
            best[i] = min(best.get(i, (label, v)), (label, v))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))  # noqa: E731  what is missing at the end counts as 0
    out = []
    for a, (label, v) in best.items():
        if not anchor(a):
            continue
        near = sorted((-dot(v, w), i) for i, (other, w) in best.items() if i != a and other == label)[:k]
        far = sorted((-dot(v, w), i) for i, (other, w) in best.items() if other != label)
        for p, i in near:
            hits = [(s, j) for s, j in far if low * -p <= 100 * -s <= high * -p][:k]
            out += [(a, i, r + 1, j, -p, -s) for r, (s, j) in enumerate(hits)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, "p", "q", 1) for r in rows], SCHEMA).repartition(4)


def found(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    base = [[rnd.randint(-3, 9) for _ in range(6)] for _ in range(30)]
    out = [(i, rnd.randint(0, 2), [x + rnd.randint(-1, 1) for x in rnd.choice(base)]) for i in range(-40, 400)]
    out += [(1000 + i, i % 2, [5, 5, 5, 5, 5, 5]) for i in range(150)]  # copies
    out += [(2000 + i, 2, [0] * 6) for i in range(5)] + [(2100, 7, [1, 2, 3, 4, 5, 6]), (2200, 2, [4, 4]), (2201, 1, []), (2300, 1, [9] * 6)]
    out += [(3000, 1, None), (3001, None, [1] * 6), (None, 1, [9] * 6), (3002, 1, [1, None, 1, 1, 1, 1]), (3100, 0, [2**31] * 6)]
    return out + out[:30] + [(10, 2, [1] * 6), (20, 0, [9, 9, 9, 9, 9, 9])]  # repeated rows, two rows of one id


@pytest.mark.parametrize("block, anchors", [(H.BLOCK_NUMBERS, H.ANCHOR_NUMBERS), (600, 420)])
def test_hard_negatives(spark, rows, monkeypatch, block, anchors):
    monkeypatch.setattr(H, "BLOCK_NUMBERS", block)
    monkeypatch.setattr(H, "ANCHOR_NUMBERS", anchors)
    want = plain(rows, lambda i: i % 3 == 0)
    assert len({r[0] for r in want}) > 64
    assert found(H.mine(table(spark, rows), F.col("vec_id") % 3 == 0)) == want


def test_other_windows(spark, rows):
    want = plain(rows, lambda i: i % 10 == 0, k=2, low=-50, high=130)
    assert found(H.mine(table(spark, rows), F.col("vec_id") % 10 == 0, positives=2, negatives=2, low=-50, high=130)) == want


def test_scores_beyond_doubles(spark):
    rnd = random.Random(4)
    rows = [(i, i % 2, [rnd.randint(-(2**29), 2**29) for _ in range(3)]) for i in range(60)]
    assert found(H.mine(table(spark, rows), F.lit(True))) == plain(rows, lambda i: True)


def test_tree_laws():
    rnd = np.random.default_rng(1)
    x = np.vstack([rnd.integers(-50, 50, (700, 5)), np.full((300, 5), 7)])
    x = H.augmented(x, int((x * x).sum(axis=1).max()))
    order, n = H.grown(x)
    assert sorted(order) == list(range(len(x))) and np.ptp((x * x).sum(axis=1)) < 1e-6
    y = x[order]

    def rows_of(k):
        if not n["children"][k]:
            return list(range(n["row"][k], n["row"][k] + n["rows"][k]))
        return [r for c in range(n["child"][k], n["child"][k] + n["children"][k]) for r in rows_of(c)]

    assert sorted(rows_of(0)) == list(range(len(x)))
    for k in range(len(n["centre"])):
        own = rows_of(k)
        c = y[n["centre"][k]]
        assert n["centre"][k] in own and np.sqrt(((y[own] - c) ** 2).sum(axis=1)).max() <= n["radius"][k] + 1e-9
        if not n["children"][k]:
            assert len(own) <= H.LEAF or n["radius"][k] == 0
            continue
        kids = range(n["child"][k], n["child"][k] + n["children"][k])
        centres = y[n["centre"][list(kids)]]
        apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))[np.triu_indices(len(centres), 1)]
        assert (centres[0] == c).all() and apart.min() >= n["radius"][list(kids)].max() - 1e-9 and len(centres) <= H.FAN


def test_pruning_leaves_nodes_out():
    """Clusters far apart: an anchor verifies a part of the rows only."""
    rnd = np.random.default_rng(3)
    v = (rnd.normal(size=(20, 16)) * 200).astype(int).repeat(100, axis=0) + rnd.integers(-2, 3, (2000, 16))
    most = int((v * v).sum(axis=1).max())
    order, nodes = H.grown(H.augmented(v, most))
    row = {"n": len(v), "dims": 8, "ids": order.astype(np.int64).tobytes(), "labels": np.zeros(len(v), np.int64).tobytes(), "vectors": v[order].tobytes()} | {k: nodes[k].tobytes() for k in H.NODE}
    tree, seen = H.Tree(row, 16, most), []
    a = v[:5].copy()
    best = H.Best(3, np.full(5, H.NONE))

    def verify(q, rows):
        seen.append(len(q) * (rows.stop - rows.start))
        best.add(q, a[q] @ tree.v[rows].T, tree.ids[rows])

    upper, lower = tree.bounds(a, (a * a).sum(axis=1), 1e12)
    tree.search(upper, lower, np.full(5, np.inf), best, verify)
    want = [sorted((-int(s), i) for i, s in enumerate(v @ x))[:3] for x in a]
    assert [[(-int(s), int(i)) for s, i in zip(*r, strict=True)] for r in zip(best.scores, best.ids, strict=True)] == want
    assert sum(seen) < 0.3 * len(v) * len(a)


def test_empty_and_null_embeddings(spark):
    assert found(H.mine(table(spark, []), F.lit(True))) == []
    e = spark.createDataFrame([(1, [0.5, -0.001], 1), (2, [None, 1.0], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 1), (5, None, 1), (6, [1e300, 0.0], 1), (7, [], 1)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.label, list(r.v)) for r in H.usable(H.whole(e)).collect()}
    assert got == {1: (1, [128, -1]), 7: (1, [])}
