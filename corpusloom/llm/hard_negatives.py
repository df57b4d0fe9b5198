"""Hard negatives by inner product, from cover trees over norm-augmented candidates.

A candidate x gets one more coordinate, sqrt(M - |x|^2), M the largest squared norm of all; an anchor gets 0 there. Then the squared distance of anchor a
and candidate x is |a|^2 + M - 2 a.x, so a ball of candidates bounds their inner products with an anchor from both sides.

1. Index. The top level of the tree are at most `PIVOTS` centres, taken farthest first from a bounded sample (`SAMPLE_NUMBERS` numbers); every candidate goes to the nearest.
   A centre's candidates are dealt to blocks of about `BLOCK_NUMBERS` numbers by a hash of their id, so no centre makes a large task; each block goes on as a cover
   tree of its own: a node's children are centres taken farthest first among its rows until `FAN` of them cover it, the node's own centre the first of them
   (nested, apart by more than the level's covering radius), and every node holds the radius that covers its rows. Leaves have up to `LEAF` rows, or copies.
   The index is a written table, a row for each block.
2. Search. Anchors are taken in blocks (`ANCHOR_NUMBERS` numbers at a time, on the driver and in each task); one pass over the index finds the positives, a second
   one the negatives. A task goes through its trees best first, by the highest bound of any anchor still interested; an anchor leaves a node that can't reach
   its k-th score, or lies outside all its windows, and leaves are verified exactly, in whole numbers. The best k of each task are shuffled.

The window of an anchor's positive with score p are scores s of other labels with low*p <= 100*s <= high*p. Higher scores come first, ties by smaller id.

Rows without id, label or vector, or with a null component, take no part, nor do those whose squared norm reaches 2**62: scores wouldn't fit 64 bits. A missing
component at the end counts as 0. Repeated rows of an id count once, with the smallest label, then the smallest vector. Copies with ids of their own are
rows of their own. Empty table: no rows. Other columns aren't read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, materialise, table

PIVOTS, FAN, LEAF = 1024, 16, 64
SAMPLE_NUMBERS, BLOCK_NUMBERS, ANCHOR_NUMBERS = 1_000_000, 131_072, 2_000_000
#: Anchors that descend a tree together.
GROUP = 1024
NONE = np.iinfo(np.int64).min
_EXACT = 2.0**53


def matrix(column, dims: int) -> np.ndarray:
    """Rows of an Arrow column of lists as whole numbers, filled up with zeros."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def products(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """Exact inner products of rows; `limit` is no less than any of them or of their parts."""
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if limit < _EXACT else a @ b.T


def augmented(v: np.ndarray, most: int) -> np.ndarray:
    x = v.astype(float)
    return np.hstack([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))[:, None]])


def farthest_first(x: np.ndarray, first: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres (their rows), the nearest centre of each row, the distance to it; ends when every row is a centre or the copy of one."""
    centres, near = [first], np.zeros(len(x), np.int64)
    far = np.sqrt(((x - x[first]) ** 2).sum(axis=1))
    while len(centres) < most:
        c = int(far.argmax())
        if far[c] == 0:
            break
        d = np.sqrt(((x - x[c]) ** 2).sum(axis=1))
        closer = d < far
        near[closer], far[closer] = len(centres), d[closer]
        centres.append(c)
    return np.array(centres), near, far


def grown(x: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of rows in the tree, and its nodes: centre and rows (places in that order), covering radius, children (one after the other)."""
    nodes: list[list] = []  # centre, radius, first child, children, first row, rows
    order: list[np.ndarray] = []
    start = np.arange(len(x))
    todo = [(0, start, 0)]
    nodes.append([0, 0.0, 0, 0, 0, 0])
    placed = 0
    while todo:
        at, rows, c = todo.pop()
        d = np.sqrt(((x[rows] - x[rows[c]]) ** 2).sum(axis=1))
        nodes[at][0], nodes[at][1] = rows[c], d.max()
        if len(rows) <= LEAF or d.max() == 0:
            nodes[at][4:] = [placed, len(rows)]
            order.append(rows)
            placed += len(rows)
            continue
        centres, near, _ = farthest_first(x[rows], c, FAN)
        nodes[at][2:4] = [len(nodes), len(centres)]
        for k, centre in enumerate(centres):
            own = np.flatnonzero(near == k)
            todo.append((len(nodes), rows[own], int(np.searchsorted(own, centre))))
            nodes.append([0, 0.0, 0, 0, 0, 0])
    places = np.concatenate(order)
    back = np.empty(len(x), np.int64)
    back[places] = np.arange(len(x))
    out = {k: np.array([n[i] for n in nodes], float if k == "radius" else np.int64) for i, k in enumerate(("centre", "radius", "child", "children", "row", "rows"))}
    out["centre"] = back[out["centre"]]
    return places, out


NODE = ("centre", "radius", "child", "children", "row", "rows")
INDEX = "n int, dims int, ids binary, labels binary, vectors binary, " + ", ".join(f"{k} binary" for k in NODE)


class Index:
    """The written blocks, and what holds for all candidates: how long vectors are, their largest squared norm."""

    def __init__(self, blocks: DataFrame, dims: int, most: int):
        self.blocks, self.dims, self.most = blocks, dims, most


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, v (whole numbers), one row for each vec_id, of those that take part."""
    d = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<bigint>").alias("v"))
    d = d.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    d = d.filter(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) < 2.0**62)
    return d.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.*")


def build_index(rows: DataFrame) -> Index:
    """rows: as `usable` gives them, written."""
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    facts = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dims"), F.coalesce(F.max(norm), F.lit(0)).alias("most")).first()
    n, dims, most = facts["n"], max(1, facts["dims"]), facts["most"]
    block = max(LEAF, BLOCK_NUMBERS // dims)
    sample = rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(PIVOTS, SAMPLE_NUMBERS // dims)).toArrow()
    pivots = np.zeros((1, dims + 1))
    if len(sample):
        x = augmented(matrix(sample.column("v"), dims), most)
        pivots = x[farthest_first(x, 0, min(PIVOTS, -(-n // block)))[0]]
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                x, p = augmented(matrix(part.column("v"), dims), most), shared.value
                near = ((p * p).sum(axis=1) - 2 * x @ p.T).argmin(axis=1) if len(p) > 1 else np.zeros(len(x), np.int64)
                yield pa.record_batch([*part.columns, pa.array(near)], names=["vec_id", "label", "v", "pivot"])

    dealt = materialise(rows.mapInArrow(lean(deal), "vec_id long, label long, v array<bigint>, pivot long"), "negatives-dealt")
    counts = dealt.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(block)).alias("parts"))  # a row for each pivot
    dealt = dealt.join(F.broadcast(counts), "pivot").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts")).select("pivot", "part", "vec_id", "label", "v")

    def build(t):
        import pyarrow as pa

        v = matrix(t.column("v"), dims)
        order, nodes = grown(augmented(v, most))
        small = np.int32 if not v.size or np.abs(v).max() < 2**31 else np.int64
        cells = [len(v), v.itemsize if small is np.int64 else 4]
        arrays = [t.column("vec_id").to_numpy()[order], t.column("label").to_numpy()[order], v[order].astype(small), *(nodes[k] for k in NODE)]
        return pa.table([pa.array([c], pa.int32()) for c in cells] + [pa.array([a.tobytes()], pa.binary()) for a in arrays], names=[c.split()[0] for c in INDEX.split(", ")])

    blocks = materialise(dealt.groupBy("pivot", "part").applyInArrow(build, INDEX), "negatives-index")
    return Index(blocks, dims, most)


class Tree:
    """A block of the index, read back."""

    def __init__(self, row: dict, dims: int, most: int):
        of = lambda k, t: np.frombuffer(row[k], t)
        self.ids, self.labels = of("ids", np.int64), of("labels", np.int64)
        self.v = of("vectors", np.int32 if row["dims"] == 4 else np.int64).reshape(row["n"], dims).astype(np.int64)
        self.most = most
        for k in NODE:
            setattr(self, k, of(k, float if k == "radius" else np.int64))

    def bounds(self, a: np.ndarray, squares: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """Highest and lowest inner product that each anchor can have below each node, with room for rounding."""
        at = squares.astype(float)[:, None] + self.most
        d = np.sqrt(np.maximum(0.0, at - 2.0 * products(a, self.v[self.centre], limit)))
        slack = 1e-6 * np.sqrt(at)
        near, far = np.maximum(0.0, d - self.radius - slack), d + self.radius + slack
        return (at - near * near) / 2 + 1 + 1e-9 * at, (at - far * far) / 2 - 1 - 1e-9 * at

    def search(self, upper: np.ndarray, lower: np.ndarray, ceiling: np.ndarray, best: Best, verify) -> None:
        """Best-first descent of all queries together; `verify` scores the queries that get to a leaf."""
        ask = lambda q, node: q[(upper[q, node] >= best.floor(q)) & (lower[q, node] <= ceiling[q])]
        every = np.arange(len(upper))
        heap = [(-np.inf, 0, every)]
        while heap:
            _, node, q = heapq.heappop(heap)
            q = ask(q, node)
            if not len(q):
                continue
            if not self.children[node]:
                verify(q, slice(self.row[node], self.row[node] + self.rows[node]))
                continue
            for child in range(self.child[node], self.child[node] + self.children[node]):
                some = ask(q, child)
                if len(some):
                    heapq.heappush(heap, (-float(upper[some, child].max()), child, some))


class Best:
    """The k highest scores of each query, ties by smaller id; none is below `least`."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least = k, least
        self.scores = np.full((len(least), k), NONE)
        self.ids = np.full((len(least), k), np.iinfo(np.int64).max)

    def floor(self, q: np.ndarray) -> np.ndarray:
        return np.maximum(self.scores[q, -1], self.least[q])

    def add(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """A row of scores for each query, NONE for no hit."""
        top = scores.max(axis=1)
        some = (top > NONE) & (top >= self.scores[q, -1])
        q, scores = q[some], scores[some]
        if not len(q):
            return
        keep = self.k
        if scores.shape[1] > 8 * keep:  # only what reaches the k-th score has to be sorted
            edge = np.partition(scores, -keep, axis=1)[:, -keep]
            wide = scores >= edge[:, None]
            width = int(wide.sum(axis=1).max())
            if width < scores.shape[1]:
                near = np.argpartition(~wide, width - 1, axis=1)[:, :width]
                scores, ids = np.take_along_axis(scores, near, 1), ids[near]
        s = np.hstack([self.scores[q], scores])
        i = np.hstack([self.ids[q], np.broadcast_to(ids, scores.shape)])
        order = np.lexsort((i, np.where(s == NONE, np.iinfo(np.int64).max, -s)), axis=1)[:, :keep]
        self.scores[q], self.ids[q] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, at = np.nonzero(self.scores > NONE)
        return q, self.ids[q, at], self.scores[q, at]


def searched(index: Index, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, k: int, windows: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> DataFrame:
    """query, other_id, score: the best k of each task's trees.

    Without windows a query is an anchor (its number) and takes others of its label; with (anchor, lowest, highest) it is a window and takes other labels.
    """
    spark = index.blocks.sparkSession
    dims, most = index.dims, index.most
    shared = spark.sparkContext.broadcast((ids, labels, v, windows))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids, labels, v, windows = shared.value
        anchor, low, high = windows or (np.arange(len(ids)), np.full(len(ids), NONE), np.full(len(ids), np.iinfo(np.int64).max))
        best = Best(k, low)
        squares = (v * v).sum(axis=1)
        limit = float(np.sqrt(float(squares.max(initial=0)) * max(1, most)))
        for b in batches:
            for row in range(b.num_rows):
                tree = Tree({c: b.column(c)[row].as_py() for c in b.schema.names}, dims, most)
                for lo in range(0, len(anchor), GROUP):
                    q = slice(lo, lo + GROUP)
                    mine, place = np.unique(anchor[q], return_inverse=True)
                    upper, lower = tree.bounds(v[mine], squares[mine], limit)
                    part = Part(best, lo)

                    def verify(some, rows, tree=tree, lo=lo, part=part):
                        a, back = np.unique(anchor[lo + some], return_inverse=True)
                        s = products(v[a], tree.v[rows], limit)
                        same = tree.labels[rows] == labels[a][:, None]
                        fit = ~same if windows else same & (tree.ids[rows] != ids[a][:, None])
                        s = np.where(fit, s, NONE)[back]
                        if windows:
                            s = np.where((s >= low[lo + some][:, None]) & (s <= high[lo + some][:, None]), s, NONE)
                        part.add(some, s, tree.ids[rows])

                    tree.search(upper[place], lower[place], high[q].astype(float), part, verify)
        q, other, s = best.rows()
        for lo in range(0, len(q), 100_000):
            yield pa.record_batch([pa.array(q[lo : lo + 100_000].astype(np.int64)), pa.array(other[lo : lo + 100_000]), pa.array(s[lo : lo + 100_000])], names=["query", "other_id", "score"])

    return index.blocks.mapInArrow(lean(run), "query long, other_id long, score long")


class Part:
    """A group of queries, numbered from 0, of a Best."""

    def __init__(self, best: Best, start: int):
        self.best, self.start = best, start

    def floor(self, q: np.ndarray) -> np.ndarray:
        return self.best.floor(q + self.start)

    def add(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        self.best.add(q + self.start, scores, ids)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), "other_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """rows (vec_id, label, v: whole numbers), of which `anchors` holds for some, to anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    rows = materialise(usable(rows), "negatives-rows")
    index = build_index(rows)
    some = rows.filter(anchors)
    most = max(64, ANCHOR_NUMBERS // index.dims)
    groups = max(1, -(-some.count() // most))
    some = materialise(some.withColumn("_group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")), "negatives-anchors")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = spark.createDataFrame([], schema)
    for g in range(groups):
        t = some.filter(F.col("_group") == g).orderBy("vec_id").toArrow()
        if not len(t):
            continue
        ids, labels, v = t.column("vec_id").to_numpy(), t.column("label").to_numpy(), matrix(t.column("v"), index.dims)
        near = ranked(searched(index, ids, labels, v, positives, None), positives).orderBy("query", "rank").toArrow()  # at most `positives` for each anchor of the block
        a, other, score = (near.column(c).to_numpy() for c in ("query", "other_id", "score"))
        fit = lambda x: max(NONE + 1, min(np.iinfo(np.int64).max, x))
        lowest, highest = (np.array([fit(f(p)) for p in score.tolist()], np.int64) for f in (lambda p: -(-low * p // 100), lambda p: high * p // 100))
        open_ = lowest <= highest
        a, other, score, lowest, highest = (x[open_] for x in (a, other, score, lowest, highest))
        if not len(a):
            continue
        hits = ranked(searched(index, ids, labels, v, negatives, (a, lowest, highest)), negatives)
        pairs = spark.createDataFrame(arrow(query=np.arange(len(a)), anchor_id=ids[a], positive_id=other, positive_score=score))  # bounded as the anchors are
        found = hits.join(F.broadcast(pairs), "query").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = out.unionByName(materialise(found, "negatives-found"))
    return out


def arrow(**columns: np.ndarray):
    import pyarrow as pa

    return pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()})


def whole(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, v = floor(scale * component) of the embeddings without a null or non-finite component."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    d = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    d = d.filter(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return d.select("vec_id", "label", F.transform("x", lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(2.0**62)), F.lit(-(2.0**62))))).alias("v"))  # beyond that a row takes no part anyhow


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("vec_id") % 100 == 0)


SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM e WHERE vec_id % 100 = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id AS other_id, a.label = e.label AS same, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score FROM a JOIN e ON a.vec_id <> e.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
