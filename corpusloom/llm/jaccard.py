"""N-gram Jaccard join with adaptive multi-match prefixes.

Sets of distinct 5-word shingles that share at least 75 % are linked; components of links are returned. The join is exact.

1. All shingles are counted exactly, dealt by hash range. A task's shingles go out as sorted packs, each with the numbers of the
   documents it occurs in; what comes back to a pack are the shingles that occur twice or more, with their counts. So a document's
   shingles are put together without its text being read again, single ones only as a number, and nothing of this is
   held whole in one place. Tokens are ordered by count (single ones first), then hash.
2. With threshold t and any order, two linked sets of sizes n and m share their first l common
   tokens within prefixes of n - ceil(t n) + l and m - ceil(t m) + l tokens. Each set lengthens its prefix (larger l) while
   the estimated cost of its candidates falls: more tokens are posted, but a candidate must share l of them before it is verified.
   A pair needs the smaller l of its two. Single tokens are never posted.
3. Buckets of few records make pairs. A larger bucket's records are compared with one leader (linear in the bucket), and
   links are contracted to components. What large buckets then still have in different components is compared
   in blocks of records, as one matrix product inside a task that gives only the links that join components, so a
   group of thousands of near copies makes no rows for its pairs. Every pair of a bucket ends up verified or in one component.

Of equal texts one takes part, and equal sets are one record. Words: [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased. Fewer than five words: the
whole sequence is the one shingle. No words, empty or null text: empty set, linked with nothing.
Null doc_id: takes part in links, doesn't name a component unless all its members' ids are null. Repeated rows are equal sets. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, docs_of, few_or_shuffled, give_back, lean, materialise, table
from .tokens import slices

WORDS = 5
#: Words whose hashes a task remembers at most, about 150 bytes each.
WORDS_KEPT = 100_000
PERCENT = 75
#: Shingles in a pack and in a range of hashes, about; documents in a pack at most.
PACK = 1_500_000
RANGE = 1_000_000
PACK_DOCS = 1 << 16
MAX_MATCH = 8
#: Buckets up to this size make pairs; records in a block, about.
SMALL_BUCKET = 4
BLOCK = 128

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Hash of each word met; started anew when it grows large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, words: Words, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    own = text.encode().lower().split() if text else []
    if not own:
        return np.zeros(0, np.uint64)
    if len(words) > WORDS_KEPT:
        words.clear()
    h = np.fromiter(map(words.__getitem__, own), np.uint64, len(own))
    if len(h) < k:
        return mix(np.array([np.uint64(int.from_bytes(hashlib.blake2b(b" ".join(own), digest_size=8).digest(), "little"))]))
    n = len(h) - k + 1
    s = np.zeros(n, np.uint64)
    for i in range(k):
        s = mix(s * _A + h[i : i + n])
    return np.unique(s)


def planes(x: np.ndarray) -> list[bytes]:
    """Numbers as a compressed string for each place of their bytes: places that hold few values shrink."""
    import pyarrow as pa

    return [pa.compress(p, codec="zstd", asbytes=True) for p in np.ascontiguousarray(x.view("u1").reshape(len(x), x.itemsize).T)]


def numbers(held: list[bytes], kind: str, n: int) -> np.ndarray:
    import pyarrow as pa

    out = np.empty((n, len(held)), "u1")
    for i, p in enumerate(held):
        out[:, i] = np.frombuffer(pa.decompress(p, n, codec="zstd"), "u1")
    return out.reshape(-1).view(kind)


#: Part of a pack in one range of hashes: gaps between its m ascending shingles, in how many (n) and in which (doc) of the pack's documents
#: each occurs, in how many of all (df). A pack's own row has its documents: digests of text and of set, size of set.
_PART = "pack long, m int, gap array<binary>, n array<binary>, doc array<binary>, df array<binary>, texts binary, fps binary, sizes binary"
_KEYS = 16  # bytes of a digest


def _part(pack: int, u: np.ndarray, n: np.ndarray, doc: np.ndarray, df: np.ndarray | None = None) -> dict:
    return {"pack": pack, "m": len(u), "gap": planes(np.diff(u, prepend=np.uint64(0))), "n": planes(n.astype("<u2")), "doc": planes(doc), "df": planes(df.astype("<u4")) if df is not None else None}


def _parts(rows: list[dict], **more):
    import pyarrow as pa

    lists = pa.list_(pa.binary())
    kinds = {"pack": pa.int64(), "m": pa.int32(), "gap": lists, "n": lists, "doc": lists, "df": lists, "texts": pa.binary(), "fps": pa.binary(), "sizes": pa.binary()} | more
    return pa.Table.from_pylist(rows, pa.schema(kinds.items()))


def _read(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = numbers(r["n"], "<u2", r["m"]).astype(np.int64) + 1
    return np.cumsum(numbers(r["gap"], "<u8", r["m"]), dtype=np.uint64), n, numbers(r["doc"], "<u2", int(n.sum()))


def packs(texts: DataFrame, bits: int) -> DataFrame:
    """Packs (see `_PART`) by range of hashes: `bits` leading ones. texts: key (digest of the text), text."""

    def run(batches):
        from pyspark import TaskContext

        words, seen, pack = Words(), set(), TaskContext.get().partitionId() << 20
        keys, fps, sizes, held, of = [], [], [], [], []

        def flush():
            yield {"range": pack & ((1 << bits) - 1), "pack": pack, "m": 0, "texts": b"".join(keys), "fps": b"".join(fps), "sizes": np.array(sizes, "<i8").tobytes()}
            u, doc = np.concatenate([np.zeros(0, np.uint64), *held]), np.repeat(np.array(of, "<u2"), [len(x) for x in held])
            order = np.argsort(u, kind="stable")
            u, doc = u[order], doc[order]
            first = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1]))) if len(u) else np.zeros(0, np.int64)
            ends, u = np.append(first, len(doc)), u[first]
            cuts = np.searchsorted(u >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            for b, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if j > i:
                    yield {"range": b} | _part(pack, u[i:j], np.diff(ends[i : j + 1]) - 1, doc[ends[i] : ends[j]])

        def sent():
            import pyarrow as pa

            rows = list(flush())
            for x in (keys, fps, sizes, held, of):
                x.clear()
            return _parts(rows, range=pa.int32()).combine_chunks().to_batches()

        size = 0
        for b in slices(batches):
            for key, t in zip(b.column("key").to_pylist(), b.column("text"), strict=True):
                u = shingles(t.as_py(), words)
                fp = hashlib.blake2b(u, digest_size=_KEYS).digest()
                if len(u) and fp not in seen:
                    seen.add(fp)
                    held.append(u)
                    of.append(len(keys))
                    size += len(u)
                keys.append(key), fps.append(fp), sizes.append(len(u))
                if size >= PACK or len(keys) == PACK_DOCS:
                    yield from sent()
                    size, pack = 0, pack + 1
                    give_back()
        if keys:
            yield from sent()

    return texts.mapInArrow(lean(run), f"{_PART}, range int")


def repeated(t):
    """Of the parts in one range of hashes: shingles that occur in two documents or more, with their counts. Packs' own rows as they are."""
    rows = t.to_pylist()
    own, rows = [r for r in rows if r["texts"] is not None], [r for r in rows if r["texts"] is None]
    read = [_read(r) for r in rows]
    out = [{k: r[k] for k in ("pack", "m", "texts", "fps", "sizes")} for r in own]
    if rows:
        _, at = np.unique(np.concatenate([u for u, _, _ in read]), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([n for _, n, _ in read])).astype(np.int64)
        lo = 0
        for r, (u, n, doc) in zip(rows, read, strict=True):
            df = total[at[lo : lo + len(u)]]
            lo += len(u)
            more = df > 1
            if more.any():
                out.append(_part(r["pack"], u[more], n[more] - 1, doc[np.repeat(more, n)], df[more]))
    return _parts(out)


def match_of(df: np.ndarray, n: int, need: int) -> tuple[int, int]:
    """(l, prefix length) of least estimated cost; df: estimated counts in the set's token order."""
    reach = n - need + np.arange(1, min(MAX_MATCH, need) + 1)
    posted = np.cumsum(df - 1)[reach - 1]
    l = np.arange(1, len(reach) + 1)
    cost = posted + posted / l * (n / 8)
    best = int(cost.argmin())
    return best + 1, int(reach[best])


def records(t):
    """Of a pack's parts: rows (key, n, fp, rid, match, prefix, tokens) of its documents. tokens: shingles that other documents have too.
    match, prefix and tokens are null where a set can't have a partner but copies of itself, and for further copies in the same pack's task."""
    import pyarrow as pa

    rows = t.to_pylist()
    own = next(r for r in rows if r["texts"] is not None)
    rows = [r for r in rows if r["texts"] is None]
    size, pack = np.frombuffer(own["sizes"], "<i8"), own["pack"]
    read = [_read(r) for r in rows]
    none = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, "<u2"))]
    u, n, doc = (np.concatenate(x) for x in zip(*(read or none), strict=True))
    df = np.concatenate([numbers(r["df"], "<u4", r["m"]) for r in rows] or [np.zeros(0, "<u4")]).astype(np.int64)
    u, df = np.repeat(u, n), np.repeat(df, n)
    order = np.lexsort((u, df, doc))
    u, df = u[order].astype(np.int64), df[order]
    ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(size)))))
    match, prefix, tokens = [], [], []
    for i, n in enumerate(size.tolist()):
        lo, hi = int(ends[i]), int(ends[i + 1])
        need, single = -(-PERCENT * n // 100), n - (hi - lo)
        if n and hi - lo >= need:
            l, reach = match_of(np.concatenate((np.ones(single, np.int64), df[lo:hi])), n, need)
            match.append(l), prefix.append(u[lo : lo + reach - single]), tokens.append(u[lo:hi])
        else:
            match.append(None), prefix.append(None), tokens.append(None)
    cut = lambda x: [x[i : i + _KEYS] for i in range(0, len(x), _KEYS)]
    fps = [fp if n else None for fp, n in zip(cut(own["fps"]), size.tolist(), strict=True)]
    lists = pa.list_(pa.int64())
    return pa.table({"key": pa.array(cut(own["texts"]), pa.binary()), "n": pa.array(size), "fp": pa.array(fps, pa.binary()), "rid": pa.array((pack << 16) + np.arange(len(size))), "match": pa.array(match, pa.int32()), "prefix": pa.array(prefix, lists), "tokens": pa.array(tokens, lists)})


def shingle_sets(texts: DataFrame, n_chars: int) -> DataFrame:
    """Rows of `records` for texts (key, text), written. n_chars: their length, about."""
    bits = min(16, max(6, int(n_chars / 7 / RANGE).bit_length()))
    found = packs(texts, bits).groupBy("range").applyInArrow(lambda t: repeated(t), _PART)
    found = found.groupBy("pack").applyInArrow(lambda t: records(t), "key binary, n long, fp binary, rid long, match int, prefix array<long>, tokens array<long>")
    return materialise(found, "jaccard-sets", "uncompressed")


def stars(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): rows (u, v) with v the smallest of u's component and u > v.

    Large-star and small-star steps in turn until nothing changes; each halves the distance to the smallest.
    """
    e = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    mark = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = mark(e)
        if after == before:
            break
        before = after
    return e


def matched(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that share as many prefix tokens as the smaller match of the two asks for.

    Tokens are compared by 31 of their bits here. Tokens of one prefix that fall together lower its count, so that
    many are allowed for: a pair may be let through in error, none is kept back.
    """
    short = F.transform("prefix", lambda x: x.bitwiseAND(0x7FFFFFFF).cast("int"))
    side = lambda x: sets.select(F.col("rid").alias(x), F.col("match").alias(f"match_{x}"), F.array_distinct(short).alias(f"prefix_{x}"), (F.size("prefix") - F.size(F.array_distinct(short))).alias(f"lost_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.filter(F.size(F.array_intersect("prefix_a", "prefix_b")) + F.col("lost_a") + F.col("lost_b") >= F.least("match_a", "match_b")).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b), written, whose whole sets are similar enough, as links (u, v). Only sets that are in a pair are shuffled."""
    named = few_or_shuffled(materialise(pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct(), "jaccard-named"))
    sets = sets.join(named, "rid", "left_semi")
    side = lambda x: sets.select(F.col("rid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "tokens")])
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return both.filter(shared * 100 >= PERCENT * (F.col("n_a") + F.col("n_b") - shared)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def block_links(open_large: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between components inside clusters of records that large buckets tie together.

    open_large: (rid, n, token, root) of large buckets whose records are in more than one component.
    Blocks hold records of one component, or of several small ones; two blocks of one component are not compared.
    """
    lead = open_large.groupBy("token").agg(F.min("rid").alias("v"))
    ties = stars(open_large.join(lead, "token").select(F.col("rid").alias("u"), "v"))
    records = open_large.select("rid", "n", "root").distinct().join(ties.withColumnRenamed("u", "rid"), "rid", "left").select("rid", "n", "root", F.coalesce("v", "rid").alias("cluster"))
    size = records.groupBy("cluster", "root").agg(F.count("*").alias("c")).withColumn("kind", F.when(F.col("c") >= BLOCK // 2, F.col("root")).otherwise(-1))
    kinds = size.groupBy("cluster", "kind").agg(F.ceil(F.sum("c") / BLOCK).alias("k"))
    dealt = records.join(size.join(kinds, ["cluster", "kind"]).select("cluster", "root", "kind", "k"), ["cluster", "root"])
    dealt = dealt.select("rid", "n", "root", "cluster", "kind", F.xxhash64("cluster", "kind", F.pmod(F.xxhash64("rid"), "k")).alias("block"))
    dealt = materialise(dealt, "jaccard-blocks")
    ends = dealt.groupBy("cluster", "kind", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    other = ends.select("cluster", F.col("kind").alias("kind2"), F.col("block").alias("block2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = ends.join(other, "cluster").filter((F.col("block") <= F.col("block2")) & ((F.col("kind") == -1) | (F.col("kind") != F.col("kind2"))) & (F.col("hi") * 100 >= PERCENT * F.col("lo2")) & (F.col("hi2") * 100 >= PERCENT * F.col("lo"))).select("block", "block2")
    held = sets.join(dealt.select("rid", "root", "block"), "rid").groupBy("block").agg(F.collect_list(F.struct("rid", "root", "n", "tokens")).alias("held"))
    both = pairs.join(held.select(F.col("block").alias("block2"), F.col("held").alias("held2")), "block2").join(held, "block").select("held", "held2")

    def run(batches):
        import pyarrow as pa

        def read(cell):
            t = cell.values.field("tokens")
            return cell.values.field("rid").to_pylist(), cell.values.field("root").to_pylist(), cell.values.field("n").to_numpy(), t.flatten().to_numpy(), np.diff(t.offsets.to_numpy())

        for b in batches:
            for i in range(b.num_rows):
                (ra, ca, na, ta, la), (rb, cb, nb, tb, lb) = read(b.column("held")[i]), read(b.column("held2")[i])
                vocabulary, at = np.unique(np.concatenate([ta, tb]), return_inverse=True)
                shared = np.zeros((len(na), len(nb)), np.float32)
                rows_a, rows_b = np.repeat(np.arange(len(la)), la), np.repeat(np.arange(len(lb)), lb)
                for lo in range(0, len(vocabulary), 8192):  # slices of the vocabulary keep the matrices small
                    x, y = np.zeros((len(na), 8192), np.float32), np.zeros((len(nb), 8192), np.float32)
                    for m, rows, cols in ((x, rows_a, at[: len(ta)]), (y, rows_b, at[len(ta) :])):
                        own = (cols >= lo) & (cols < lo + 8192)
                        m[rows[own], cols[own] - lo] = 1
                    shared += x @ y.T
                union = na[:, None] + nb[None, :] - shared
                parent: dict[int, int] = {}

                def find(r):
                    while parent.get(r, r) != r:  # noqa: B023
                        r = parent[r]  # noqa: B023
                    return r

                u, v = [], []
                for j, k in zip(*np.nonzero(shared * 100 >= PERCENT * union), strict=True):
                    p, q = find(ca[j]), find(cb[k])
                    if p != q:
                        parent[p] = q
                        u.append(ra[j]), v.append(rb[k])
                yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return both.mapInArrow(lean(run), "u long, v long")


def link_components(sets: DataFrame) -> DataFrame:
    """sets (rid, n, match, prefix, tokens), one row for each record: components as rows (u, v), see `stars`."""
    posted = materialise(sets.select("rid", "n", F.explode("prefix").alias("token")), "jaccard-postings")
    fits = lambda a, b: F.least(a, b) * 100 >= PERCENT * F.greatest(a, b)
    buckets = materialise(posted.groupBy("token").agg(F.count("*").alias("size"), F.min(F.struct("rid", "n")).alias("lead")).filter("size > 1"), "jaccard-buckets")
    mine = posted.join(buckets.filter(F.col("size") <= SMALL_BUCKET).select("token"), "token")
    other = mine.select("token", F.col("rid").alias("b"), F.col("n").alias("n2"))
    few = mine.join(other, "token").filter((F.col("rid") < F.col("b")) & fits(F.col("n"), F.col("n2"))).select(F.col("rid").alias("a"), "b")
    large = posted.join(buckets.filter(F.col("size") > SMALL_BUCKET).select("token", "lead"), "token")
    led = large.filter((F.col("rid") != F.col("lead.rid")) & fits(F.col("n"), F.col("lead.n"))).select(F.col("lead.rid").alias("a"), F.col("rid").alias("b"))
    pairs = materialise(matched(few.unionByName(led).distinct(), sets), "jaccard-pairs")
    links = materialise(verified(pairs, sets), "jaccard-links")
    roots = stars(links)
    rooted = large.select("rid", "n", "token").join(roots.select(F.col("u").alias("rid"), F.col("v").alias("root")), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    unsettled = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("token")
    open_large = materialise(rooted.join(unsettled, "token", "left_semi"), "jaccard-open")
    more = materialise(block_links(open_large, sets), "jaccard-block-links")
    return stars(roots.unionByName(more))


def near_duplicates(docs: DataFrame, filter_bits: int = 0, frequent: int = 0) -> DataFrame:
    """doc_id, n_shingles, component_id of every document (doc_id, text).

    filter_bits and frequent sized a filter that is no longer made; they are taken and not used.
    """
    d = docs_of(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    listed = materialise(d.select("doc_id", "key", F.length("text").alias("n_chars")), "jaccard-texts")
    texts = materialise(listed.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("n_chars").alias("n_chars")), "jaccard-copies")
    one = few_or_shuffled(materialise(texts.filter("copies > 1 AND first IS NOT NULL").select("key", "first"), "jaccard-copied"))
    rows = d.join(one, "key", "left").filter("first IS NULL OR doc_id = first").select("key", "text")
    rows = shingle_sets(rows, texts.agg(F.sum("n_chars")).first()[0] or 0)
    ready = rows.filter("prefix IS NOT NULL")
    again = ready.groupBy("fp").agg(F.min("rid").alias("owner"), F.count("*").alias("copies")).filter("copies > 1")
    again = few_or_shuffled(materialise(ready.select("fp", "rid").join(again, "fp").filter("rid <> owner").select("rid"), "jaccard-again"))
    sets = ready.join(again, "rid", "left_anti")
    roots = link_components(sets)
    known = rows.select("key", "n", "fp").distinct()
    groups = known.filter("fp IS NOT NULL").join(texts.select("key", "first"), "key").groupBy("fp").agg(F.min("first").alias("first"))
    groups = materialise(groups.join(sets.select("fp", F.col("rid").alias("owner")), "fp", "left"), "jaccard-records")
    linked = groups.filter("owner IS NOT NULL").join(roots, F.col("owner") == F.col("u")).select("fp", "first", F.col("v").alias("root"))
    centres = groups.join(roots.select(F.col("v").alias("owner")).distinct(), "owner").select("fp", "first", F.col("owner").alias("root"))
    linked = linked.unionByName(centres)
    smallest = linked.groupBy("root").agg(F.min("first").alias("component"))
    named = groups.join(linked.join(smallest, "root").select("fp", "component"), "fp", "left").select("fp", F.coalesce("component", "first").alias("component"))
    named = known.join(named, "fp", "left").select("key", "n", "component")
    return listed.join(named, "key").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id")).alias("component_id"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
