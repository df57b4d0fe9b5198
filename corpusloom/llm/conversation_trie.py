"""Trie of conversation prefixes by whole-sequence collapse.

A node is a distinct sequence of first turns; its members are the conversations that start with it.

1. Turns become digests of role and text when they are read; texts aren't shuffled. Turns are numbered over ranges of (conversation, turn), so
   a conversation of any length is numbered by many tasks. A prefix is its depth and two 64-bit exclusive ors of hashes of (place, digest), a
   running value over the turns.
2. Identical conversations are collapsed into one weighted sequence with the list of those that end there. Only the smallest conversation of
   each keeps its path.
3. An anti-join drops the sequences that are proper prefixes of others; what stays are the leaves.
4. Paths, weighted, are aggregated by prefix: members, smallest member, leaves. Children are counted by parent.
5. Nodes with the same smallest member make a chain, a tail of that conversation's path. What a subtree saves is the sum over the rest of the node's
   chain plus the totals of the chains that hang below it; each chain adds its total once to each node above its top, so the work is linear in turns.

Running values go by blocks of `BLOCK` turns, with the totals of earlier blocks added; lists of ends are hashed from blocks of at most `BLOCK`
neighbouring conv_ids, a stream in order for lists of several blocks.

Turns are ordered by turn, null first; of equal turns by the digest of role and text, so repeated rows are turns of their own. Null role or text: empty.
Rows without a conv_id belong to no conversation and take no part. Very long texts are hashed in their row, very long conversations are dealt out. Empty table:
no rows. Other columns aren't read. Two different prefixes of 10**12 share a key with a probability of about 10**-15.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few_or_shuffled, materialise, running_total, shuffle_partitions, table

#: Turns, and conv_ids next to each other, that one task handles together.
BLOCK = 4096
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "s1", "s2"]


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest of role and text, words of the text."""
    c = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("role", "text")])
    return c.select("conv_id", "turn", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def numbered(turns: DataFrame) -> DataFrame:
    """turns with `place`, from 0 in each conversation.

    Rows are dealt by range, so only conversations that go on in the next range (at most one for each range) need the counts of earlier ranges.
    """
    spark = turns.sparkSession
    order = [F.asc_nulls_first("turn"), F.asc("digest")]
    dealt = materialise(turns.repartitionByRange(shuffle_partitions(spark), "conv_id", *order).withColumn("_part", F.spark_partition_id()), "trie-turns")
    ends = dealt.groupBy("_part").agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi"))
    cut = ends.select(F.col("hi").alias("conv_id")).join(ends.select(F.col("lo").alias("conv_id")), "conv_id", "left_semi").distinct()
    sizes = dealt.join(F.broadcast(cut), "conv_id", "left_semi").groupBy("_part", "conv_id").agg(F.count("*").alias("n"))
    before = running_total(sizes, "_part", ["n"], by=["conv_id"])
    place = F.row_number().over(Window.partitionBy("_part", "conv_id").orderBy(*order)) - 1
    local = dealt.withColumn("place", place.cast("long"))
    return local.join(F.broadcast(before), ["_part", "conv_id"], "left").withColumn("place", F.col("place") + F.coalesce("n_before", F.lit(0))).drop("_part", "n_before")


def running(rows: DataFrame, by: str, at: str, values: dict[str, str], how: Callable[[Column], Column], tag: str, down: bool = False) -> DataFrame:
    """`rows` (written) with running values {name: column} of `how` (sum, bit_xor) along the places `at` (from 0) within `by`, the row's own included; from the last place if `down`.

    Blocks of BLOCK places run on their own. The blocks of a `by` with several get the totals of those before them.
    """
    sign = -1 if down else 1
    rows = rows.withColumns({"_at": F.col(at) * sign, "_block": F.floor(F.col(at) / BLOCK).cast("long") * sign})
    w = Window.partitionBy(by, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({name: how(F.col(c)).over(w) for name, c in values.items()})
    long = rows.filter("_block <> 0").select(by).distinct()
    totals = rows.join(long, by, "left_semi").groupBy(by, "_block").agg(*[how(F.col(c)).alias(f"_{name}") for name, c in values.items()])
    earlier = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = few_or_shuffled(materialise(totals.select(by, "_block", *[F.coalesce(how(F.col(f"_{name}")).over(earlier), F.lit(0)).alias(f"_{name}") for name in values]), tag))
    joined = local.join(before, [by, "_block"], "left")
    return joined.withColumns({name: F.coalesce(how_two(how)(F.col(name), F.col(f"_{name}")), F.col(name)) for name in values}).drop("_at", "_block", *[f"_{name}" for name in values])


def how_two(how: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    return (lambda a, b: a.bitwiseXOR(b)) if how is F.bit_xor else (lambda a, b: a + b)


def ends(members: DataFrame) -> DataFrame:
    """KEY and ends_sha256 of the conversations (conv_id, KEY) that end at each node."""
    spark = members.sparkSession
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = materialise(members.groupBy(*KEY, F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(ids.alias("ids")), "trie-ends")
    lists = blocks.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("ids").alias("ids"))
    one = lists.filter("n = 1").select(*KEY, F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    several = blocks.join(lists.filter("n > 1").select(*KEY), KEY, "left_semi")

    def run(batches):
        import pyarrow as pa

        key, state, out = None, None, []
        for b in batches:
            for *k, ids in zip(*(b.column(c).to_pylist() for c in [*KEY, "ids"]), strict=True):
                if k != key:
                    if state:
                        out.append((*key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state:
            out.append((*key, state.hexdigest()))
        yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[*KEY, "ends_sha256"])

    ordered = several.repartition(shuffle_partitions(spark), *KEY).sortWithinPartitions(*KEY, "block").select(*KEY, "ids")
    return one.unionByName(ordered.mapInArrow(run, "depth long, s1 long, s2 long, ends_sha256 string"))


def trie(paths: DataFrame) -> DataFrame:
    """Nodes of turns (conv_id, depth from 1, digest, words); a row of depth 0 names each conversation.

    Gives conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the subtree, words that members after
    the first repeat), ends_sha256 (of the conv_ids that end there, ascending, with commas).
    """
    paths = paths.select("conv_id", F.col("depth").cast("long").alias("depth"), "words", *[F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(lane), "depth", "digest")).alias(x) for lane, x in (("a", "x1"), ("b", "x2"))])
    paths = materialise(paths, "trie-paths")
    keyed = running(paths, "conv_id", "depth", {"s1": "x1", "s2": "x2"}, F.bit_xor, "trie-blocks")
    keyed = materialise(keyed.select("conv_id", "depth", "s1", "s2", F.col("s1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("s2").bitwiseXOR(F.col("x2")).alias("p2"), "words"), "trie-keys")

    last = keyed.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("k")).select("conv_id", "k.*")
    members = materialise(last, "trie-members")
    sequences = materialise(members.groupBy(*KEY).agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id")), "trie-sequences")
    kept = keyed.join(sequences.select("conv_id", "weight", F.col("depth").alias("full")), "conv_id")
    kept = materialise(kept, "trie-kept")
    inner = kept.filter("depth < full").select(*KEY).distinct()
    leaves = sequences.join(inner, KEY, "left_anti").select("conv_id", F.lit(1).alias("leaf"))

    nodes = kept.join(leaves, "conv_id", "left").groupBy(*KEY).agg(F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.count("leaf").alias("n_leaves"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("words").alias("words"))
    nodes = materialise(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("words")), "trie-nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("s1"), F.col("p2").alias("s2")).agg(F.count("*").alias("n_children"))
    chains = nodes.groupBy("conv_id").agg(F.sum("own").alias("total"), F.min("depth").alias("top")).filter("total > 0 AND top > 0")
    below = kept.join(chains, "conv_id").filter("depth < top").groupBy(*KEY).agg(F.sum("total").alias("below"))

    no = lambda **given: [given.get(c, F.lit(None)).cast(t).alias(c) for c, t in (("n_children", "long"), ("below", "long"), ("ends_sha256", "string"))]
    facts = children.select(*KEY, *no(n_children=F.col("n_children"))).unionByName(below.select(*KEY, *no(below=F.col("below")))).unionByName(ends(members).select(*KEY, *no(ends_sha256=F.col("ends_sha256"))))
    facts = facts.groupBy(*KEY).agg(F.sum("n_children").alias("n_children"), F.sum("below").alias("below"), F.max("ends_sha256").alias("ends_sha256"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))

    tails = running(nodes, "conv_id", "depth", {"tail": "own"}, F.sum, "trie-tails", down=True)
    out = tails.join(facts, KEY, "left").join(parents, ["depth", "p1", "p2"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", zero("n_children"), "n_leaves", (F.col("tail") + F.coalesce("below", F.lit(0))).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are."""
    n = numbered(digests(conversations))
    roots = n.filter("place = 0").select("conv_id", F.lit(0).alias("depth"), "digest", F.lit(0).cast("long").alias("words"))
    return trie(roots.unionByName(n.select("conv_id", (F.col("place") + 1).cast("int").alias("depth"), "digest", "words")))


def branched(conversations: DataFrame, family: int = 20, most: int = 3) -> DataFrame:
    """Turns (conv_id, depth, digest, words) of conversations that begin with the first h turns of their family's first one, h = crc32(conv_id) % (most + 1)."""
    turns = digests(conversations).withColumns({"first": F.col("conv_id") - F.col("conv_id") % family, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)})
    firsts = turns.filter("conv_id = first").groupBy("first").agg(F.least(F.count("*"), F.lit(most)).alias("there"))
    turns = turns.join(firsts, "first", "left").withColumn("lent", F.least("h", F.coalesce("there", F.lit(0)))).drop("there")
    n = materialise(numbered(turns), "trie-numbered")
    own = n.filter("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("lent") + 1).alias("depth"), "digest", "words")
    convs = n.filter("place = 0").select("conv_id", "first", "lent")
    begun = n.filter(f"conv_id = first AND place < {most}").select("first", "place", "digest", "words")
    lent = convs.filter("lent > 0").join(begun, "first").filter("place < lent").select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "words")
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("words"))
    return roots.unionByName(lent).unionByName(own)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(branched(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


def _crc32(c: str) -> str:
    """Unsigned crc32 of a short ASCII text in SQL, by the polynomial's bits."""
    step = "CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END"
    byte = f"list_reduce(list_prepend(xor(s, b), [CAST(i AS BIGINT) FOR i IN range(8)]), lambda r, k: {step})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST(ord(x) AS BIGINT) FOR x IN string_split({c}, '')]), lambda s, b: {byte}), 4294967295::BIGINT)"


SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) - 1 AS place FROM t),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS first, {_crc32('conv_id::VARCHAR')} % 4 AS h FROM t),
r AS (SELECT c.conv_id, 0 AS part, place, role, text FROM c JOIN o ON o.conv_id = c.first WHERE place < h UNION ALL SELECT c.conv_id, 1, place, role, text FROM c JOIN o USING (conv_id) WHERE place >= h),
d AS (SELECT conv_id, row_number() OVER w AS depth, {{'role': role, 'text': text}} AS last, list({{'role': role, 'text': text}}) OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, place ROWS UNBOUNDED PRECEDING)),
p AS (SELECT conv_id, depth, len(regexp_extract_all(last.text, '[^\\x20\\x09-\\x0D]+')) AS words, path FROM d UNION ALL SELECT conv_id, 0, 0, [] FROM c),
f AS (SELECT conv_id, max(depth) AS full_depth FROM p GROUP BY ALL),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, list(conv_id ORDER BY conv_id) FILTER (WHERE depth = full_depth) AS ended, path[:depth - 1] AS up FROM p JOIN f USING (conv_id) GROUP BY path, depth),
k AS (SELECT up AS path, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path, depth)),
a AS (SELECT unnest(range(0, depth + 1)) AS lvl, path, (n_convs - 1) * words AS own, CAST(n_children = 0 AS BIGINT) AS leaf FROM m),
s AS (SELECT path[:lvl] AS path, lvl AS depth, CAST(sum(own) AS BIGINT) AS saved_tokens, CAST(sum(leaf) AS BIGINT) AS n_leaves FROM a GROUP BY ALL)
SELECT m.conv_id, m.depth, CASE WHEN m.depth > 0 THEN u.conv_id END AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(array_to_string(m.ended, ','), '')) AS ends_sha256
FROM m JOIN s ON m.path = s.path AND m.depth = s.depth LEFT JOIN n u ON u.path = m.up AND u.depth = m.depth - 1"""
