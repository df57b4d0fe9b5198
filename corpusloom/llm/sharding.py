"""Minimax contiguous partition into shards.

Documents with equal texts form an atomic group. Groups are ordered by their smallest doc_id; the
smallest capacity for which a greedy walk over the group sizes needs no more than `shards` shards is found
by binary search, and the groups are cut there (law `bytes`).

The walk only asks for the last prefix sum up to a value. Prefix sums are made in parallel and written;
the driver holds at most a fixed number of them: sums of even bins first, then those of the
bins in which a cut can fall, until lower and upper bound of the capacity meet. Within
that capacity each cut is moved to the group end nearest to the mean of what is left, so that one
huge group leaves no shards empty.

Null text: size 8, checksum 0, a group of its own kind. Empty text: size 8. Repeated rows: members of one group.
Null doc_id: sorts first. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import docs_of, materialise, range_number, running_total, shuffle_partitions, split_points, table

#: Prefix sums that the driver holds at once for each level of refinement.
BINS = 8192


def ordered_groups(groups: DataFrame) -> DataFrame:
    """groups (gkey, first, size, n) with inclusive byte sums and exclusive row sums in their order, written."""
    spark = groups.sparkSession
    points = split_points(groups, "first", shuffle_partitions(spark))
    dealt = groups.withColumn("pid", range_number(F.col("first"), points).cast("int"))
    w = Window.partitionBy("pid").orderBy("first", "gkey").rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumn("bytes_in", F.sum("size").over(w)).withColumn("rows_in", F.sum("n").over(w))
    local = materialise(local, "shard-groups")
    base = running_total(local.groupBy("pid").agg(F.sum("size").alias("b"), F.sum("n").alias("r")), "pid", ["b", "r"])
    return materialise(local.join(base, "pid").select("gkey", "n", "size", (F.col("b_before") + F.col("bytes_in")).alias("end_bytes"), (F.col("r_before") + F.col("rows_in") - F.col("n")).alias("rows_before")).sortWithinPartitions("end_bytes"), "shard-order")


class Bounds:
    """Known prefix sums and, between them, spans whose sums aren't known yet."""

    def __init__(self, ends: np.ndarray, unknown: np.ndarray):
        self.ends, self.unknown = ends, unknown  # unknown[i]: there are sums between ends[i - 1] and ends[i]

    def last(self, x: int, hopeful: bool) -> int:
        i = bisect_right(self.ends, x)
        if hopeful and i < len(self.ends) and self.unknown[i]:
            return x
        return int(self.ends[i - 1]) if i else 0

    def walk(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        total, at, cuts = int(self.ends[-1]), 0, []
        for _ in range(shards):
            at = self.last(at + capacity, hopeful) if at + capacity < total else total
            cuts.append(at)
        return cuts

    def smallest(self, lo: int, hi: int, shards: int, hopeful: bool) -> int:
        total = int(self.ends[-1])
        while lo < hi:
            mid = (lo + hi) // 2
            if self.walk(mid, shards, hopeful)[-1] >= total:
                hi = mid
            else:
                lo = mid + 1
        return lo


def capacity_of(groups: DataFrame, shards: int, bins: int = BINS) -> tuple[int, int]:
    """The smallest feasible capacity and the total size."""
    top = groups.agg(F.max("size").alias("m"), F.max("end_bytes").alias("t")).first()
    if top["t"] is None:
        return 0, 0
    total, most = int(top["t"]), int(top["m"])

    def sums(where, width):
        """The last sum in each `width` bytes and how many sums there are."""
        q = (F.col("end_bytes") - 1 - (F.col("end_bytes") - 1) % F.lit(width)).alias("q")
        rows = groups.filter(where).groupBy(q).agg(F.max("end_bytes").alias("e"), F.count("*").alias("n")).collect()
        return sorted((r["e"], r["n"] > 1) for r in rows)

    width = max(1, -(-total // bins))
    got = sums(F.lit(True), width)
    b = Bounds(np.array([e for e, _ in got], np.int64), np.array([u for _, u in got]))
    while True:
        floor = max(most, -(-total // shards))
        lo = b.smallest(floor, total, shards, True)
        hi = b.smallest(floor, total, shards, False)
        if lo == hi:
            return hi, total
        near, far = b.walk(lo, shards, False), b.walk(hi, shards, True)
        want = set()
        for k, (a, z) in enumerate(zip(near, far, strict=True)):
            a, z = min(a, b.walk(lo, shards, True)[k]), max(z, b.walk(hi, shards, False)[k])
            i, j = bisect_right(b.ends, a), bisect_right(b.ends, z)
            want.update(x for x in range(i, min(j, len(b.ends) - 1) + 1) if b.unknown[x])
        if not want:
            return hi, total
        width = max(1, width // max(2, bins // len(want)))
        spans = []
        for x in sorted(want):
            a, z = int(b.ends[x - 1]) if x else 0, int(b.ends[x])
            if spans and spans[-1][1] == a:
                spans[-1][1] = z
            else:
                spans.append([a, z])
        where = F.lit(False)
        for a, z in spans:
            where = where | ((F.col("end_bytes") > a) & (F.col("end_bytes") <= z))
        fine = sums(where, width)
        merged = {int(e): bool(u) for i, (e, u) in enumerate(zip(b.ends, b.unknown, strict=True)) if i not in want}
        merged.update(dict(fine))
        keys = sorted(merged)
        b = Bounds(np.array(keys, np.int64), np.array([merged[k] for k in keys]))


def even_cuts(groups: DataFrame, capacity: int, total: int, shards: int) -> list[int]:
    """Ends of all shards but the last, none over the capacity."""
    at, cuts = 0, []
    for k in range(shards - 1):
        aim = at + (total - at) / (shards - k)
        r = groups.filter(F.col("end_bytes") > at).agg(F.max(F.when(F.col("end_bytes") <= aim, F.col("end_bytes"))).alias("lo"), F.min(F.when(F.col("end_bytes") > aim, F.col("end_bytes"))).alias("hi")).first()
        options = [int(x) for x in (r["lo"], r["hi"]) if x is not None and x - at <= capacity]
        at = min(options, key=lambda x: abs(x - aim)) if options else at
        cuts.append(at)
    if any(b - a > capacity for a, b in zip([0, *cuts], [*cuts, total], strict=True)):
        cuts = []
        at = 0
        for _ in range(shards - 1):
            r = groups.filter((F.col("end_bytes") > at) & (F.col("end_bytes") <= at + capacity)).agg(F.max("end_bytes").alias("e")).first()
            at = int(r["e"]) if r["e"] is not None else at
            cuts.append(at)
    return cuts


def shard(docs: DataFrame, shards: int = 24, bins: int = BINS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document (doc_id, text)."""
    spark = docs.sparkSession
    d = docs_of(docs)
    lean = d.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"), F.coalesce(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), F.lit("null").cast("binary")).alias("gkey"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(4 * shuffle_partitions(spark))).cast("int")
    lean = materialise(lean.withColumn("salt", salt), "shard-lean")
    salted = lean.groupBy("gkey", "salt").agg(F.min("doc_id").alias("first"), F.sum("size").alias("size"), F.count("*").alias("n"))
    groups = ordered_groups(salted.groupBy("gkey").agg(F.min("first").alias("first"), F.sum("size").alias("size"), F.sum("n").alias("n")))
    capacity, total = capacity_of(groups, shards, bins)
    cuts = even_cuts(groups, capacity, total, shards) if total else []
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col("end_bytes") > c).cast("int")
    placed = groups.withColumn("shard", number.cast("int"))
    firsts = placed.groupBy("shard").agg(F.min("rows_before").alias("shard_first"))
    placed = placed.join(F.broadcast(firsts), "shard")  # one row for each shard
    before = Window.partitionBy("gkey").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.select("gkey", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("salt_first")).join(placed.select("gkey", "shard", "shard_first", "rows_before"), "gkey").select("gkey", "salt", "shard", (F.col("rows_before") - F.col("shard_first") + F.col("salt_first")).alias("base"))
    own = Window.partitionBy("gkey", "salt").orderBy("doc_id")
    return lean.withColumn("rank", F.row_number().over(own) - 1).join(bases, ["gkey", "salt"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank")).alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
