"""WARC records with a Merkle fixity audit.

Pages become WARC response records, in order of page_id, with their offsets in one archive. The tree over a replica has
leaves over ranges of `FAN` page_ids: the hash of their records' ids, hashes and offsets within the range. Above them
are nodes over `FAN` neighbouring ranges, with the bytes each holds, up to one root. As ranges are of ids and
offsets relative, a lost or added record changes its own branch alone. Trees are written, level by level. An
audit compares the roots and descends only below nodes that differ; inside a leaf that differs records are compared by page_id.

Only DataFrame functions. Offsets come from sums over ranges of page_id, trees from grouped levels.

Null url or html: empty. Very long html: hashed in its row, never gathered. Null page_id sorts first and belongs to the range of 0. Repeated rows and ties: records of
their own, ordered by their hash. Empty table: no rows. Status of a record: ok; corrupt (the copy has other bytes under its page_id);
missing (the copy has too few of its page_id); extra (too many: a row of the copy, with its place there). Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, range_number, running_total, shuffle_partitions, split_points, table

FAN = 16
_FIRST = -(1 << 63)


def record(url: Column, html: Column, page_id: Column) -> Column:
    """The record's text; Content-Length counts the payload's bytes."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.sha2(body.cast("binary"), 256), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def replica(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) to (page_id, length, sha256) of their records."""
    rec = record(F.col("url").cast("string"), F.col("html").cast("string"), F.col("page_id"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), rec.alias("_r")).select("page_id", F.octet_length("_r").cast("long").alias("length"), F.sha2(F.col("_r").cast("binary"), 256).alias("sha256"))


def leaves(records: DataFrame) -> DataFrame:
    """Records numbered in order, with the offset range each has in the archive."""
    spark = records.sparkSession
    n = shuffle_partitions(spark)
    keyed = materialise(records.withColumn("_k", F.coalesce("page_id", F.lit(_FIRST))), "warc-records")
    points = split_points(keyed, "_k", n)
    dealt = keyed.withColumn("_range", range_number(F.col("_k"), points).cast("int"))
    w = Window.partitionBy("_range").orderBy("_k", "sha256", "length")
    local = dealt.withColumn("_row", F.row_number().over(w) - 1).withColumn("_end", F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    base = running_total(dealt.groupBy("_range").agg(F.sum("length").alias("b"), F.count("*").alias("r")), "_range", ["b", "r"])
    at = F.col("_end") - F.col("length") + F.col("b_before")
    return local.join(base, "_range").select(at.alias("start"), (at + F.col("length")).alias("end"), "page_id", "sha256")


def _bits(fan: int) -> int:
    if fan & (fan - 1):
        raise ValueError("the fan must be a power of two")
    return fan.bit_length() - 1


def _grouped(rows: DataFrame, *of: str) -> DataFrame:
    """node, bytes, hash: of the ordered columns of each node's rows."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*of))), lambda x: F.concat_ws(":", *[F.coalesce(x[c].cast("string"), F.lit("")) for c in of]))
    return rows.groupBy("node").agg(F.sum("bytes").alias("bytes"), F.sha2(F.array_join(listed, ";"), 256).alias("hash"))


def tree(records: DataFrame, fan: int, depth: int) -> DataFrame:
    """The nodes of a replica, written: (level, node, bytes, hash); level 0 has the leaves, level depth + 1 the root.

    records: (page_id, start, end, sha256), as `leaves` gives them.
    """
    bits = _bits(fan)
    rows = records.select(F.shiftright(F.coalesce("page_id", F.lit(0)), bits).alias("node"), "page_id", "sha256", "start", (F.col("end") - F.col("start")).alias("bytes"))
    first = rows.groupBy("node").agg(F.min("start").alias("first"))
    level = _grouped(rows.join(first, "node").withColumn("at", F.col("start") - F.col("first")), "at", "page_id", "sha256", "bytes")
    out = None
    for k in range(depth + 2):
        if k:
            up = F.shiftright("child", bits) if k <= depth else F.lit(0).cast("long")
            level = _grouped(level.withColumnRenamed("node", "child").withColumn("node", up), "child", "bytes", "hash")
        level = materialise(level, f"warc-level-{k}")
        one = level.withColumn("level", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def depth_of(*records: DataFrame, fan: int = FAN) -> int:
    """Levels between leaves and root that trees over all of these records need."""
    ends = [r.agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi")).first() for r in records]
    lo, hi = min((min(r["lo"], 0) for r in ends if r["lo"] is not None), default=0), max((max(r["hi"], 0) for r in ends if r["hi"] is not None), default=0)
    bits, k = _bits(fan), 0
    while (hi >> bits * (k + 1)) - (lo >> bits * (k + 1)) >= fan:
        k += 1
    return k


def audit(a: DataFrame, b: DataFrame, depth: int, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Nodes that were compared, and the leaves (node) that differ."""
    bits, parents, seen = _bits(fan), None, None
    for k in range(depth + 1, -1, -1):
        x, y = (t.filter(F.col("level") == k).select("node", "bytes", "hash") for t in (a, b))
        if parents is not None:
            up = F.shiftright("node", bits) if k < depth else F.lit(0).cast("long")
            x, y = (t.withColumn("up", up).join(parents, "up", "left_semi").drop("up") for t in (x, y))
        both = x.alias("x").join(y.alias("y"), F.col("x.node") == F.col("y.node"), "full_outer")
        both = materialise(both.select(F.lit(k).alias("level"), F.coalesce("x.node", "y.node").alias("node"), (~F.col("x.hash").eqNullSafe(F.col("y.hash"))).alias("differs")), f"warc-audit-{k}")
        seen = both if seen is None else seen.unionByName(both)
        parents = both.filter("differs").select(F.col("node").alias("up"))
    return seen, both.filter("differs").select("node")


def scan(pages: DataFrame, copy: DataFrame, fan: int = FAN) -> DataFrame:
    """Every record of the archive with its place, hash and what the audit of `copy` found; extra records with their place in the copy."""
    a, b = (materialise(leaves(replica(x)), "warc-leaves") for x in (pages, copy))
    depth = depth_of(a, b, fan=fan)
    _, bad = audit(tree(a, fan, depth), tree(b, fan, depth), depth, fan)
    node = F.shiftright(F.coalesce("page_id", F.lit(0)), _bits(fan))
    columns = ["page_id", "start", "end", "sha256"]
    good = a.withColumn("node", node).join(bad, "node", "left_anti").select(*columns, F.lit("ok").alias("status"))

    def numbered(t, *by):
        return t.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("sha256", "start")))

    x, y = (materialise(numbered(t.withColumn("node", node).join(bad, "node", "left_semi").select(*columns), "page_id", "sha256"), "warc-differing") for t in (a, b))
    same = lambda s, t, *on: [s[c].eqNullSafe(t[c]) for c in on]
    kept = x.join(y, same(x, y, "page_id", "sha256", "nth"), "left_semi").select(*columns, F.lit("ok").alias("status"))
    lost = numbered(x.join(y, same(x, y, "page_id", "sha256", "nth"), "left_anti").drop("nth"), "page_id")
    new = numbered(y.join(x, same(y, x, "page_id", "sha256", "nth"), "left_anti").drop("nth"), "page_id")
    lost, new = lost.alias("l"), new.alias("n")
    met = lost.join(new, F.col("l.page_id").eqNullSafe(F.col("n.page_id")) & (F.col("l.nth") == F.col("n.nth")), "full_outer")
    status = F.when(F.col("n.start").isNull(), "missing").when(F.col("l.start").isNull(), "extra").otherwise("corrupt")
    own = F.col("l.start").isNotNull()
    met = met.select(*[F.when(own, F.col(f"l.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in columns], status.alias("status"))
    return good.unionByName(kept).unionByName(met)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' archive against a copy in which some pages' last character was overwritten.

    Which pages are hurt follows from their address: those whose MD5 ends in the digit 7.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    hurt = F.md5(F.coalesce(F.col("url"), F.lit("")).cast("binary")).endswith("7") & (F.length("html") > 0)
    copy = pages.withColumn("html", F.when(hurt, F.concat(F.expr("substring(html, 1, length(html) - 1)"), F.lit("\x07"))).otherwise(F.col("html")))
    return scan(pages, copy).select("page_id", "start", (F.col("end") - F.col("start")).alias("length"), F.col("sha256").alias("record_sha256"), "status")


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
r AS (
  SELECT page_id, url, html, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10),
    'WARC-Target-URI: ', url, chr(13), chr(10), 'WARC-Payload-Digest: sha256:', sha256(html), chr(13), chr(10), 'Content-Length: ', strlen(html), chr(13), chr(10), chr(13), chr(10), html, chr(13), chr(10), chr(13), chr(10)) AS rec
  FROM p)
SELECT page_id, CAST(sum(strlen(rec)) OVER (ORDER BY page_id) - strlen(rec) AS BIGINT) AS start, strlen(rec) AS length, sha256(rec) AS record_sha256,
  CASE WHEN length(html) > 0 AND right(html, 1) <> chr(7) AND right(md5(url), 1) = '7' THEN 'corrupt' ELSE 'ok' END AS status
FROM r
"""
