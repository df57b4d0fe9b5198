"""Document fingerprints: a Merkle tree over paragraphs and sections.

A paragraph is a line, a section a run of `SECTION` paragraphs. The tree has the paragraphs' hashes as
leaves, sections above them and one root, which differs whenever the texts do. Below each leaf hang the short hashes of
the paragraph's pieces, so likeness can be told inside a changed branch. The fingerprint is the tree written out:
`root:sections:pieces`.

Likeness is the Dice coefficient of the sets of pieces: 2 * common / (pieces of one + pieces of the other);
1 if both have none.

Only DataFrame functions. To find each document's successor, rows are dealt by ranges of doc_id; each
range also gets the next range's first row, so no rows meet in one task but those of a range.

Null text: empty; an empty text has one empty paragraph and no pieces. Repeated doc_ids: ordered by a hash of their text,
each row has its own successor. Null doc_id: sorts first. One row: its own successor. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import docs_of, range_number, shuffle_partitions, split_points, table

SECTION = 8
#: Paragraphs of at least SHORT characters have pieces of PIECE characters, shorter ones of SHORT_PIECE.
SHORT, PIECE, SHORT_PIECE = 128, 32, 8
_FIRST = -(1 << 63)


def pieces(text: Column) -> Column:
    """Distinct hashes of a text's pieces. Pieces start anew in each paragraph, so an edit moves only those behind it in its own."""
    cut = F.transform(
        F.split(text, "\n"),
        lambda p: F.when(F.length(p) < SHORT, F.regexp_extract_all(p, F.lit(f"(?s).{{1,{SHORT_PIECE}}}"), F.lit(0))).otherwise(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))),
    )
    return F.array_distinct(F.transform(F.flatten(cut), lambda x: F.hash(x)))


def paragraphs(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda p: F.sha2(p, 256))


def sections(leaves: Column) -> Column:
    """leaves: a column of the frame, not an expression, which would be computed anew for each section."""
    starts = F.sequence(F.lit(0), (F.size(leaves) - 1) - (F.size(leaves) - 1) % SECTION, F.lit(SECTION))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(leaves, i + 1, SECTION), ""), 256))


def root(section_hashes: Column) -> Column:
    return F.sha2(F.concat(F.size(section_hashes).cast("string"), F.lit(":"), F.array_join(section_hashes, "")), 256)


def written(root_hash: Column, section_hashes: Column, piece_hashes: Column) -> Column:
    short = F.array_join(F.transform(section_hashes, lambda s: F.substring(s, 1, 16)), ".")
    return F.concat(root_hash, F.lit(":"), short, F.lit(":"), F.array_join(F.transform(piece_hashes, lambda p: F.lpad(F.hex(p.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def differing_sections(a: Column, b: Column) -> Column:
    """Numbers of the sections in which two trees differ (from 0); sections that only one has differ."""
    n = F.greatest(F.size(a), F.size(b))
    return F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.try_element_at(a, i + 1).eqNullSafe(F.try_element_at(b, i + 1)))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with pieces and the successor's text and pieces."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    keyed = docs.withColumn("_k", F.coalesce("doc_id", F.lit(_FIRST)))
    points = split_points(keyed, "_k", 4 * n)
    dealt = keyed.withColumn("_range", range_number(F.col("_k"), points).cast("int")).withColumn("_ghost", F.lit(0))
    firsts = {r["_range"]: r["k"] for r in dealt.groupBy("_range").agg(F.min("_k").alias("k")).collect()}  # one row for each range
    if firsts:
        order = sorted(firsts)
        after = {firsts[order[(i + 1) % len(order)]]: r for i, r in enumerate(order)}
        own = F.create_map(*[F.lit(x) for k, r in after.items() for x in (k, r)])
        ghosts = keyed.filter(F.col("_k").isin(*after)).withColumn("_range", own[F.col("_k")].cast("int")).withColumn("_ghost", F.lit(1))
        dealt = dealt.unionByName(ghosts)
    text = F.coalesce("text", F.lit(""))
    rows = dealt.withColumn("text", text).repartition(n, "_range").withColumn("_tie", F.xxhash64("text")).sortWithinPartitions("_range", "_ghost", "_k", "_tie").withColumn("_pieces", pieces(F.col("text")))
    w = Window.partitionBy("_range").orderBy("_ghost", "_k", "_tie")
    return rows.withColumn("_next", F.lead(F.struct("text", "_pieces")).over(w)).filter("_ghost = 0")


def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprints of the texts of docs (doc_id, text) and of their texts edited with the next one's start."""
    d = with_next(docs_of(docs))
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    d = d.withColumn("n_chars", n.cast("long")).withColumn("_edited", F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("_next.text"), F.lit(1), k)))
    d = d.select("doc_id", "n_chars", "_pieces", F.col("_next._pieces").alias("_next_pieces"), paragraphs(F.col("text")).alias("_leaves"), F.sha2("_edited", 256).alias("edited_sha256"), paragraphs(F.col("_edited")).alias("_edited_leaves"), pieces(F.col("_edited")).alias("_edited_pieces"))
    d = d.withColumn("_sections", sections(F.col("_leaves"))).withColumn("_edited_sections", sections(F.col("_edited_leaves")))
    return d.select(
        "doc_id", "n_chars", "edited_sha256",
        written(root(F.col("_sections")), F.col("_sections"), F.col("_pieces")).alias("fingerprint"),
        written(root(F.col("_edited_sections")), F.col("_edited_sections"), F.col("_edited_pieces")).alias("edited_fingerprint"),
        likeness(F.col("_pieces"), F.col("_edited_pieces")).alias("near_edited"),
        likeness(F.col("_pieces"), F.col("_next_pieces")).alias("near_next"),
        F.array_join(differing_sections(F.col("_sections"), F.col("_edited_sections")), ",").alias("edited_sections"),
    )


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"))
