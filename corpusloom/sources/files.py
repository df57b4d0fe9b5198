"""File manifests, per-format document scans, HTML and Markdown to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 50 * 1024 * 1024

# Extensions and what their content must look like.
MIME = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "csv": "text/csv",
    "html": "text/html",
    "txt": "text/plain",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}


def extension(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def mime(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(table[ext], F.lit("application/octet-stream"))


def sniffed(content: Column) -> Column:
    """Kind of content by its first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    start = F.lower(F.ltrim(F.substring(content, 1, 64).cast("string")))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "zip").when(head.startswith("D0CF11E0"), "ole").when(start.startswith("<!doctype html") | start.startswith("<html"), "html").otherwise("text")


def rejection(max_bytes: int = MAX_BYTES) -> Column:
    """Why a file (path, length, content) isn't taken; null: it is."""
    ext, kind = extension(F.col("path")), sniffed(F.col("content"))
    agrees = F.when(kind == "pdf", ext == "pdf").when(kind == "zip", ext.isin("docx", "xlsx")).when(kind == "ole", ext.isin("docx", "xlsx")).when(kind == "html", ext == "html").otherwise(ext.isin("csv", "txt", "html"))
    return F.when(F.col("length") == 0, "empty").when(ext == "", "no extension").when(~ext.isin(*MIME), "unsupported type").when(F.col("length") > max_bytes, "too large").when(~agrees, "content is not what the extension says")


def validate(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """files (path, length, content) to path, extension, mime, length, reject_code, reject_reason (nulls: accepted)."""
    ext, reason = extension(F.col("path")), rejection(max_bytes)
    code = F.when(reason.isin("unsupported type", "content is not what the extension says"), 415).when(reason.isNotNull(), 400)
    return files.select("path", ext.alias("extension"), mime(ext).alias("mime"), "length", code.alias("reject_code"), reason.alias("reject_reason"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_text(html: Column) -> Column:
    """Text of the page: no scripts, styles, navigation or comments; table rows as |a|b|; entities resolved."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|nav|head)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?is)</t[dh]>\s*<t[dh][^>]*>", " | ")
    t = F.regexp_replace(t, r"(?is)<tr[^>]*>\s*<t[dh][^>]*>", "\n| ")
    t = F.regexp_replace(t, r"(?is)</t[dh]>\s*</tr>", " |\n")
    t = F.regexp_replace(t, r"(?is)<br\s*/?>|</(p|div|h[1-6]|li|article|section|ul|ol|table)>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for name, sign in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(sign))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def markdown_text(md: Column) -> Column:
    """Markdown without its marks; table rows as their cells."""
    t = F.regexp_replace(md, r"!\[[^\]]*\]\([^)]*\)", "")
    t = F.regexp_replace(t, r"\[([^\]]+)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"(?m)^#{1,6}\s+", "")
    t = F.regexp_replace(t, r"`{1,3}[^`]+`{1,3}", "")
    t = F.regexp_replace(t, r"\*{1,2}([^*\n]+)\*{1,2}", "$1")
    t = F.regexp_replace(t, r"\b_{1,2}([^_\n]+)_{1,2}\b", "$1")
    t = F.regexp_replace(t, r"(?m)^\s*[-*+]\s+", "")
    t = F.regexp_replace(t, r"(?m)^[ \t]*\|?[ \t:|-]*-[ \t:|-]*$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?m)^\|\s*|\s*\|$", ""), r" *\| *", " ")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def scan(files: DataFrame) -> DataFrame:
    """files (path, length, content) to path, text, parser, status, fallback_used, attempts.

    Each type has an order of extractors; the first that gives text wins. Bytes that aren't UTF-8 fail the first two and are read as Latin-1 by the last.
    """
    latin = F.decode("content", "ISO-8859-1")
    raw = files.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("raw"), latin.alias("latin"), extension(F.col("path")).alias("extension"), rejection().alias("reject_reason"))
    html, plain = html_text(F.col("raw")), F.regexp_replace("raw", r"^\s+|\s+$", "")
    first = F.when(F.col("extension") == "html", html).when(F.col("extension").isin("txt", "csv"), plain)
    old = F.regexp_replace("latin", r"^\s+|\s+$", "")
    one, two, three = F.when(first != "", first), F.when(plain != "", plain), F.when(F.col("raw").isNull() & (old != ""), old)
    ok = F.col("reject_reason").isNull()
    name = F.when(F.col("extension") == "html", "html_text").otherwise("plain_text")
    attempts = F.array(F.struct(name.alias("parser"), one.isNotNull().alias("succeeded")), F.struct(F.lit("raw_text").alias("parser"), two.isNotNull().alias("succeeded")), F.struct(F.lit("latin_text").alias("parser"), three.isNotNull().alias("succeeded")))
    text = F.when(ok, F.coalesce(one, two, three))
    return raw.select("path", text.alias("text"), F.when(text.isNull(), None).when(one.isNotNull(), name).when(two.isNotNull(), "raw_text").otherwise("latin_text").alias("parser"), F.when(text.isNotNull(), "parsed").otherwise("failed").alias("status"), (text.isNotNull() & one.isNull()).alias("fallback_used"), attempts.alias("attempts"))
