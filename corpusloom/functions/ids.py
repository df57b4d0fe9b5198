"""Identifiers: namespaces, vector ids, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _slug(c: Column) -> Column:
    s = F.substring(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^a-z0-9_-]", "_"), 1, 64)
    return F.when(s == "", "default").otherwise(s)


def namespace(tenant: Column, corpus: Column) -> Column:
    return F.concat_ws("__", _slug(tenant), _slug(corpus))


def parse_namespace(ns: Column) -> tuple[Column, Column]:
    """Tenant and corpus; both default if the name has no separator."""
    parts = F.split(ns, "__", 2)
    ok = F.size(parts) == 2
    return F.when(ok, F.get(parts, F.lit(0))).otherwise("default"), F.when(ok, F.get(parts, F.lit(1))).otherwise("default")


def vector_id(doc: Column, version: Column, page: Column, chunk: Column) -> Column:
    return F.concat_ws(":", doc.cast("string"), version.cast("string"), page.cast("string"), chunk.cast("string"))


def parse_vector_id(vid: Column) -> Column:
    """(doc_id, version, page, chunk_index); a malformed id is a document's with zeros."""
    p = F.split(vid, ":", 4)
    numbers = [F.get(p, F.lit(i)).try_cast("int") for i in (1, 2, 3)]
    ok = (F.size(p) == 4) & numbers[0].isNotNull() & numbers[1].isNotNull() & numbers[2].isNotNull()
    return F.struct(F.when(ok, F.get(p, F.lit(0))).otherwise(vid).alias("doc_id"), *[F.when(ok, n).otherwise(0).alias(a) for n, a in zip(numbers, ("version", "page", "chunk_index"), strict=True)])


def epoch(date: Column) -> Column:
    """Seconds of an ISO date or time in UTC; 0 if it is none."""
    return F.coalesce(F.unix_seconds(F.try_to_timestamp(date)), F.lit(0).cast("long"))


def pdf_date(raw: Column) -> Column:
    """D:YYYYMMDD... to an ISO date, or null."""
    return F.date_format(F.try_to_timestamp(F.substring(F.regexp_replace(raw, "^D:", ""), 1, 8), F.lit("yyyyMMdd")), "yyyy-MM-dd")
