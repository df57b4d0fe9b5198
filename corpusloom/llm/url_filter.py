"""URL filters with a sorted digest array.

A rule is a host, a path and a verdict. It fits the urls of its host and of all subdomains whose path starts with the rule's
path. Of the rules that fit a url the longest wins (code points of host and path; of equally long ones that with the longer host);
a url that no rule fits gets `default`.

1. The list becomes one binary file: xxhash64 digests of the rules' strings in ascending order, the strings themselves, the
   verdicts; and the same for the rules' hosts, each with the lengths of path that its rules have.
2. Executors fetch the file once (`SparkContext.addFile`), an executor lost comes back with it; workers memory-map it, so that
   those of one machine share its pages.
3. A batch of urls is probed by binary search over whole arrays: first the ends of its distinct hosts, then, for the hosts found
   only, host and path up to each of their lengths. A digest that is met counts if the stored string is the same.

A list of more than `LIST_BYTES` isn't handed out: distinct (host, path) pairs are joined with it by digest and string.

Null url or one without `://`: host and path are empty and no rule fits. Very long urls: only ends of the host that are no longer than the longest host of
a rule are probed, and path lengths that rules have. Repeated rows: each judged. Empty table: no rows. Rules with a null or empty host or a null verdict, or a
path that neither is empty nor starts with `/`, fit nothing; a null path is an empty one; of equal rules `block` wins. An empty list gives `default` everywhere.
Other columns pass through, whatever their names; those named like the results (host, path, rule, verdict) are replaced.
"""

from __future__ import annotations

import os
import string
import struct
import tempfile
import uuid

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_table, table

#: A list of at most so many bytes is handed to the executors.
LIST_BYTES = 128_000_000
#: Seed of Spark's xxhash64.
SEED = 42
_HEAD = struct.Struct("<8s6Q")
_MAGIC = b"URLRULE1"

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with the url's host (A-Z lower-cased) and path."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + F.lit(3), F.length(u))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), "^[^?#]*", 0)
    return pages.withColumns({"path": path, "host": lower(host)}) if url not in ("host", "path") else pages.withColumn("_url", F.col(url)).transform(with_host_and_path, "_url").drop("_url")


def clean(rules: DataFrame) -> DataFrame:
    """host, path, key, verdict of the rules that can fit, each once."""
    r = rules.select(lower(F.col("host").cast("string")).alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("verdict").cast("string").alias("verdict"))
    r = r.filter("host <> '' AND NOT host RLIKE '[/?#]' AND verdict IS NOT NULL AND (path = '' OR startswith(path, '/'))")
    return r.groupBy("host", "path").agg(F.when(F.bool_or(F.col("verdict") == "block"), "block").otherwise(F.min("verdict")).alias("verdict")).withColumn("key", F.concat("host", "path"))


class Digests:
    """Strings by the order of their digests: `find` gives the place of each string asked for, or -1."""

    def __init__(self, digests: np.ndarray, ends: np.ndarray, blob: np.ndarray, bits: int):
        self.digests, self.ends, self.blob, self.bits = digests, ends, blob, bits

    @staticmethod
    def of(strings: list[bytes], digests: np.ndarray, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The order of the strings and the arrays in that order."""
        d = digests >> np.uint64(64 - bits)
        order = np.argsort(d, kind="stable")
        sizes = np.array([len(strings[i]) for i in order], np.uint64)
        return order, [d[order], np.concatenate([np.zeros(1, np.uint64), np.cumsum(sizes, dtype=np.uint64)]), np.frombuffer(b"".join(strings[i] for i in order), np.uint8)]

    def find(self, strings: list[bytes]) -> np.ndarray:
        import xxhash

        found = np.full(len(strings), -1, np.int64)
        if not len(self.digests) or not strings:
            return found
        asked = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in strings), np.uint64, len(strings)) >> np.uint64(64 - self.bits)
        place = np.searchsorted(self.digests, asked)
        open_ = np.arange(len(strings))
        while True:  # again for strings whose digest others share
            open_ = open_[place[open_] < len(self.digests)]
            open_ = open_[self.digests[place[open_]] == asked[open_]]
            if not len(open_):
                return found
            same = np.fromiter((self.blob[self.ends[place[i]] : self.ends[place[i] + 1]].tobytes() == strings[i] for i in open_), bool, len(open_))
            found[open_[same]] = place[open_[same]]
            open_ = open_[~same]
            place[open_] += 1


def packed(rows: dict[str, list], bits: int = 64) -> bytes:
    """The file of a list (host, path, verdict, key_digest, host_digest)."""
    unsigned = lambda xs: np.array(xs, np.int64).view(np.uint64)
    keys = [(h + p).encode() for h, p in zip(rows["host"], rows["path"], strict=True)]
    order, key_arrays = Digests.of(keys, unsigned(rows["key_digest"]), bits)
    names = sorted(set(rows["verdict"]))
    verdicts = np.array([names.index(rows["verdict"][i]) for i in order], np.uint32)
    lengths: dict[str, set[int]] = {}
    digest = dict(zip(rows["host"], rows["host_digest"], strict=True))
    for h, p in zip(rows["host"], rows["path"], strict=True):
        lengths.setdefault(h, set()).add(len(p))
    hosts = list(lengths)
    order, host_arrays = Digests.of([h.encode() for h in hosts], unsigned([digest[h] for h in hosts]), bits)
    lists = [sorted(lengths[hosts[i]]) for i in order]
    ends = np.concatenate([np.zeros(1, np.uint64), np.cumsum([len(x) for x in lists], dtype=np.uint64)])
    flat = np.array([n for x in lists for n in x], np.uint64)
    words = "\n".join(names).encode()
    longest = max((len(h) for h in hosts), default=0)
    parts = [np.frombuffer(words, np.uint8), *key_arrays, verdicts, *host_arrays, ends, flat]
    out = [_HEAD.pack(_MAGIC, bits, len(keys), len(hosts), longest, len(words), len(parts)), np.array([p.nbytes for p in parts], np.uint64).tobytes()]
    for p in parts:
        out += [p.tobytes(), b"\0" * (-p.nbytes % 8)]
    return b"".join(out)


class RuleList:
    """A memory-mapped list."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        magic, bits, self.n_keys, n_hosts, self.longest, _, n_parts = _HEAD.unpack(raw[: _HEAD.size].tobytes())
        if magic != _MAGIC:
            raise ValueError(f"{path} isn't a list of url rules")
        sizes = raw[_HEAD.size : _HEAD.size + 8 * n_parts].view(np.uint64)
        at, parts = _HEAD.size + 8 * n_parts, []
        for n in map(int, sizes):
            parts.append(raw[at : at + n])
            at += n + -n % 8
        as_long = lambda i: parts[i].view(np.uint64)
        self.names = parts[0].tobytes().decode().split("\n")
        self.keys = Digests(as_long(1), as_long(2), parts[3], bits)
        self.verdicts = parts[4].view(np.uint32)
        self.hosts = Digests(as_long(5), as_long(6), parts[7], bits)
        self.length_ends, self.lengths = as_long(8), as_long(9)

    def ends_of(self, host: str) -> list[str]:
        """The host and its parent domains, as far as a rule can have them."""
        out, at = [], max(0, len(host) - self.longest)
        if not at:
            out.append(host)
        elif host[at - 1] != ".":
            at = host.find(".", at) + 1
            if not at:
                return out
        if at:
            out.append(host[at:])
        while (at := host.find(".", at) + 1) > 0:
            out.append(host[at:])
        return [x for x in out if x]

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str | None]]:
        """Rule and verdict of each url; None where none fits."""
        ends = [(h, e) for h in set(hosts) for e in self.ends_of(h)]
        known: dict[str, list[tuple[str, list[int]]]] = {}
        for (h, e), k in zip(ends, self.hosts.find([e.encode() for _, e in ends]).tolist(), strict=True):
            if k >= 0:
                known.setdefault(h, []).append((e, self.lengths[self.length_ends[k] : self.length_ends[k + 1]].tolist()))
        asked = sorted({(e, p[:n]) for h, p in set(zip(hosts, paths, strict=True)) for e, ns in known.get(h, ()) for n in ns if n <= len(p)})
        found = self.keys.find([(e + p).encode() for e, p in asked])
        fits = {a: k for a, k in zip(asked, found.tolist(), strict=True) if k >= 0}
        rules: list[str | None] = []
        verdicts: list[str | None] = []
        for h, p in zip(hosts, paths, strict=True):
            best = max(((len(e) + n, len(e), e + p[:n], fits[e, p[:n]]) for e, ns in known.get(h, ()) for n in ns if n <= len(p) and (e, p[:n]) in fits), default=None)
            rules.append(best and best[2])
            verdicts.append(best and self.names[self.verdicts[best[3]]])
        return rules, verdicts


_open: dict[str, RuleList] = {}


def rule_list(name: str) -> RuleList:
    """The list that this worker has mapped."""
    if name not in _open:
        _open.clear()
        _open[name] = RuleList(SparkFiles.get(name))
    return _open[name]


def shipped(spark: SparkSession, rules: DataFrame, bits: int = 64) -> str:
    """Write the list (checked to be small) and have executors fetch it; gives its name."""
    rows = rules.select("host", "path", "verdict", F.xxhash64("key").alias("key_digest"), F.xxhash64("host").alias("host_digest")).toArrow().to_pydict()
    name = f"url-rules-{uuid.uuid4().hex}"
    path = os.path.join(tempfile.mkdtemp(prefix="url-rules-"), name)
    with open(path, "wb") as f:
        f.write(packed(rows, bits))
    spark.sparkContext.addFile(path)  # the driver serves it, to executors that come later as well
    return name


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", list_bytes: int = LIST_BYTES, bits: int = 64) -> DataFrame:
    """pages with host, path, rule (host and path of the one that decides, or null) and verdict; rules: (host, path, verdict). `bits`: of the digests that are kept."""
    spark = pages.sparkSession
    p = with_host_and_path(pages.drop("rule", "verdict") if url not in ("rule", "verdict") else pages, url)
    rules = clean(rules)
    size = rules.agg(F.coalesce(F.sum(2 * F.octet_length("key") + F.octet_length("verdict") + 64), F.lit(0)).alias("n")).first()["n"]
    if size > list_bytes:
        return joined(p, rules, default)
    name = shipped(spark, rules, bits)

    @F.arrow_udf("rule string, verdict string")
    def probe(host, path):
        import pyarrow as pa

        r, v = rule_list(name).judge(host.to_pylist(), path.to_pylist())
        return pa.StructArray.from_arrays([pa.array(r, pa.string()), pa.array(v, pa.string())], names=["rule", "verdict"])

    d = p.withColumn("_found", probe("host", "path"))
    return d.withColumns({"rule": F.col("_found.rule"), "verdict": F.coalesce("_found.verdict", F.lit(default))}).drop("_found")


def joined(p: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same with a list of any length: distinct hosts, then their distinct paths, meet the rules by digest and string."""
    pairs = p.select(F.col("host").alias("_h"), F.col("path").alias("_p")).filter("host <> ''").distinct()
    most = rules.agg(F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(1)).alias("_labels"))  # one row
    ends = pairs.select("_h").distinct().join(F.broadcast(most)).withColumn("_w", F.split("_h", r"\."))
    ends = ends.select("_h", F.slice("_w", -F.least("_labels", F.size("_w")), F.col("_labels")).alias("_w"))  # a rule has no more labels
    ends = ends.select("_h", "_w", F.explode(F.sequence(F.lit(1), F.size("_w"))).alias("_i"))
    ends = ends.select("_h", F.array_join(F.slice("_w", F.col("_i"), F.size("_w")), ".").alias("_e")).filter("_e <> ''")
    lengths = rules.select(F.col("host").alias("_host"), F.length("path").alias("_n")).distinct()
    met = ends.join(lengths, (F.xxhash64("_e") == F.xxhash64("_host")) & (F.col("_e") == F.col("_host"))).select("_h", "_e", "_n")
    keys = pairs.join(met, "_h").filter("_n <= length(_p)").withColumn("_key", F.concat("_e", F.substring("_p", F.lit(1), F.col("_n"))))
    fits = keys.join(rules.select("key", "verdict"), (F.xxhash64("_key") == F.xxhash64("key")) & (F.col("_key") == F.col("key")))
    best = fits.groupBy("_h", "_p").agg(F.max(F.struct(F.length("key"), F.length("_e"), F.col("key").alias("rule"), "verdict")).alias("_found"))
    d = p.join(best, (p["host"] == best["_h"]) & (p["path"] == best["_p"]), "left")
    return d.withColumns({"rule": F.col("_found.rule"), "verdict": F.coalesce("_found.verdict", F.lit(default))}).drop("_found", "_h", "_p")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts, paths, verdicts = map(list, zip(*RULES, strict=True))
    rules = small_table(spark, {"host": hosts, "path": paths, "verdict": verdicts}, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


_LIST = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
SQL = f"""WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_LIST}),
u AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, n, translate(raw, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
f AS (SELECT p.*, rule_host || rule_path AS rule, rule_verdict, row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS k
  FROM p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM f WHERE k = 1"""
