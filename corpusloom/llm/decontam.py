"""Benchmark decontamination by template canonicalisation.

Numbers, units behind numbers and names (capitalised words that don't start a sentence) become typed slots, all
other words are lower-cased; punctuation is dropped. Windows of `WINDOW` template tokens of documents and
benchmark items are joined by their hash. Windows that lie on one diagonal (document position less
item position) are counted, and the slots' values must map one to one between item and document across them, so
a question with other numbers and names is caught, while a chance meeting of generic words around slots is not.

A document is contaminated by an item if `MIN_WINDOWS` windows of one diagonal match (13 words in
a row, or as many in pieces), or all windows of a shorter item.

Only DataFrame functions. Windows of documents are tested against a bit set of the benchmark's window
hashes inside each row, so only hits leave the row. The bit set and a broadcast of the benchmark's windows
are used up to `SMALL_BENCHMARK` windows. Beyond that the windows' hashes are broadcast, up to `BROADCAST_HASHES`, and only windows
with one of them are shuffled; beyond that, all windows.

Case doesn't decide: windows are hashed a second time with names as plain words. Each character of a script without
spaces is a word.

Null or empty text: no windows. Windows with fewer than `MIN_WORDS` words that aren't slots are left out of items that
have others. An item without any usable window is searched for as a whole by its template, or, with fewer than `MIN_WORDS`
words, by its words and values as they are (without a letter: by what white space parts), in windows of its own length up to WINDOW. Repeated documents or items: pairs of ids appear once,
with the best diagonal. Null doc_id: a pair with a null. Empty tables: no rows. Other columns pass through `decontaminate`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_or_shuffled, materialise, table

WINDOW, HALF = 8, 4
MIN_WORDS = 5
MIN_WINDOWS = 6
SMALL_BENCHMARK = 200_000
BROADCAST_HASHES = 5_000_000

# Unit names that count as a unit behind a number.
UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|miles?|ft|feet|inch|inches|l|ml|litres?|liters?|gallons?|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|dollars?|cents?|euros?|pounds?|usd|eur|percent|degrees?|mph|kmh"

OPEN, CLOSE = "\x01", "\x02"


# Scripts written without spaces; each of their characters is a word.
_UNSPACED = "".join(rf"\p{{Is{x}}}" for x in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan"))


#: Up to this character letters are those of `_LATIN`, none of them of an unspaced script, and there are no combining marks.
_BEYOND = r"[^\x00-\u024F]"
_LATIN = r"[A-Za-z\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]"


def tokens(text: Column) -> Column:
    """Words and slots of a text, in order; a slot is OPEN, its kind's letter, its value, CLOSE.

    Each pattern begins with a plain character, which is what a matcher finds fast.
    """
    t = F.translate(F.coalesce(text, F.lit("")), OPEN + CLOSE, "  ")
    t = F.regexp_replace(t, r"(\p{N}(?:[\p{N}.,]*\p{N})?)", f"{OPEN}n$1{CLOSE}")
    t = F.regexp_replace(t, rf"{CLOSE}(?:( ?)((?i:{UNITS}))(?!\p{{L}})|([%°€$]))", f"{CLOSE}$1{OPEN}u$2$3{CLOSE}")
    # Behind numbers and units, so that a word is a unit there in capitals too.
    t = F.regexp_replace(t, rf" (?<=[\p{{Ll}}\p{{N}},;{CLOSE}] )(\p{{Lu}}[\p{{L}}\p{{M}}]*)", f" {OPEN}p$1{CLOSE}")
    slot = f"{OPEN}[^{CLOSE}]*{CLOSE}"
    fast = F.regexp_extract_all(F.lower(t), F.lit(f"{_LATIN}+|{slot}"), F.lit(0))
    full = F.regexp_extract_all(F.lower(t), F.lit(rf"{slot}|[{_UNSPACED}]\p{{M}}*|[\p{{L}}\p{{M}}&&[^{_UNSPACED}]]+"), F.lit(0))
    return F.when(F.lower(t).rlike(_BEYOND), full).otherwise(fast)


def template(toks: Column) -> Column:
    return F.transform(toks, lambda x: F.when(x.startswith(OPEN), F.substring(x, 1, 2)).otherwise(x))


def _value(x: Column) -> Column:
    return F.when(x.startswith(OPEN), x.substr(F.lit(3), F.length(x) - 3)).otherwise(x)


def folded(toks: Column) -> Column:
    """The template with names as plain words: the same whatever case a text is in."""
    return F.transform(toks, lambda x: F.when(x.startswith(OPEN + "p"), _value(x)).when(x.startswith(OPEN), F.substring(x, 1, 2)).otherwise(x))


def values(toks: Column) -> Column:
    return F.transform(toks, _value)


def spaced(text: Column) -> Column:
    """Lower-cased words as white space parts them, for items without any letter."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")


def windows(key: str, size: int | Column = WINDOW, names_only: bool = False, begun=None) -> Column:
    """(pos, h) of each window, or of those with a name. key and key_h (its tokens' hashes) are columns of the frame, so that they are computed once.

    begun: tests hashes of HALF tokens. Every window of WINDOW tokens holds HALF that begin at a multiple of HALF, so
    only windows around those that pass are hashed.
    """
    # Of key_h, too: a column that is named once would be put in the place of its name, inside the loop over windows.
    n, size = F.size(f"{key}_h"), F.lit(size) if isinstance(size, int) else size
    fits, none = (n >= size) & (size > 0), F.array().cast("array<int>")
    hashed = lambda i, k: F.xxhash64(F.slice(f"{key}_h", i + 1, k))
    if names_only:
        names = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.get("temp", i) == OPEN + "p")
        near = F.transform(names, lambda i: F.sequence(F.greatest(i - size + 1, F.lit(0)), F.least(i, n - size)))
        places = F.when(fits, F.array_distinct(F.flatten(near))).otherwise(none)
    elif begun is not None:
        some = F.filter(F.sequence(F.lit(0), F.greatest(n - HALF, F.lit(0)), F.lit(HALF)), lambda i: begun(hashed(i, HALF)))
        near = F.transform(some, lambda i: F.sequence(F.least(F.greatest(i + HALF - size, F.lit(0)), n - size), F.least(i, n - size)))
        places = F.when(fits, F.array_distinct(F.flatten(near))).otherwise(none)
    else:
        places = F.when(fits, F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)))).otherwise(none)
    return F.transform(places, lambda i: F.struct(i.alias("pos"), hashed(i, size).alias("h")))


def exploded(d: DataFrame, hits: Column) -> DataFrame:
    """Rows of d for each of `hits`. The partition number, which no optimiser rule may move or copy,
    keeps the filter for empty arrays above the windows; below them they would be computed anew for every window."""
    d = d.withColumns({"hits": hits, "_at": F.spark_partition_id()}).filter((F.size("hits") > 0) & (F.col("_at") >= 0))
    return d.withColumn("w", F.explode("hits")).drop("hits", "_at")


def n_words(raw: Column) -> Column:
    return F.size(F.filter(raw, lambda x: ~x.startswith(OPEN)))


def wordy(raw: Column) -> Column:
    return n_words(raw) >= MIN_WORDS


def bit_test(hashes: list[int]):
    """Tests whether a hash has its bit in a set of 16 bits or more for each of the hashes, which is a literal of the plan."""
    bits = 1 << max(10, (16 * len(hashes)).bit_length())
    words = np.zeros(bits // 64, np.uint64)
    h = np.array(hashes, np.int64).view(np.uint64) & np.uint64(bits - 1)
    np.bitwise_or.at(words, (h >> np.uint64(6)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
    stored = F.lit(words.view(np.int64))

    def test(h: Column) -> Column:
        low = h.bitwiseAND(F.lit(bits - 1))
        word = F.element_at(stored, (F.call_function("shiftright", low, F.lit(6)) + 1).cast("int"))
        return F.expr("1L") == F.call_function("shiftright", word, low.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long"))

    return test


def keyed(d: DataFrame, id_col: str) -> DataFrame:
    """The columns whose windows are hashed."""
    d = d.select(F.col(id_col).cast("long").alias(id_col), F.col("text").cast("string").alias("text")).withColumn("toks", tokens(F.col("text")))
    d = d.withColumns({"temp": template(F.col("toks")), "fold": folded(F.col("toks")), "val": values(F.col("toks")), "spa": spaced(F.col("text"))})
    return d.withColumns({f"{c}_h": F.transform(c, lambda x: F.xxhash64(x)) for c in ("temp", "fold", "val", "spa")})


def raw_of(kind: str) -> str:
    return {"t": "toks", "v": "val", "s": "spa"}[kind]


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, item_pos, kind, len, h, item_raw. Kinds: t (template), v (words and values as they are), s (parted by white space)."""
    items = keyed(benchmark, "item_id")
    usable = F.exists(F.transform(windows("temp"), lambda w: F.slice("toks", w["pos"] + 1, WINDOW)), wordy)
    least = lambda c: F.least(F.size(c), F.lit(WINDOW))
    items = items.withColumns({"usable": usable, "words": n_words(F.col("toks"))})
    kind = F.when(F.col("usable") | (F.col("words") >= MIN_WORDS), "t").when(F.col("words") > 0, "v").otherwise("s")
    size = F.when(F.col("usable"), WINDOW).when(F.col("words") >= MIN_WORDS, F.size("toks")).when(F.col("words") > 0, least("val")).otherwise(least("spa"))
    items = items.withColumns({"kind": kind, "len": size})
    out = None
    for k, keys in (("t", ("temp", "fold")), ("v", ("val",)), ("s", ("spa",))):
        own = items.filter(F.col("kind") == k)
        w = exploded(own, F.concat(*[windows(c, F.col("len")) for c in keys]))
        halves = F.array(*[F.xxhash64(F.slice(f"{c}_h", F.col("w.pos") + i + 1, HALF)) for c in keys for i in range(WINDOW - HALF + 1)])
        w = w.select("item_id", F.col("w.pos").alias("item_pos"), "kind", "len", F.col("w.h").alias("h"), F.when(F.col("len") == WINDOW, halves).alias("halves"), F.slice(raw_of(k), F.col("w.pos") + 1, F.col("len")).alias("item_raw"))
        w = w.filter(wordy(F.col("item_raw"))) if k == "t" else w
        out = w if out is None else out.unionByName(w)
    return out.dropDuplicates(["item_id", "item_pos", "kind", "len", "h"])


def matches(docs: DataFrame, benchmark: DataFrame, small: int = SMALL_BENCHMARK) -> DataFrame:
    """Contaminated pairs: doc_id, item_id, n_windows (on the best diagonal), item_windows, doc_pos (word at which it starts)."""
    own = materialise(item_windows(benchmark), "item-windows")
    sample = [r["h"] for r in own.select("h").limit(small + 1).collect()]
    few = len(sample) <= small
    shapes = sorted((r["kind"], r["len"]) for r in own.select("kind", "len").distinct().collect()) or [("t", WINDOW)]
    met = begun = None
    if few:
        met = bit_test(sample)
        begun = bit_test([r[0] for r in own.select(F.explode("halves")).distinct().collect()])
    own = own.drop("halves")

    def found(key, kind, size):
        # Without names, a window has one template in either case.
        w = windows(key, size, key == "fold", begun if size == WINDOW else None)
        w = F.filter(w, lambda x: met(x["h"])) if few else w
        return F.transform(w, lambda x: F.struct(x["pos"].alias("pos"), x["h"].alias("h"), F.lit(kind).alias("kind"), F.lit(size).alias("len")))

    hits = [found(key, k, n) for k, n in shapes for key in ({"t": ("temp", "fold")}.get(k) or (raw_of(k),))]
    hit = exploded(keyed(docs, "doc_id"), F.concat(*hits))
    raw = F.coalesce(*[F.when(F.col("w.kind") == k, F.slice(raw_of(k), F.col("w.pos") + 1, F.col("w.len"))) for k in sorted({k for k, _ in shapes})])
    hit = hit.select("doc_id", F.col("w.pos").alias("pos"), F.col("w.h").alias("h"), F.col("w.kind").alias("kind"), F.col("w.len").alias("len"), raw.alias("raw"))
    if not few:  # rows whose window no item has go before any shuffle, as long as the hashes can be broadcast
        hashes = materialise(own.select("h").distinct(), "item-hashes")
        if hashes.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES:
            hit = hit.join(F.broadcast(hashes), "h", "left_semi")
    pairs = hit.join(F.broadcast(own) if few else own, ["h", "kind", "len"])
    same = lambda f: f(F.col("raw")) == f(F.col("item_raw"))
    slots = F.filter(F.arrays_zip("raw", "item_raw"), lambda p: p["raw"].startswith(OPEN))
    plain = F.filter(slots, lambda p: ~p["raw"].startswith(OPEN + "p"))
    pairs = pairs.filter(same(template) | same(folded)).select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"), "pos", F.when(same(template), slots).otherwise(plain).alias("slots"))
    lines = pairs.groupBy("doc_id", "item_id", "shift").agg(F.count_distinct("pos").alias("n_windows"), F.min("pos").alias("doc_pos"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    size = F.size("slots")
    consistent = (F.size(F.array_distinct("slots.raw")) == size) & (F.size(F.array_distinct("slots.item_raw")) == size)
    totals = own.groupBy("item_id").agg(F.count_distinct("item_pos").alias("item_windows"))
    best = lines.filter(consistent).groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", -F.col("doc_pos"))).alias("b")).select("doc_id", "item_id", F.col("b.n_windows").alias("n_windows"), (-F.col("b.col2")).alias("doc_pos"))
    return best.join(F.broadcast(totals) if few else totals, "item_id").filter(F.col("n_windows") >= F.least(F.lit(MIN_WINDOWS), "item_windows")).select("doc_id", "item_id", "n_windows", "item_windows", "doc_pos")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones. Rows without a doc_id stay."""
    bad = matches(docs, benchmark).select("doc_id").filter(F.col("doc_id").isNotNull()).distinct().withColumnRenamed("doc_id", "_bad")
    bad = few_or_shuffled(materialise(bad, "contaminated"))
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti")


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
