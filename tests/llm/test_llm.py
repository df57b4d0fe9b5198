"""The training-data operators against brute force on small tables with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chat, decontam, fingerprint, jaccard, langid, line_dedup, packing, rans, sharding, warc
from corpusloom.llm.tokens import default_path, encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, token string, part string"


def words(rnd, n):
    return " ".join("".join(rnd.choice(["tha", "ne", "rou", "si", "ke", "lo", "mi"]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    base = words(rnd, 120)
    near = [" ".join(w if rnd.random() > 0.004 else "zz" for w in base.split()) for _ in range(40)]
    line = "A line that is repeated everywhere in here"
    out = [None, "", " ", "\n\n", "one", "one", "two words", base, base, base + " end", *near, "é ü ß", "日本語 の テスト", "x " * 30000, "tab\tand  two spaces\r\nend "]
    out += [f"{words(rnd, 30)}\n{line} \n{words(rnd, 25)}" for _ in range(5)] + [f"\t{line.upper()}\n{words(rnd, 5)}"]
    out += [words(rnd, rnd.randint(1, 200)) for _ in range(40)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", "b", None][i % 4], None, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup(docs, texts, empty):
    def key(x):
        return re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for i, t in enumerate(texts):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                holders.setdefault(k, []).append(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    # both ways to hand out the repeats; a filter of the size the lines ask for, a small one and one that is full
    for limit, bits in ((250_000, None), (0, 1 << 16), (0, 512)):
        got = {r.doc_id: r for r in line_dedup.dedup_lines(docs.withColumns({"drop": F.lit(1), "id": F.lit("i"), "rest": F.lit("r")}), bits=bits, broadcast_keys=limit).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            lines = (t or "").split("\n")
            kept = "\n".join(x for x in lines if gone.get(key(x), i) == i)
            assert (got[i].text, got[i].n_lines) == (kept, len(lines)), i
            assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest() and (got[i].token, got[i].drop, got[i].id, got[i].rest) == ("y", 1, "i", "r")
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_of_repeated_ids(spark):
    """Equal and null doc_ids with other texts: each row loses its own lines; the largest id keeps them."""
    a, b = "a line that is long enough to be a key", "another line that is long enough as well"
    rows = [(1, f"{a}\nx"), (1, f"{b}\ny"), (None, a), (None, f"{b}\n{a}"), (None, f"{b}\n{a}"), (2, f"{a}\n{b}"), (2, f"{a}\n{b}")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (100, 0):
        got = Counter((r.doc_id, r.text, r.n_dropped) for r in line_dedup.dedup_lines(d, broadcast_keys=limit).collect())
        assert got == Counter([(1, "x", 1), (1, "y", 1), (None, "", 1), (None, "", 2), (None, "", 2), (2, rows[-1][1], 0), (2, rows[-1][1], 0)]), limit


def check_pieces(rows, ids_of, sequence):
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for d, ids in ids_of.items():
        at = 0
        for r in sorted(by[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4"))
            at += r.length
        assert at == len(ids)
    at = 0
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert (r.sequence_id, r.offset) == divmod(at, sequence)
        at += r.length


def test_packing(docs, texts, empty):
    path = default_path("byte_bpe_50k.json")
    enc = encoder(path).tokenizer
    ids = {i: [*enc.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    rows = packing.pack(docs, path, window_tokens=512, sequence_tokens=64).collect()
    check_pieces(rows, ids, 64)
    # every stretch of whole windows has the sources' shares, within what rounding and the windows' ends allow
    total = sum(map(len, ids.values()))
    share = Counter()
    for r in rows:
        share[r.queue] += r.length
    half = [r for r in rows if r.sequence_id < total // 64 // 2]
    for q, n in share.items():
        got = sum(r.length for r in half if r.queue == q)
        assert abs(got - n / total * sum(r.length for r in half)) <= 512
    check_pieces(packing.pack(docs, path, window_tokens=256, sequence_tokens=64, weights={"a": 3.0, "b": 1.0}, least_quantum=1).collect(), ids, 64)
    assert packing.pack(empty, path).count() == 0


def test_packing_of_many_sources(spark):
    """Every source is a queue of its own with its own weight, null beside empty, however many there are."""
    path = default_path("byte_bpe_50k.json")
    rows = [(i, "some words in here", [None, "", *(f"s{k}" for k in range(1500))][i % 1502]) for i in range(3004)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(d, path, least_quantum=4).collect()
    assert len({r.queue for r in got}) == 1502 and sum(r.length for r in got) == 5 * 3004
    few = packing.pack(d.filter("coalesce(source, '') IN ('', 's7')"), path, weights={None: 4.0, "": 1.0}, window_tokens=5, sequence_tokens=5, least_quantum=1)
    assert [r.queue for r in few.orderBy("sequence_id", "offset").collect() if r.sequence_id == 0].count(0) >= 1
    assert few.filter("queue = 2").agg({"sequence_id": "min"}).first()[0] == 4  # what has no weight comes last


def test_chunks_of_tokenizers(texts):
    for name, lower in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        enc = encoder(default_path(name), lower)
        odd = ["don't I'LL 's", "...a ,b. 3.14, x", "a|b © ® x", "<|endoftext|> hi", "x\n y", "ﬁ İ a b"]
        assert_ids(enc, [*texts, *odd])
        rnd = random.Random(3)
        parts = ["don't", "'s", "'", "''", "we'll", "it's-", " ", "  ", "\n", "\n\n", "\t", "\r\n", ".", ",", "...", "$5", "3.14", "a1b2", "Ünï", "é", "×", "Œ", "Ž", "x" * 70, "!?", "|", "_", "<|", "\u00a0", "\x07", "İ", "the", "of"]
        assert_ids(enc, ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(3000)])
        assert_ids(enc, [" ".join(rnd.choice(parts[:22]) for _ in range(9)) for _ in range(500)])


def assert_ids(enc, texts):
    """The ids of a whole column are the plain library's, with an end id and without, and again when all chunks are known."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_path("word_bpe_49k.json" if enc.lower_words else "byte_bpe_50k.json"))
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    for end in (None, 7, None):
        ids, sizes = enc.encode(pa.array(texts, pa.string()).slice(1, len(texts) - 1), end)
        at = 0
        for t, w, n in zip(texts[1:], want[1:], sizes.tolist(), strict=True):
            assert ids[at : at + n].tolist() == w + ([] if end is None else [end]), t
            at += n


def test_cache_of_chunks(monkeypatch):
    """What a worker forgets is asked for again."""
    from corpusloom.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 20)
    enc = tokens.ChunkEncoder(default_path("byte_bpe_50k.json"), False)
    rnd = random.Random(4)
    for _ in range(5):
        assert_ids(enc, [words(rnd, 40) for _ in range(4)])
        assert len(enc.chunks) <= 20


def test_added_tokens_as_the_library_has_them(spark, tmp_path):
    """Ids are those of the plain library with the given file, also where a text holds an added token's string."""
    from tokenizers import Tokenizer

    for name, lower in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        plain, enc = Tokenizer.from_file(default_path(name)), encoder(default_path(name), lower)
        added = [a.content for a in plain.get_added_tokens_decoder().values()]
        assert added
        said = [f(a) for a in added for f in (str, str.upper, lambda a: f"hi {a} there", lambda a: f"hi{a}.\nthere, {a}{a} ", lambda a: a[:-1], lambda a: f"{a[:4]} {a[4:]}")]
        assert_ids(enc, said)
    d = spark.createDataFrame([(1, "hi <|endoftext|> there", "a"), (2, "next", "a")], "doc_id long, text string, source string")
    assert packing.pack(d, default_path("byte_bpe_50k.json")).filter("doc_id = 1").first().doc_tokens == 5
    rans.write_ids(d, default_path("word_bpe_49k.json"), str(tmp_path / "ids"))
    assert rans.read_ids(spark, str(tmp_path / "ids")).filter("doc_id = 2").first().start == 4


def test_fingerprint(docs, texts, empty):
    got = {r.doc_id: r for r in fingerprint.fingerprint(docs).collect()}
    plain = [t or "" for t in texts]

    def pieces(x):
        return {p[i : i + k] for p in x.split("\n") for k in [32 if len(p) >= 128 else 8] for i in range(0, len(p), k)}

    def dice(a, b):
        return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0

    for i, t in enumerate(plain):
        n = plain[(i + 1) % len(plain)]
        k = len(t) // 4
        e = t[: len(t) - k] + n[:k]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert r.near_edited == pytest.approx(dice(pieces(t), pieces(e))) and r.near_next == pytest.approx(dice(pieces(t), pieces(n)))
    for i in range(len(plain)):
        for j in range(i):
            assert (got[i].fingerprint == got[j].fingerprint) == (plain[i] == plain[j])
    assert fingerprint.fingerprint(empty).count() == 0
    assert fingerprint.fingerprint(docs.filter("doc_id = 7")).first().near_next == 1.0


def test_langid(spark, empty):
    rnd = random.Random(5)
    kinds = {"aa": ["ba", "na", "ta"], "bb": ["zor", "krix", "vul"]}
    rows = []
    for i in range(200):
        k = ["aa", "bb"][i % 2]
        rows.append((i, " ".join(rnd.choice(kinds[k]) for _ in range(30)), k))
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 456 !", "aa"), (1003, "ba na ta ba na", None), (None, "zor vul", "bb")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = {r.doc_id: r for r in langid.identify(d, langid.prototypes(d)).collect()}
    out = [i for i in range(200) if langid.crc32_mod4(i) == 2]
    assert out and all(got[i].lang_pred == rows[i][2] for i in out)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(d, langid.prototypes(empty)).filter("lang_pred <> 'und'").count() == 0
    assert langid.keep_known(d, langid.prototypes(d), 0.05).count() == 202


def plain_langid(rows):
    """By hand: letters' vectors multiplied after permutation, added up, cosines with the prototypes."""
    def letter(c):
        return (np.random.default_rng([langid.SEED, ord(c) if c != "#" else 0]).integers(0, 2, langid.DIMENSIONS, np.int8) * 2 - 1).astype(float)

    def vector(t):
        s = re.sub("#+", "#", "#" + "".join(c if c.isalpha() else "#" for c in (t or "").lower()) + "#")
        v = np.zeros(langid.DIMENSIONS)
        for g, n in Counter(zip(s, s[1:], s[2:], strict=False)).items():
            v += n * np.roll(letter(g[0]), 2) * np.roll(letter(g[1]), 1) * letter(g[2])
        return v if s != "#" else None

    sums = {}
    for d, t, g in rows:
        if g is not None and (v := vector(t)) is not None and (d is None or zlib.crc32(str(d).encode()) % 4 != 2):
            sums[g] = sums.get(g, 0) + v / (len(re.sub("#+", "#", "#" + "".join(c if c.isalpha() else "#" for c in t.lower()) + "#")) - 2)
    protos = {g: v / np.linalg.norm(v) for g, v in sums.items()}
    for d, t, _ in rows:
        v = vector(t)
        cos = {g: float(v @ p / np.linalg.norm(v)) for g, p in sorted(protos.items())} if v is not None else {}
        yield d, max(cos, key=cos.get) if cos else "und", max(cos.values(), default=0.0)


def test_langid_by_brute_force(spark):
    """Four alphabets, one very long text, nulls, ties and repeated rows against a plain computation."""
    rnd = random.Random(6)
    kinds = {"en": "the of and ship sail", "ru": "мать и дитя шли домой", "el": "και το νερό ήταν", "zh": "水在 河里 流 着 很 快"}
    rows = [(i, " ".join(rnd.choice(kinds[k].split()) for _ in range(rnd.randint(1, 12))), k) for i, k in enumerate(list(kinds) * 12)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "12 !", "ru"), (103, "Und so ein Wort, NUR EINES", None), (None, "the ship", "en"), (104, "the sail of " * 20000, "en"), (5, rows[5][1], "ru"), (5, rows[5][1], "ru")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, hash string").repartition(3)
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 3)) for r in langid.identify(d, langid.prototypes(d)).collect())
    want = [(a, b, min(1.0, max(0.0, c))) for a, b, c in plain_langid(rows)]
    assert sum(got.values()) == len(want)
    for a, b, c in want:
        assert any(x == a and y == b and abs(z - c) < 2e-3 for x, y, z in got), (a, b, c)
    kept = langid.keep_known(d, langid.prototypes(d), 0.3)
    assert kept.columns == d.columns and Counter(r.doc_id for r in kept.collect()) == Counter(a for a, b, c in want if b != "und" and c >= 0.3)
    assert langid.keep_known(d, langid.prototypes(d.filter("false")), 0.3).count() == len(rows) - 3
    many = spark.createDataFrame([(i, f"wort{chr(0x4E00 + i)}", f"l{i}") for i in range(1100)], "doc_id long, text string, lang string")
    assert len(langid.prototypes(many)[0]) > 800  # no limit on languages


def test_chat(spark):
    mark = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "system", "s"), (1, 1, "user", mark), (1, 2, "assistant", mark + "\\"), (1, 3, "user", None), (1, 4, "assistant", "a\\n<|b"), (1, 5, "user", "tail"), (2, 0, "user", "only"), (3, 0, "assistant", ""), (None, 0, "user", "n"), (4, 0, None, "x"), (4, 1, "a\nb<|", "y"), (4, 1, "assistant", "tie"), (5, 0, "assistant", "dup"), (5, 0, "assistant", "dup")]
    d = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn int, role string, text string, example string").repartition(3)
    for inline in (100_000, 10):
        f = chat.format_examples(d, inline)
        for got in (chat.read_back(f, ordered=True), chat.read_back(f.repartition(4))):
            by = {r.conv_id: r for r in got.collect()}
            for c in {r[0] for r in rows}:
                own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c))
                said = "".join(f"{a}\n{t}\n" for _, a, t in own)
                loss = "".join(t for _, a, t in own if a == "assistant")
                assert by[c].n_turns == len(own) and by[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
                assert by[c].loss_chars == len(loss) and by[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    one = chat.format_examples(d).filter("conv_id = 1").orderBy("prefix_chars").collect()
    assert [r.example for r in one] == [0, 1, None]
    assert one[1].context == one[0].context + one[0].reply + one[1].added and "assistant ok" in one[1].context
    assert chat.format_examples(d.filter("false")).count() == 0


def test_chat_examples_are_whole(spark, monkeypatch):
    """Each example has all turns before it as context, however long; turns without a reply are cut into bounded rows."""
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t} " * 20) for t in range(10)] + [(2, t, "user", "never answered " * 10) for t in range(30)] + [(2, 30, "assistant", "now")]
    d = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    for inline, pending in ((100_000, 1_000_000), (50, 500)):
        monkeypatch.setattr(chat, "PENDING_CHARS", pending)
        f = chat.format_examples(d, inline)
        got = {(r.conv_id, r.example): r for r in chat.examples(f).collect()}
        assert sorted(got) == [*((1, i) for i in range(5)), (2, 0)]
        for (c, n), r in got.items():
            before = [x for x in rows if x[0] == c][: 2 * n + 1 if c == 1 else 30]
            assert r.context == "".join(f"<|im_start|>{x[2]}\n{x[3]}<|im_end|>\n" for x in before) + "<|im_start|>assistant\n"
        assert {r.conv_id: r.n_turns for r in chat.read_back(f).collect()} == {1: 10, 2: 31}
        assert max(len(r.added) for r in f.collect()) < (1_000_000 if pending > 500 else 1000)


def test_decontamination(spark, docs, empty):
    items = [(1, "Tom Miller has 12 kg of apples and sells 5 kg of them at the old market near the river today"), (2, "the quick brown fox jumps over the lazy dog and runs far away from here again"), (3, "too short"), (4, None)]
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        (1, "Intro words. " + items[1][1] + " And more."),
        (2, "Before it all, Ann Baker has 30 kg of apples and sells 7 kg of them at the old market near the river today"),
        (3, "we saw that Ann Baker has 30 kg of apples and sells 30 kg of them at the old market near the river today"),  # one value for two slots
        (4, "the quick brown fox jumps over something else entirely"),
        (5, None), (6, ""), (7, items[1][1].upper()),
    ]
    d = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, item_id string")
    for small in (200_000, 0):
        got = {(r.doc_id, r.item_id): r for r in decontam.matches(d, b, small).collect()}
        assert {(1, 2), (2, 1)} <= set(got) and (4, 2) not in got
        assert got[1, 2].n_windows == got[1, 2].item_windows
        assert (3, 1) not in got or got[3, 1].n_windows < got[2, 1].n_windows
    assert {r.doc_id for r in decontam.decontaminate(d, b).collect()} >= {4, 5, 6}
    assert decontam.matches(docs, b).count() == 0 and decontam.matches(empty, b).count() == 0 and decontam.matches(d, b.filter("false")).count() == 0


def test_decontamination_of_odd_items(spark):
    """Short, number-heavy, wordless and unspaced items, and copies in another case, are found, with a bit set and without."""
    items = [
        (1, "What is the capital of France?"), (2, "2 + 2 = 5"), (3, "too short"), (4, "解释什么是量子纠缠以及它为什么重要"), (5, "?! ++"),
        (6, "Add 3 4 5 6 to 7 8 9 10 then divide by 11 12 13 14 and print 15 16 17 18"),
        (7, "we saw how Tom Miller gave 5 Miles of rope to his sister in Paris, and Ann Baker sold all of it on Monday to Bob"),
    ]
    b = spark.createDataFrame(items, "item_id long, text string")
    said = [f"so then , {t} , and so on" for _, t in items] + [f"so then , {t.upper()} , and so on" for _, t in items] + [f"SO THEN , {t.lower()} , AND" for _, t in items]
    said[3] = "他说解释什么是量子纠缠以及它为什么重要吗"
    rest = [(100, "nothing of it is here at all, 2 + 3 = 5"), (101, "Add 3 4 5 6 to other things"), (102, None), (103, "is that short or what")]
    d = spark.createDataFrame([*enumerate(said), *rest], "doc_id long, text string").repartition(3)
    for small in (200_000, 0):
        got = {(r.doc_id, r.item_id) for r in decontam.matches(d, b, small).collect()}
        assert got == {(i, items[i % 7][0]) for i in range(len(said))}, small
    old = spark.createDataFrame([(2, "the quick brown fox jumps over the lazy dog and runs far away from here again")], "item_id long, text string")
    up = spark.createDataFrame([(7, "THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG AND RUNS FAR AWAY FROM HERE AGAIN")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.matches(up, old).collect()] == [(7, 2)]


def test_warc(spark):
    rows = [(i, f"http://x/{i}", "<p>" + "y" * (i % 7) + "</p>") for i in range(300)] + [(300, None, None), (None, "u", "é"), (5, "http://x/5", "<p>yyyyy</p>")]
    p = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, node int").repartition(4)
    hurt = p.withColumn("html", F.when(F.col("page_id").isin(17, 250), F.translate("html", "y", "z")).otherwise(F.col("html")))
    got = warc.scan(p, hurt, 4).collect()
    assert len(got) == len(rows) and sorted(r.page_id for r in got if r.status != "ok") == [17, 250] and {r.status for r in got} == {"ok", "corrupt"}
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at = r.end
    a, b = (warc.leaves(warc.replica(x)) for x in (p, hurt))
    k = warc.depth_of(a, b, fan=4)
    a, b = warc.tree(a, 4, k), warc.tree(b, 4, k)
    seen, bad = warc.audit(a, b, k, 4)
    assert sorted(r.node for r in bad.collect()) == [17 // 4, 250 // 4]
    assert seen.count() <= 2 * 4 * (k + 1) + 1  # two branches, not the whole tree
    assert warc.audit(a, a, k, 4)[0].count() == 1
    assert warc.scan(p.filter("false"), p.filter("false")).count() == 0


def test_warc_lost_added_and_swapped_records(spark):
    """Exactly the records that a copy lacks, has more of, or has with other bytes, wherever they stand."""
    rows = [(i * 3 - 60, f"http://x/{i}", f"<p>{i}</p>" * (i % 5 + 1)) for i in range(300)] + [(None, "n", "one"), (None, "n", "two"), (9, "http://x/23", "again")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)

    def found(copy):
        return sorted((str(r.page_id), r.status) for r in warc.scan(p, copy, 4).collect() if r.status != "ok")

    assert found(p.filter("page_id <> 15 OR page_id IS NULL")) == [("15", "missing")]
    assert found(p.filter("html <> 'two'")) == [("None", "missing")]
    extra = spark.createDataFrame([(16, "http://new", "new"), (9, "http://x/23", "again")], p.schema)
    assert found(p.unionByName(extra)) == [("16", "extra"), ("9", "extra")]
    swapped = p.withColumn("html", F.when(F.col("page_id") == 30, "<p>31</p><p>31</p>").when(F.col("page_id") == 33, "<p>30</p>").otherwise(F.col("html")))
    assert found(swapped) == [("30", "corrupt"), ("33", "corrupt")]
    assert len(found(p.filter("false"))) == len(rows) and {s for _, s in found(p.filter("false"))} == {"missing"}


def components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= 75 * len(a | sets[j]):
                p, q = sorted((find(i), find(j)))
                top[q] = p
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("small,block,bits", [(16, 128, 1 << 20), (1, 8, 1 << 20), (2, 4, 1 << 12)])
def test_jaccard(docs, texts, monkeypatch, small, block, bits):
    monkeypatch.setattr(jaccard, "SMALL_BUCKET", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, filter_bits=bits, frequent=1 << 10).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts)


def test_jaccard_empty(empty, spark):
    assert jaccard.near_duplicates(empty, 1 << 16, 64).count() == 0
    d = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert sorted((r.component_id for r in jaccard.near_duplicates(d, 1 << 16, 64).collect())) == [2, 3, 3, 3]


def test_rans_round_trip():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 5, 1024, 5000):
        ids = rnd.zipf(1.3, n) % 5000
        counts = np.bincount(ids, minlength=5000)
        t = rans.Table.of(counts)
        assert n == 0 or int(t.freq.sum()) == 1 << rans.PRECISION
        raw = rans.encode_block(ids, [7, None], [n, 0], t, lanes=16, every=4)
        x, docs, sizes = rans.decode_block(raw, t, t.symbols())
        assert x.tolist() == ids.tolist() and docs == [7, None] and sizes == [n, 0]
        for mark in range(max(0, -(-n // 64))):
            part, _, _ = rans.decode_block(raw, t, t.symbols(), mark, 1)
            assert part.tolist() == ids[mark * 64 : (mark + 1) * 64].tolist()
        if n:
            with pytest.raises(ValueError):
                rans.decode_block(raw[:-1] + bytes([raw[-1] ^ 1]), t, t.symbols())


def test_rans_files(spark, docs, texts, empty, tmp_path):
    path = default_path("word_bpe_49k.json")
    enc = encoder(path, True).tokenizer
    for k, d in enumerate((docs, docs.repartition(1).sortWithinPartitions("doc_id"))):
        rans.write_ids(d, path, str(tmp_path / f"ids{k}"))
        meta = spark.read.parquet(str(tmp_path / f"ids{k}/meta")).first()
        assert (meta.tokenizer, meta.end_id) == ("word_bpe_49k.json", 1)
        got = rans.read_ids(spark, str(tmp_path / f"ids{k}")).orderBy("doc_id").collect()
        at = 0
        for r, text in zip(got, texts, strict=True):
            ids = [*enc.encode(text or "", add_special_tokens=False).ids, 1]
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4")))
            at += len(ids)
    rans.write_ids(empty, path, str(tmp_path / "none"))
    assert rans.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_rans_of_a_large_vocabulary():
    ids = np.array([70_000, 5, 70_000, 1 << 17], np.uint32)
    t = rans.Table.of(np.bincount(ids, minlength=(1 << 17) + 1))
    x, _, _ = rans.decode_block(rans.encode_block(ids.astype(np.int64), [1], [4], t, lanes=2, every=1), t, t.symbols())
    assert x.tolist() == ids.tolist()


def best_capacity(sizes, shards):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        k, f = 1, 0
        for s in sizes:
            if f + s > mid:
                k, f = k + 1, 0
            f += s
        lo, hi = (lo, mid) if k <= shards else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("bins", [8192, 16])
def test_sharding(docs, texts, empty, bins):
    got = sharding.shard(docs, 6, bins).collect()
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t, []).append(i)
    size = lambda t: len((t or "").encode()) + 8
    sizes = [size(t) * len(v) for t, v in sorted(groups.items(), key=lambda x: x[1][0])]
    by = {r.doc_id: r for r in got}
    assert len(by) == len(texts) and all(by[i].size == size(t) and by[i].text_crc32 == zlib.crc32((t or "").encode()) for i, t in enumerate(texts))
    assert all(len({by[i].shard for i in v}) == 1 for v in groups.values())
    total = Counter()
    for r in got:
        total[r.shard] += r.size
    assert max(total.values()) == best_capacity(sizes, 6)
    for s in total:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard(empty, 6).count() == 0


def test_pipeline(spark, docs, texts, tmp_path):
    """Every stage against a plain one on its own input, with nulls, empty and long texts, ties, copies and clashing names; then an empty table."""
    import corpus_pipeline as p

    def key(x):
        return re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))

    clash = {c: F.lit("c") for c in ("_gone", "_bad", "id", "hash", "component_id", "drop", "rest")}
    docs.drop("n_lines", "token", "part").withColumns(clash).write.parquet(str(tmp_path / "documents.parquet"))
    passage = " ".join(max(texts[-40:], key=lambda t: len(t or "")).split()[10:45])
    items = [(1, "nothing in here is in any of the documents at all my friend"), (2, passage), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in p.STAGES] == ["language", "lines", "near", "benchmark", "packing"]
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    first, now = d, {r.doc_id: r.text for r in d.collect()}
    langs = {r.doc_id: r.lang for r in d.collect()}
    for n, f in p.STAGES:
        out = f(spark, d, str(tmp_path))
        if n == "packing":
            enc = encoder(default_path("byte_bpe_50k.json")).tokenizer
            check_pieces(out.collect(), {i: [*enc.encode(t or "", add_special_tokens=False).ids, 0] for i, t in now.items()}, packing.SEQUENCE_TOKENS)
            break
        out.write.parquet(str(tmp_path / n))
        d = spark.read.parquet(str(tmp_path / n))
        assert d.columns == first.columns
        if n == "language":
            keep = {i for i, g, c in plain_langid([(i, t, langs[i]) for i, t in now.items()]) if g != "und" and c >= p.MIN_LANGUAGE_SCORE}
            want = {i: t for i, t in now.items() if i in keep}
        elif n == "lines":
            holders = {}
            for i, t in now.items():
                for k in {key(x) for x in (t or "").split("\n")}:
                    holders.setdefault(k, []).append(i)
            gone = {k: max(v) for k, v in holders.items() if len(v) >= 3 and len(k) >= 20}
            want = {i: "\n".join(x for x in (t or "").split("\n") if gone.get(key(x), i) == i) for i, t in now.items()}
            assert want != now and all(r.n_chars == len(r.text) for r in d.collect())
        elif n == "near":
            ids = sorted(now)
            want = {i: now[i] for k, (i, (_, c)) in enumerate(zip(ids, components([now[i] for i in ids]), strict=True)) if c == k}
        else:
            want = {i: t for i, t in now.items() if passage not in t}
        assert len(want) < len(now) or n == "lines"
        assert {r.doc_id: r.text for r in d.collect()} == want, n
        now = want
    for n, f in p.STAGES:
        assert f(spark, first.filter("false"), str(tmp_path)).count() == 0, n
