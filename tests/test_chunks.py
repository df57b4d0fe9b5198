"""The chunk folds against plain rules, one text at a time: odd white space, empty and long texts, tables, the routed job."""

import hashlib
import random

import plain_chunks as plain
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking, folds

SPACES = [" "] * 30 + ["  ", "\n", "\n\n", "\n \n", "\t", " ", " ", "\x1f", "　", "\r\n"]


def prose(rnd, n):
    word = lambda: rnd.choice(["alpha", "Beta", "gamma.", "Delta!", "x", "Ü?", '"Quote', "a|b", "9.", "word" * 5, "日本語"])
    return "".join(word() + rnd.choice(SPACES) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(8)
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | some words {i} |" for i in range(200))
    out = [None, "", " ", "\n\n", "one", " ", "y" * 9000, "word " * 1500, "tab\tbed\t" * 700, "No end. " * 900, f"Start.\n{table}\nmid\n| lone |\n\n{table}", "|", "| a |\n|  |\nx"]
    return out + [prose(rnd, rnd.choice([5, 60, 400, 2500])) for _ in range(40)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n string").repartition(3)


def kept(chunks, least=50):
    return [c for c in chunks if c.strip() and plain.tokens(c) >= max(least, 1)]


RULES = {
    "sentence": (chunking.sentence, plain.by_sentence), "recursive": (chunking.recursive, plain.recursive), "semantic": (chunking.semantic, plain.semantic),
}


@pytest.mark.parametrize("rule", RULES)
@pytest.mark.parametrize("size, overlap, least", [(512, 50, 50), (40, 12, 1), (30, 0, 0)])
def test_rules(docs, texts, rule, size, overlap, least):
    split, by = RULES[rule]
    df = split(docs, size, overlap, least)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString() and "Arrow" not in df._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.doc_id, r.chunk_index, r.text, r.token_count) for r in df.collect())
    assert got == [(i, k, c, plain.tokens(c)) for i, t in enumerate(texts) for k, c in enumerate(kept(by(t or "", size, overlap), least))]


def test_breaks(docs, texts):
    got = sorted((r.doc_id, r.sentence, r.similarity, r.breaks) for r in chunking.semantic_breaks(docs).collect())
    want = []
    for i, t in enumerate(texts):
        sims = plain.similarities(plain.sentences(t or ""))
        want += [(i, k + 1, s, s < plain.threshold(sims)) for k, s in enumerate(sims)]
    assert got == want


def test_hierarchy_and_tree(docs, texts):
    tree = {(i, f"{i}:{k}"): (up and f"{i}:{up}", kind, t) for i, x in enumerate(texts) for k, up, kind, t in plain.hierarchy(x or "")}
    got = chunking.hierarchical(docs)
    assert {(r.doc_id, r.chunk_id): (r.parent_chunk_id, r.chunk_type, r.text) for r in got.collect()} == tree
    cols = ["doc_id", "chunk_id", "child", "parent", "text", "child_text", "parent_text"]
    want = sorted((i, k, up, tree[i, up][0], t, tree[i, up][2], tree[i, tree[i, up][0]][2]) for (i, k), (up, kind, t) in tree.items() if kind == "grandchild")
    assert sorted(map(tuple, chunking.expanded(docs).select(cols).collect())) == want
    assert sorted(map(tuple, chunking.expand_tree(got).select(cols).collect())) == want


def table_rows(text):
    out, run = [], []
    for i, line in enumerate([*(text or "").split("\n"), ""]):
        s = line.strip(" ")
        if len(s) > 2 and s[0] == s[-1] == "|":
            run.append((i, s))
        elif run:
            rows = [s for _, s in run]
            sep = len(rows) > 1 and not set(rows[1]) - set("|:- \t") and len(rows[1]) > 2
            out.append((run[0][0], rows, sep))
            run = []
    return out


def parts_of(rows, sep, limit):
    head, body = rows[: 2 if sep else 1], rows[2 if sep else 1 :]
    if plain.tokens("\n".join(rows)) <= limit or not body:
        return [(0, max(0, len(body) - 1), "\n".join(rows))]
    parts, start, used, base = [], 0, 0, plain.tokens("\n".join(head))
    for i, r in enumerate(body):
        n = plain.tokens(r)
        if i > start and base + used + n > limit:
            parts.append((start, i - 1, "\n".join([*head, *body[start:i]])))
            start, used = i, 0
        used += n
    return [*parts, (start, len(body) - 1, "\n".join([*head, *body[start:]]))]


@pytest.mark.parametrize("limit", [600, 40, 3])
def test_tables(docs, texts, limit):
    got = sorted(map(tuple, chunking.table_chunks(docs, limit=limit).collect()))
    assert got == [(i, first, *p) for i, t in enumerate(texts) for first, rows, sep in table_rows(t) for p in parts_of(rows, sep, limit)]


def test_routed_job(spark, docs, texts):
    d = docs.withColumns({"file_type": F.element_at(F.array(*map(F.lit, ["csv", "txt", "pdf", "html"])), (F.col("doc_id") % 4 + 1).cast("int")), "title": F.when(F.col("doc_id") % 8 < 3, "Data policy")})
    df = chunking.chunk_job(d)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("RoundRobin", "").split("Generate")[0] and "Arrow" not in plan and "Window" not in plan
    got = sorted((r.doc_id, r.new_index, r.strategy, r.chunk_type, r.content_hash, r.token_count, r.is_table) for r in df.collect())
    routes = {r.doc_id: r.s for r in d.select("doc_id", chunking.strategy(F.col("file_type"), F.col("title"), F.col("text")).alias("s")).collect()}
    windows = lambda t: [" ".join(w[k : k + 393]) for w in [[x for x in __import__("re").split(r"[ \t\n\x0b\f\r]+", t) if x]] for k in range(0, len(w), 393)]
    want = []
    for i, t in enumerate(texts):
        t = t or ""
        how = routes[i]
        if how == "hierarchical":
            tree = plain.hierarchy(t)
            found = [(how, kind, c) for want_kind in ("parent", "grandchild", "child") for _, _, kind, c in tree if kind == want_kind]
        else:
            found = [(how, "text", c) for c in kept({"fixed_size": windows, "sentence_based": lambda t: plain.by_sentence(t, 512, 50), "recursive": lambda t: plain.recursive(t, 512, 50)}[how](t))]
        found += [("table", "table", p[2]) for _, rows, sep in table_rows(t) for p in parts_of(rows, sep, 600)]
        first = {}
        for how, kind, c in found:
            first.setdefault((kind, hashlib.sha256(c.encode()).hexdigest()), (how, kind, c))
        want += [(i, k, how, kind, h, plain.tokens(c), kind == "table") for k, ((_, h), (how, kind, c)) in enumerate(first.items())]
    assert got == sorted(want) and {r[2] for r in want} == {"fixed_size", "sentence_based", "recursive", "hierarchical", "table"}


def test_white_space_is_pythons():
    import sys

    assert set(folds.WHITE) == {chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()}
