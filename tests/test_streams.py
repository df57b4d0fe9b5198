"""Streams over several batches: any order of ids, documents that come again, restarts, windows that close once."""

import datetime as dt

from pyspark.sql import functions as F

from corpusloom.operators import bm25, sessions
from corpusloom.streaming import jobs


def files(spark, folder, parts, schema):
    """One file for each part, in the order in which the stream reads them."""
    import os
    import shutil
    import time

    os.makedirs(folder, exist_ok=True)
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}-{i}")
        one = next(f for f in os.listdir(f"{folder}-{i}") if f.endswith(".parquet"))
        to = f"{folder}/{len(os.listdir(folder)):03d}.parquet"
        shutil.move(f"{folder}-{i}/{one}", to)
        shutil.rmtree(f"{folder}-{i}")
        t = time.time() - 1000 + 10 * int(os.path.basename(to)[:3])
        os.utime(to, (t, t))


def test_dedup_in_any_order(spark, tmp_path):
    parts = [[(400_000_000, "a"), (7, "b")], [(500_000_000, "c"), (8, None)], [(1, "d"), (2, "a")], [(3, "c"), (9, None), (10, "e")]]
    files(spark, str(tmp_path / "t"), parts, "doc_id long, text string")
    s = jobs.source(spark, str(tmp_path / "t"), files_at_once=1).select("text")
    at = str(tmp_path / "at")
    assert sorted(map(repr, (r.text for r in jobs.drain(jobs.dedup(s, ["text"]), at, large=True).collect()))) == ["'a'", "'b'", "'c'", "'d'", "'e'", "None"]
    files(spark, str(tmp_path / "t"), [[(4, "b"), (5, "f")]], "doc_id long, text string")  # goes on where it was
    assert jobs.drain(jobs.dedup(s, ["text"]), at, large=True).count() == 7
    assert jobs.drain(jobs.dedup(s, ["text"])).count() == 7  # the session's own store


def test_documents_that_come_again(spark, tmp_path):
    parts = [[(1, "one two"), (2, "two")], [(3, "x x"), (1, "new words")], [(2, ""), (4, "y")]]
    files(spark, str(tmp_path / "t"), parts, "doc_id long, text string")
    s = jobs.source(spark, str(tmp_path / "t"), files_at_once=1)
    got = {(r.doc_id, r.term, r.tf) for r in jobs.drain_changes(s, bm25.term_frequency).collect()}
    assert got == {(1, "new", 1), (1, "words", 1), (3, "x", 2), (4, "y", 1)}


def test_sessions_write_touched_threads_only(spark, tmp_path):
    parts = [[(t, k, k) for t in range(50) for k in range(2)], [(3, 9, 9)], [(3, 5, 5), (60, 1, 1)]]
    files(spark, str(tmp_path / "t"), parts, "thread_id long, checkpoint_id long, created_at long")
    s = jobs.source(spark, str(tmp_path / "t"), files_at_once=1)
    at = str(tmp_path / "at")
    got = {r.thread_id: (r.checkpoint_id, r.n_turns) for r in jobs.drain_changes(sessions.newest(s), keys=["thread_id"], at=at).collect()}
    assert got == {t: (1, 2) for t in range(50)} | {3: (9, 4), 60: (1, 1)}
    by = {r.batch: r.n for r in spark.read.parquet(f"{at}/rows").groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert by == {0: 50, 1: 1, 2: 2}


def test_windows_close_once(spark, tmp_path):
    at = lambda m, s=0: dt.datetime(2024, 1, 1, 0, m, s)
    parts = [[(at(0, 5), 1), (at(2, 30), 2)], [(at(1, 50), 4), (at(2, 10), 8)], [(at(9), 16)], [(at(0, 10), 32), (at(9, 1), 64)]]  # the last but one closes, the first of the last is too late
    files(spark, str(tmp_path / "t"), parts, "ts timestamp, v long")
    s = jobs.source(spark, str(tmp_path / "t"), files_at_once=1)
    got = sorted((r.start.minute, r.total, r.n) for r in jobs.drain(jobs.per_window(s, "ts", "v")).collect())
    assert got == [(0, 1, 1), (1, 4, 1), (2, 10, 2)]


def test_rejects_and_restart(spark, tmp_path):
    """A bad row doesn't stop the run; a batch that is run again, and a second run, double nothing."""
    parts = [[(1, "12"), (2, "x")], [(3, None), (4, "7")]]
    files(spark, str(tmp_path / "t"), parts, "id long, text string")
    s = jobs.source(spark, str(tmp_path / "t"), files_at_once=1)
    number = F.col("text").try_cast("int")
    reason = F.when(F.col("text").isNull(), "null").when(number.isNull(), "no number")
    at = str(tmp_path / "at")
    both = lambda: tuple(sorted(map(tuple, x.collect())) for x in jobs.drain_checked(s, reason, at))
    want = [(1, "12"), (4, "7")], [(2, "x", "no number"), (3, None, "null")]
    assert both() == want == both()
    import shutil

    shutil.rmtree(f"{at}/checkpoint/commits")  # as if it broke off before the last batches were committed
    assert both() == want
    files(spark, str(tmp_path / "t"), [[(5, "5")]], "id long, text string")
    assert both() == (sorted([*want[0], (5, "5")]), want[1])


def test_staged_files_are_archived(spark, tmp_path):
    from corpusloom.sources import files as S

    (tmp_path / "in").mkdir()
    for name, data in {"a.txt": b"words", "b.pdf": b"no pdf", "c.txt": b"caf\xe9"}.items():
        (tmp_path / "in" / name).write_bytes(data)
    at, old = str(tmp_path / "at"), tmp_path / "old"
    name = F.substring_index("path", ".", -1)
    go = lambda: jobs.drain_checked(jobs.staged(spark, str(tmp_path / "in"), str(old), 1), F.when(name == "pdf", "no pdf"), at)
    accepted, rejected = go()
    assert (accepted.count(), rejected.count()) == (2, 1)
    assert {r.path[-5:]: (r.text, r.parser) for r in S.scan(accepted.select("path", "length", "content")).collect()} == {"a.txt": ("words", "plain_text"), "c.txt": ("café", "latin_text")}
    (tmp_path / "in" / "d.txt").write_bytes(b"more")
    accepted, rejected = go()
    assert (accepted.count(), rejected.count()) == (3, 1)
    assert len(list(old.rglob("*.*"))) >= 3 and len(list((tmp_path / "in").iterdir())) <= 1  # all but the last batch's
