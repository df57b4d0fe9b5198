from pyspark.sql import functions as F

from corpusloom.functions import ids
from corpusloom.functions import text as X


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_namespace(spark):
    d = spark.createDataFrame([("ACME", "Legal Docs"), (None, None)], "a string, b string").select(ids.namespace(F.col("a"), F.col("b")).alias("n"))
    assert [r.n for r in d.collect()] == ["acme__legal_docs", "default__default"]
    d = spark.createDataFrame([("single",), ("a__b",)], "n string").select(*ids.parse_namespace(F.col("n")))
    assert [tuple(r) for r in d.collect()] == [("default", "default"), ("a", "b")]


def test_vector_id(spark):
    d = spark.createDataFrame([("doc-abc:2:5:17",), ("odd",), ("a:b:c:d",)], "v string").select(ids.parse_vector_id(F.col("v")).alias("p")).select("p.*")
    assert [tuple(r) for r in d.collect()] == [("doc-abc", 2, 5, 17), ("odd", 0, 0, 0), ("a:b:c:d", 0, 0, 0)]


def test_dates(spark):
    assert one(spark, "2024-01-15", ids.epoch) == 1705276800
    assert one(spark, None, ids.epoch) == 0
    assert one(spark, "bad-date", ids.epoch) == 0
    assert one(spark, "D:20240115093000Z", ids.pdf_date) == "2024-01-15"
    assert one(spark, "junk", ids.pdf_date) is None


def test_tokens(spark):
    for text, n in (("", 0), (None, 0), ("a", 1), (" ".join("abcde"), 6), (" ".join("a" * 15), 20), ("word " * 25, 32)):
        assert one(spark, text, X.token_count) == n
    assert one(spark, "x" * 38, X.approx_tokens) == 10
    cut = one(spark, "word " * 1000, lambda c: X.truncate(c, 10))
    assert len(cut) <= 5 * 10 and not cut.endswith(" ")


def test_language(spark):
    assert one(spark, "short", X.language) is None
    assert one(spark, "a plain sentence in ASCII letters", X.language) == "en"
    assert one(spark, "это русский текст для проверки", X.language) == "ru"


def test_sentences(spark):
    assert one(spark, 'One. Two! "Three" four? five', X.chunk_sentences) == ["One.", "Two!", '"Three" four? five']
    assert one(spark, None, X.sentences) == []


def test_states_of_any_depth(spark):
    from corpusloom.operators import sessions

    states = ['{"a": {"b": [1, {"c": null}, [true, 2.5]]}, "é": "q\\"x"}', "[]", "null", "no json", None, '{"deep": ' + "[" * 40 + "1" + "]" * 40 + "}"]
    got = sessions.round_trip(spark.createDataFrame([(i, s) for i, s in enumerate(states)], "i int, state string")).orderBy("i")
    assert [r.same for r in got.select("same").collect()] == [True, True, True, None, None, True]
    import json

    from pyspark.sql import functions as F

    back = [r.j for r in got.select(F.to_json("back").alias("j")).collect()]
    assert [b and json.loads(b) for b in back[:2]] == [json.loads(s) for s in states[:2]] and json.loads(back[5]) == json.loads(states[5])
