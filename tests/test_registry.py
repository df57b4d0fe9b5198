import __spark_entry__ as e


def test_every_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 100


def test_entry(spark):
    df = e.entry(spark)
    assert df.columns == ["query_id", "doc_id", "score", "rank"] and df.count() > 0
