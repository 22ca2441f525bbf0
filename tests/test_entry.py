import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"repo_id", "health_score", "total_issues"}


def test_every_query_has_a_plan(spark):
    qs = E.queries()
    assert len(qs) >= 60
    for name, fn in qs.items():
        df = fn(spark, "/root/testdata/sf0.001")
        assert df.columns, name


def test_oracle_names_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
