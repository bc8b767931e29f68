import __spark_entry__ as E


def test_entry_runs_on_smoke_data(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"question_id", "rank", "chunk_id", "doc_id", "distance", "score", "label", "snippet"} == set(df.columns)


def test_every_query_registered_with_oracle_or_test():
    qs, oracle = E.queries(), E.oracle_sql()
    assert set(oracle) <= set(qs)
    free = {n for n in set(qs) - set(oracle) if not n.startswith("op") and n != "pipeline"}
    assert not free


def test_registered_queries_run_on_smoke_data(spark):
    own = {n: f for n, f in E.queries().items() if not n.startswith("op") and n != "pipeline"}  # those have tests of their own
    for name, fn in own.items():
        df = fn(spark, "/root/testdata/sf0.001")
        assert df.columns, name
        df.write.format("noop").mode("overwrite").save()
