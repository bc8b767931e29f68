from pyspark.sql import functions as F

from corpuskit.operators.dedupe import dedupe_first, distinct_ids, skip_existing


def test_dedupe_first_keeps_smallest_order(spark):
    rows = [(5, "a", "x"), (2, "a", "y"), (9, "b", "z"), (3, "a", "w")]
    df = spark.createDataFrame(rows, "id long, k string, v string")
    got = sorted(tuple(r) for r in dedupe_first(df, "k", "id").collect())
    assert got == [(2, "a", "y"), (9, "b", "z")]


def test_dedupe_hot_key_expression(spark):
    # one key holds most rows: partial aggregation reduces it per task
    df = spark.range(0, 20000).select(F.col("id").alias("doc_id"),
                                      F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text"))
    out = dedupe_first(df.repartition(8), F.sha1("text"), "doc_id")
    got = dict((r.text, r.doc_id) for r in out.where(F.col("text") == "hot").collect())
    assert got == {"hot": 0}
    assert out.count() == 1 + 20000 * 3 // 10


def test_skip_existing_and_distinct_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id long, t string")
    existing = spark.createDataFrame([(2,), (2,), (None,)], "doc_id long")
    got = sorted(r.t for r in skip_existing(docs, existing).collect())
    assert got == ["a", "c"]
    ids = [r[0] for r in distinct_ids(existing).collect()]
    assert ids == ["2"]
