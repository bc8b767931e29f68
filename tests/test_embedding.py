import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.functions.tokens import hash_vector
from corpuskit.operators.embedding import (HashEmbedder, RateLimited, ServiceError, call_with_retry, embed,
                                           hash_embed, run_batched)


class Flaky:
    """B8 doubles: rate-limited ``fails`` times, then works."""

    def __init__(self, fails, exc):
        self.fails, self.exc, self.calls = fails, exc, 0

    def __call__(self, texts):
        self.calls += 1
        if self.calls <= self.fails:
            raise self.exc
        return [[1.0, 0.0] for _ in texts]


def test_retry_policy_waits_and_limits():
    waits = []
    f = Flaky(2, RateLimited("slow down"))
    assert call_with_retry(f, ["a"], 5, 2.0, waits.append) == [[1.0, 0.0]]
    assert waits == [2.0, 4.0]
    waits.clear()
    with pytest.raises(Exception):
        call_with_retry(Flaky(10, ServiceError(503)), ["a"], 3, 1.0, waits.append)
    assert waits == [1.0, 2.0, 4.0]
    waits.clear()
    with pytest.raises(Exception):
        call_with_retry(Flaky(1, ServiceError(400)), ["a"], 3, 1.0, waits.append)
    assert waits == []


class FailOn:
    def __call__(self, texts):
        if any("FAIL" in t for t in texts):
            raise ValueError("bad text")
        return [[float(len(t)), 1.0] for t in texts]


def test_run_batched_isolates_failing_rows():
    out, errs = run_batched(["ok", "FAIL here", "fine"], FailOn(), 8, 2, 0.0, lambda s: None)
    assert out[0] == [2.0, 1.0] and out[2] == [4.0, 1.0] and out[1] is None
    assert errs[1] is not None and errs[0] is None


def test_embed_dataframe_keeps_failures_as_rows(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "FAIL"), (3, "")], "id long, text string")
    rows = {r.id: r for r in embed(df, FailOn(), sleep=lambda s: None).collect()}
    assert list(rows[1].embedding) == [2.0, 1.0] and rows[1].embed_error is None
    assert rows[2].embedding is None and "bad text" in rows[2].embed_error
    assert list(rows[3].embedding) == [0.0, 1.0]


def test_hash_engines_agree(spark):
    texts = ["Hello, hello WORLD!", "", "café Über 東京 42", "a b c d e f g"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    arrow = {r.id: r.embedding for r in hash_embed(df, dim=64, as_float=False).collect()}
    native = {r.id: r.v for r in df.select("id", hash_vector(F.col("text"), 64).alias("v")).collect()}
    py = HashEmbedder(64)(texts)
    for i in range(len(texts)):
        assert np.allclose(arrow[i], native[i]) and np.allclose(arrow[i], py[i])
    assert abs(np.linalg.norm(arrow[0]) - 1.0) < 1e-12 and not any(arrow[1])
    # non power-of-two dimension goes through the full 32-bit prefix
    a7 = hash_embed(df, dim=7, as_float=False).orderBy("id").collect()
    n7 = df.select(hash_vector(F.col("text"), 7).alias("v")).collect()
    assert all(np.allclose(a.embedding, n.v) for a, n in zip(a7, n7))


def test_term_bucket_memory_does_not_grow_with_the_vocabulary():
    # a worker kept the buckets of a million terms
    from corpuskit.operators import embedding as E

    E._BUCKETS.clear()
    for n in range(4):
        E._term_buckets([f"w{n}x{i}" for i in range(50_000)], 64)
    assert len(E._BUCKETS[64]) <= E._BUCKET_CACHE_MAX + 50_001 < 150_000


def test_hash_embed_makes_objects_of_some_rows_at_a_time(monkeypatch):
    # the whole Arrow batch was turned into Python strings at once
    import pyarrow as pa

    from corpuskit.operators import embedding as E

    seen, whole = [], E.hash_unit_vectors
    texts = [None if i % 7 == 0 else f"a{i} b b" for i in range(1300)]
    want = whole(texts, 8)
    monkeypatch.setattr(E, "hash_unit_vectors", lambda t, dim: seen.append(len(t)) or whole(t, dim))
    got = E._hash_udf(8).func(pa.array(texts))
    assert sum(seen) == 1300 and max(seen) <= 512
    assert np.array_equal(np.array(got.to_pylist()), want)
    assert len(E._hash_udf(8).func(pa.array([], pa.string()))) == 0


def test_embed_takes_a_bounded_number_of_rows_at_a_time():
    # the texts, vectors and errors of a whole Arrow batch were held at once
    import pyarrow as pa

    from corpuskit.operators.embedding import _embed_steps

    texts = [None if i % 7 == 0 else f"t{i}" for i in range(1300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1300)), pa.array(texts)], names=["id", "text"])
    calls = []

    def vectors_of(part):
        calls.append(part)
        return [None if t == "t1" else [float(len(t)), np.nan] for t in part], [("no" if t == "t1" else None) for t in part]

    out = list(_embed_steps(batch, "text", ["id", "text", "v", "e"], vectors_of, 64))
    assert max(map(len, calls)) <= 512 and [t for c in calls for t in c] == [t or "" for t in texts]
    rows = pa.Table.from_batches(out).to_pylist()
    assert [r["id"] for r in rows] == list(range(1300)) and [r["text"] for r in rows] == texts
    assert rows[1]["v"] is None and rows[1]["e"] == "no" and rows[2]["v"][0] == 2.0 and rows[2]["e"] is None
