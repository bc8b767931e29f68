import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from corpuskit.operators.latency import (cumulative_text, first_token_latency, model_latency,
                                         model_latency_exact, models_with_stats)


def fold(xs):
    n, m = 0, 0.0
    for x in xs:
        m = float(round((m * n + x) / (n + 1)))
        n += 1
    return n, m


def test_model_latency_matches_sequential_fold_hot_model(spark):
    rng = np.random.default_rng(5)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        model = "hot" if i % 3 else ("a" if i % 2 else None)
        rows.append((i, base + dt.timedelta(seconds=int(rng.integers(0, 10**6))), model,
                     float(np.round(rng.uniform(0, 300), 2)) if i % 97 else 2.5))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, model string, ttft_ms double")
    got = {r.model: (r.runs, r.avg_ttft_ms) for r in model_latency(df, n_segments=7).collect()}
    for m in ("hot", "a"):
        xs = [x for _, _, mm, x in sorted(rows, key=lambda r: (r[1], r[0])) if mm == m]
        assert got[m] == fold(xs)
    assert None not in got
    exact = {r.model: r.avg_ttft_ms for r in model_latency_exact(df).collect()}
    assert abs(exact["hot"] - np.mean([x for _, _, m, x in rows if m == "hot"])) < 1e-9


def test_half_even_steps(spark):
    rows = [(0, dt.datetime(2024, 1, 1, 0, 0, 0), "m", 0.5), (1, dt.datetime(2024, 1, 1, 0, 0, 1), "m", 2.0)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, model string, ttft_ms double")
    r = model_latency(df).first()
    assert (r.runs, r.avg_ttft_ms) == fold([0.5, 2.0]) == (2, 1.0)


def test_first_token_latency_b7(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("r1", t, ""), ("r1", t + dt.timedelta(milliseconds=5), "  "), ("r1", t + dt.timedelta(milliseconds=12), "hi"),
            ("r2", t, None), ("r2", t + dt.timedelta(milliseconds=3), " ")]
    df = spark.createDataFrame(rows, "response_id string, ts timestamp, delta string")
    got = {r.response_id: r.ttft_ms for r in first_token_latency(df).collect()}
    assert got == {"r1": 12.0, "r2": None}


def test_cumulative_text(spark):
    rows = [("r", 2, "b"), ("r", 1, "a"), ("r", 3, ""), ("r", 4, None), ("r", 5, "c")]
    df = spark.createDataFrame(rows, "response_id string, seq long, delta string")
    got = [r.text_so_far for r in cumulative_text(df).orderBy("seq").collect()]
    assert got == ["a", "ab", "abc"]
    assert cumulative_text(df, final_only=True).first().text == "abc"


def test_models_with_stats_left_join(spark):
    models = spark.createDataFrame([("m1", 1_250_000_000), ("m2", 2_000_000_000)], "name string, size_bytes long")
    stats = spark.createDataFrame([("m1", 3, 42.0)], "model string, runs long, avg_ttft_ms double")
    got = {r.name: (r.size_gb, r.avg_ttft_ms, r.runs) for r in models_with_stats(models, stats).collect()}
    assert got == {"m1": (1.2, 42.0, 3), "m2": (2.0, None, 0)}


def test_one_huge_sample_costs_no_memory(spark):
    rows = [("m", i, float(x)) for i, x in enumerate([10.0, 4e7, 12.0])] + [("n", 9, 3.0)]
    df = spark.createDataFrame(rows, "model string, ts long, ttft_ms double")
    out = {r.model: (r.runs, r.avg_ttft_ms) for r in model_latency(df, order="ts", n_segments=1).collect()}
    assert out == {"m": (3, 13333341.0), "n": (1, 3.0)}


def test_newline_tokens_are_blank(spark):
    import datetime as dt
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    df = spark.createDataFrame([("r", at(0), ""), ("r", at(1), "\n \t"), ("r", at(3), "x")], "response_id string, ts timestamp, delta string")
    assert first_token_latency(df).first().ttft_ms == 3000.0


def _samples(spark, rows):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, base + dt.timedelta(seconds=i), m, float(x)) for i, (m, x) in enumerate(rows)],
                                 "event_id long, ts timestamp, model string, ttft_ms double")


def test_outlier_in_a_model_of_many_segments(spark):
    rng = np.random.default_rng(8)
    xs = [float(x) for x in rng.integers(0, 400, 4000)]
    xs[5], xs[1700], xs[3990] = 6e7, 6e7, 0.25
    got = model_latency(_samples(spark, [("m", x) for x in xs]), n_segments=8).first()
    assert (got.runs, got.avg_ttft_ms) == fold(xs)


def test_step_functions_compose_to_the_fold():
    from corpuskit.operators.stepmean import Fold
    rng = np.random.default_rng(3)
    for kind in range(40):
        n = int(rng.integers(2, 300))
        x = [rng.integers(0, 50, n) * 1.0, rng.random(n) * 1e4, np.where(rng.random(n) < .02, 6e7, rng.random(n) * 300),
             rng.normal(size=n) * 1000][kind % 4]
        cut = int(rng.integers(1, n))
        f = Fold(cut, x[:cut].sum(), x[:cut].min(), x[:cut].max())
        for part in np.array_split(x[cut:], 3):
            f.add(part)
        assert float(f.function(np.int64(fold(x[:cut])[1]))) == fold(x)[1]
        assert len(f.function.starts) <= n + 2  # no longer than the samples, whatever their values


def test_state_goes_before_the_samples(spark):
    rng = np.random.default_rng(9)
    rows = [(str(rng.choice(["a", "b", "c"], p=[0.8, 0.1, 0.1])), x) for x in rng.integers(0, 900, 3000)]
    rows += [("late", 5.5)]
    first = model_latency(_samples(spark, rows[:1000]), n_segments=5)
    both = model_latency(_samples(spark, rows[1000:]), n_segments=6, state=first)
    got = {r.model: (r.runs, r.avg_ttft_ms) for r in both.collect()}
    assert got == {m: fold([x for k, x in rows if k == m]) for m in ("a", "b", "c", "late")}
    none = model_latency(_samples(spark, rows[:0]), state=first)
    assert sorted(map(tuple, none.collect())) == sorted(map(tuple, first.collect()))
