"""Statistics over request/token event logs.

``model_latency`` (A2) reproduces a running mean that is rounded (half-even) after every
sample, in arrival order. That recurrence is sequential, yet it is computed without
sending a model's samples to one task:

1. samples are range-partitioned on (model, arrival order) and cut from lineage, so a
   model with a third of all samples spans many partitions (segments);
2. a small table gives each (model, segment) number, sum and range of its earlier samples;
   only the first model of a segment can have any, so it has at most one row per partition;
3. a model that starts in a segment is folded as one number; for one that goes on, the
   segment makes the function ``incoming mean -> outgoing mean`` (``stepmean``: a list of the
   places where its shift changes, no longer than the segment, whatever the values);
4. one task for each model applies the functions of its segments in order, one after another.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.functions.text import size_gb
from corpuskit.operators import stepmean
from corpuskit.session import cut_lineage


def model_latency_exact(samples: DataFrame, model: str = "model", value: str = "ttft_ms") -> DataFrame:
    """A3: per model, runs and the plain mean (partial + final hash aggregate)."""
    return (samples.where(F.col(model).isNotNull() & F.col(value).isNotNull())
                   .groupBy(F.col(model).alias("model"))
                   .agg(F.count("*").alias("runs"), F.avg(F.col(value).cast("double")).alias("avg_ttft_ms")))


def model_latency(samples: DataFrame, model: str = "model", value: str = "ttft_ms",
                  order=("ts", "event_id"), n_segments: int | None = None, state: DataFrame | None = None) -> DataFrame:
    """A2: per model, ``runs`` and the step-rounded running mean ``avg_ttft_ms``. ``state`` (such a table,
    one row for each model) goes before the samples; its models stay in the result."""
    spark = samples.sparkSession
    order = [order] if isinstance(order, str) else list(order)
    s = (samples.where(F.col(model).isNotNull() & F.col(value).isNotNull())
                .select(F.col(model).alias("model"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)],
                        F.col(value).cast("double").alias("x")))
    okeys = [f"_o{i}" for i in range(len(order))]
    kind = s.schema["model"].dataType
    out_schema = T.StructType([T.StructField("model", kind), T.StructField("runs", T.LongType()),
                               T.StructField("avg_ttft_ms", T.DoubleType())])
    parts = n_segments or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(s.repartitionByRange(parts, "model", *okeys).sortWithinPartitions("model", *okeys))
    tagged = ranged.withColumn("seg", F.spark_partition_id())
    counts = tagged.groupBy("model", "seg").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.min("x").alias("lo"),
                                                F.max("x").alias("hi"))
    w = Window.partitionBy("model").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("model", "seg", F.sum("n").over(w).alias("n0"), F.sum("total").over(w).alias("total0"),
                           F.min("lo").over(w).alias("lo0"), F.max("hi").over(w).alias("hi0"))
    if state is not None:
        # the mean so far stands for its samples: it is what their plain mean differs from by no more than the band
        was = state.select(F.col("model").alias("model"), F.col("runs").alias("r"), F.col("avg_ttft_ms").alias("m"))
        base = F.coalesce(F.col("r"), F.lit(0))
        starts = starts.join(was, "model", "left").select(
            "model", "seg", (F.coalesce("n0", F.lit(0)) + base).alias("n0"),
            (F.coalesce("total0", F.lit(0.0)) + base * F.coalesce("m", F.lit(0.0))).alias("total0"),
            F.least("lo0", "m").alias("lo0"), F.greatest("hi0", "m").alias("hi0"))
    # Only a segment's first model can have earlier samples, but for those of the state: their number goes with
    # the segments, as rows, not through the driver.
    has_state = state is not None
    tagged = tagged.join(starts.where("n0 > 0"), ["model", "seg"], "left").repartition(parts, "seg", "model") \
        .sortWithinPartitions("model", "seg", *okeys) if state is not None else tagged
    known = {} if state is not None else {(r["model"], r["seg"]): tuple(r)[2:] for r in starts.where("n0 > 0").collect()}
    step_schema = T.StructType([T.StructField("model", kind), T.StructField("seg", T.IntegerType()),
                                T.StructField("n", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())),
                                T.StructField("shifts", T.ArrayType(T.LongType()))])

    def segments(batches):
        """Per (model, segment): the mean where the model starts here (a start of null), else the function
        of the mean before it."""
        cur, fold, mean, n = None, None, 0.0, 0

        def flush():
            f = fold.function if fold else None
            return pd.DataFrame([{"model": cur[0], "seg": cur[1], "n": n, "starts": f.starts if f else None,
                                  "shifts": f.shifts if f else [int(mean)]}])

        for pdf in batches:
            for key, rows in pdf.groupby(["model", "seg"], sort=False):
                key = (key[0], int(key[1]))
                if key != cur:
                    if cur is not None:
                        yield flush()
                    if has_state:
                        first = rows.iloc[0]
                        before = None if pd.isna(first["n0"]) else tuple(first[c] for c in ("n0", "total0", "lo0", "hi0"))
                    else:
                        before = known.get(key)
                    cur, mean, n = key, 0.0, 0
                    fold = stepmean.Fold(int(before[0]), *map(float, before[1:])) if before else None
                x = rows["x"].to_numpy(np.float64)
                if fold:
                    fold.add(x)
                else:
                    mean = stepmean.fold_from(mean, n, x)
                n += len(x)
        if cur is not None:
            yield flush()

    columns = ["model", "seg", "x"] + (["n0", "total0", "lo0", "hi0"] if state is not None else [])
    steps = cut_lineage(tagged.select(*columns).mapInPandas(segments, step_schema))
    if state is not None:
        first = state.select(F.col("model"), F.lit(-1).alias("seg"), F.col("runs").cast("long").alias("n"),
                             F.lit(None).cast("array<bigint>").alias("starts"), F.array(F.col("avg_ttft_ms").cast("long")).alias("shifts"))
        steps = steps.unionByName(first)
    in_order = steps.repartition("model").sortWithinPartitions("model", "seg")

    def apply(batches):
        """The functions of each model one after another, as they come; one number is kept."""
        cur, runs, mean = None, 0, 0
        for pdf in batches:
            for m_, n, starts_, shifts in zip(pdf["model"], pdf["n"], pdf["starts"], pdf["shifts"], strict=True):
                if cur is None or m_ != cur:
                    if cur is not None:
                        yield pd.DataFrame([(cur, runs, float(mean))], columns=["model", "runs", "avg_ttft_ms"])
                    cur, runs = m_, 0
                mean = int(shifts[0]) if starts_ is None else int(stepmean.StepFunction(starts_, shifts)(np.int64(mean)))
                runs += int(n)
        if cur is not None:
            yield pd.DataFrame([(cur, runs, float(mean))], columns=["model", "runs", "avg_ttft_ms"])

    return in_order.select("model", "n", "starts", "shifts").mapInPandas(apply, out_schema)


def first_token_latency(events: DataFrame, response: str = "response_id", ts: str = "ts",
                        delta: str = "delta", start: str | None = None, model: str | None = None) -> DataFrame:
    """A4: ms from the request start (``start`` column, else the response's first
    event) to its first token that is not blank; null when there is none."""
    nonblank = F.coalesce(F.col(delta), F.lit("")).rlike(r"[^\s\x{85}\x{A0}\x{1C}-\x{1F}]")
    aggs = [F.count("*").alias("n_events"),
            F.min(F.col(start) if start else F.col(ts)).alias("start_ts"),
            F.min(F.when(nonblank, F.col(ts))).alias("first_ts")]
    keys = [response] + ([model] if model else [])
    if model:
        # only requests whose model is known are measured
        events = events.where(F.col(model).isNotNull())
    out = events.groupBy(*keys).agg(*aggs)
    ms = F.expr("timestampdiff(MICROSECOND, start_ts, first_ts)") / F.lit(1000.0)
    return out.withColumn("ttft_ms", ms.cast("double"))


def cumulative_text(tokens: DataFrame, response: str = "response_id", seq: str = "seq",
                    delta: str = "delta", final_only: bool = False) -> DataFrame:
    """W3 (+F6): the text so far after every non-empty delta. The output grows with the
    square of a response's length; ``final_only`` keeps only the whole text."""
    t = tokens.where(F.coalesce(F.col(delta), F.lit("")) != "")
    if final_only:
        packed = F.array_sort(F.collect_list(F.struct(F.col(seq), F.col(delta))))
        return t.groupBy(response).agg(F.array_join(F.transform(packed, lambda s: s[delta]), "").alias("text"))
    w = Window.partitionBy(response).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("text_so_far", F.array_join(F.collect_list(delta).over(w), ""))


def models_with_stats(models: DataFrame, stats: DataFrame, name: str = "name",
                      size_col: str = "size_bytes") -> DataFrame:
    """J6 + T21: every model with ``size_gb``, its mean first-token ms (null when never
    measured) and ``runs`` (0 when never measured). ``stats`` holds one row per model."""
    st = stats.select(F.col("model").alias(name), "runs", "avg_ttft_ms")
    return (models.join(st, name, "left")
                  .select(name, size_gb(F.col(size_col)).alias("size_gb"), "avg_ttft_ms",
                          F.coalesce(F.col("runs"), F.lit(0)).cast("bigint").alias("runs")))
