"""ST2, ST3: per-key state on Structured Streaming.

* ``stream_latency_table`` keeps ``(runs, mean)`` per model in a table of versions and folds each
  micro-batch with the batch operator, whose step functions let the samples of one model be folded by
  many tasks. A micro-batch that comes twice is folded once.
* ``stream_model_latency`` (``applyInPandasWithState``) keeps ``(runs, mean)`` per model and applies the step-rounded
  running mean (A2) to each micro-batch in arrival order (ts, then id). The state is two
  numbers per model, so an unbounded stream needs no more memory than the batch fold.
* ``stream_cumulative_text`` keeps the deltas so far per response and emits the text after
  every non-empty one (W3); a final event closes the response and drops its state,
  and an optional processing-time timeout drops abandoned ones (such a query keeps
  running no-data batches to fire timeouts, so it never goes idle: run it as a
  long-lived query, not with ``processAllAvailable`` or ``availableNow``).
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from corpuskit.commitlog import CommitConflict, CommitLog, FileSystem
from corpuskit.operators.latency import model_latency


class LatencyTable:
    """Runs and step-rounded mean per model (A2), as versions below ``root``; each names the last epoch in it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = FileSystem(spark)
        self.log = CommitLog(self.files, f"{self.root}/log")

    def read(self) -> DataFrame | None:
        state = self.log.latest()
        return self.spark.read.parquet(f"{self.root}/{state['folder']}") if state else None

    def fold(self, samples: DataFrame, epoch: int, model: str = "model", value: str = "ttft_ms",
             order=("ts", "event_id")) -> bool:
        """Add the samples of an epoch behind those of all earlier ones; False if it is in already."""
        before = self.log.latest()
        if before and before["epoch"] >= epoch:
            return False
        folder = f"epoch-{epoch}-{uuid.uuid4().hex[:8]}"
        model_latency(samples, model, value, order, state=self.read()).write.parquet(f"{self.root}/{folder}")

        def step(latest):
            if (latest or {}).get("version") != (before or {}).get("version"):
                raise CommitConflict(f"another writer has added epoch {latest['epoch']}")
            return {"epoch": epoch, "folder": folder}

        self.log.commit(step)
        if before:  # readers of the version before keep its files for one epoch more
            old = self.log.read(before["version"] - 1)["folder"] if before["version"] else None
            if old:
                self.files.delete(f"{self.root}/{old}")
        return True


def stream_latency_table(samples: DataFrame, root: str, checkpoint: str, model: str = "model", value: str = "ttft_ms",
                         order=("ts", "event_id"), available_now: bool = True):
    """ST2 over a table: start the query that folds each micro-batch of ``samples`` into ``LatencyTable(root)``."""
    table = LatencyTable(samples.sparkSession, root)
    writer = samples.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, epoch: table.fold(batch, epoch, model, value, order) and None)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def _latency_fn(order_cols):
    def fn(key, batches, state):
        runs, mean = (state.get if state.exists else (0, 0.0))
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(order_cols, kind="mergesort")
        for x in pdf["x"].to_numpy(dtype=np.float64):
            mean = float(np.round((mean * runs + x) / (runs + 1)))
            runs += 1
        state.update((runs, mean))
        yield pd.DataFrame({"model": [key[0]], "runs": [runs], "avg_ttft_ms": [mean]})
    return fn


def stream_model_latency(samples: DataFrame, model: str = "model", value: str = "ttft_ms",
                         order=("ts", "event_id")) -> DataFrame:
    """ST2: streaming A2; output mode ``update`` (one row per model touched by a batch)."""
    order = list(order)
    s = samples.where(F.col(model).isNotNull() & F.col(value).isNotNull()).select(
        F.col(model).alias("model"), *order, F.col(value).cast("double").alias("x"))
    return s.groupBy("model").applyInPandasWithState(
        _latency_fn(order), "model string, runs long, avg_ttft_ms double", "runs long, mean double",
        "update", GroupStateTimeout.NoTimeout)


def stream_model_latency_exact(samples: DataFrame, model: str = "model", value: str = "ttft_ms") -> DataFrame:
    """Streaming A3: an ordinary streaming aggregation (complete/update mode)."""
    return (samples.where(F.col(model).isNotNull() & F.col(value).isNotNull())
                   .groupBy(F.col(model).alias("model"))
                   .agg(F.count("*").alias("runs"), F.avg(F.col(value).cast("double")).alias("avg_ttft_ms")))


def _cumulative_fn(timeout_ms):
    def fn(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        known = dict(zip(*state.get)) if state.exists else {}
        pdf = pd.concat(list(batches), ignore_index=True).sort_values("seq", kind="mergesort")
        new = {int(s): d for s, d in zip(pdf["seq"], pdf["delta"]) if d and int(s) not in known}
        known.update(new)
        # a delta that comes late belongs before what came earlier: texts from its place on are sent again
        text, rows = "", []
        for seq in sorted(known):
            text += known[seq]
            if new and seq >= min(new):
                rows.append((key[0], seq, text))
        if pdf["is_final"].any():
            state.remove()
        else:
            state.update((sorted(known), [known[s] for s in sorted(known)]))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
        if rows:
            yield pd.DataFrame(rows, columns=["response_id", "seq", "text_so_far"])
    return fn


def stream_cumulative_text(tokens: DataFrame, response: str = "response_id", seq: str = "seq",
                           delta: str = "delta", is_final: str | None = None,
                           timeout: str | None = None) -> DataFrame:
    """ST3: ``response_id, seq, text_so_far`` after every non-empty delta, in order of ``seq``. A delta that
    arrives after a later one corrects the texts from its place on; one that comes twice counts once."""
    final = F.col(is_final).cast("boolean") if is_final else F.lit(False)
    t = tokens.select(F.col(response).cast("string").alias("response_id"), F.col(seq).cast("long").alias("seq"),
                      F.coalesce(F.col(delta), F.lit("")).alias("delta"), F.coalesce(final, F.lit(False)).alias("is_final"))
    ms = _duration_ms(timeout) if timeout else None
    return t.groupBy("response_id").applyInPandasWithState(
        _cumulative_fn(ms), "response_id string, seq long, text_so_far string", "seqs array<long>, deltas array<string>",
        "append", GroupStateTimeout.ProcessingTimeTimeout if ms else GroupStateTimeout.NoTimeout)


def _duration_ms(text: str) -> int:
    n, unit = text.split()
    scale = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}
    return int(float(n) * scale[unit.rstrip("s")])
