"""Embed a text column.

* ``hash_embed`` (V1a) is the built-in embedder. Its default engine is an Arrow UDF (terms split
  by Arrow, md5 of each different term, ``numpy.bincount``), some rows at a time; the same vector as a
  pure native expression (``engine="native"``) is several times slower, because Spark interprets
  higher-order-function lambdas per element.
* ``embed`` (V1) runs any ``list[str] -> list[vector]`` callable over Arrow batches with
  ``mapInArrow``. Calls go out in batches of ``batch_size``; rate-limit and 5xx errors
  are retried with waits ``base_delay * 2**attempt`` up to ``max_retries`` times, other
  errors are final. A batch that still fails is retried row by row, so one bad text does
  not cost its neighbours; failed rows keep a null ``embedding`` and the error text in
  ``embed_error`` (never fail the job). Concurrency is the number of partitions.
"""

from __future__ import annotations

import hashlib
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.config import DEFAULT_EMBED_BATCH, DEFAULT_RETRY_BASE_DELAY, DEFAULT_RETRY_MAX
from corpuskit.functions.tokens import with_hash_vector


class EmbedError(Exception):
    """Final error of an embedder call; ``service_down`` if its retries ran out."""

    def __init__(self, message: str, service_down: bool = False):
        super().__init__(message)
        self.service_down = service_down


class RateLimited(Exception):
    """Raised by an embedder/completer when the service rate-limits: retried."""


class ServiceError(Exception):
    """Raised with an HTTP-like status; retried when ``status >= 500``."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(f"status {status}: {message}")
        self.status = status


def is_passing(exc: BaseException) -> bool:
    """The error may go away by itself: a rate limit, or a fault of the service."""
    return isinstance(exc, RateLimited) or isinstance(exc, ServiceError) and exc.status >= 500


def call_with_retry(fn, arg, max_retries: int = DEFAULT_RETRY_MAX,
                    base_delay: float = DEFAULT_RETRY_BASE_DELAY, sleep=time.sleep):
    """``fn(arg)``, called again after each passing error; the waits double, and there are ``max_retries``."""
    waits = iter([base_delay * 2 ** n for n in range(max_retries)])
    while True:
        try:
            return fn(arg)
        except Exception as exc:
            wait = next(waits, None) if is_passing(exc) else None
            if wait is None:
                raise EmbedError(f"{type(exc).__name__}: {exc}", is_passing(exc)) from exc
        sleep(wait)


class SlotPacer:
    """A call rate that several tasks keep together without talking to each other.

    Time is cut into slots of ``1 / rate`` seconds of the wall clock, the same for all tasks; of ``n`` tasks,
    number ``index`` calls only in slots ``index, index + n, ...``, one call each. A task that meets a rate
    limit all the same uses every second of its slots, then every fourth; after ``CALM`` calls without one it
    doubles back (slow tasks leave their slots empty: the limit is kept, not always used up). A tenth of the
    rate is kept in hand, because a call reaches the service later than it was let go."""

    IN_HAND, CALM, MOST = 0.1, 8, 64

    def __init__(self, rate: float, index: int, n: int, clock=time.time, sleep=time.sleep):
        self.width = 1.0 / (rate * (1 - self.IN_HAND))
        self.index, self.n, self.clock, self.sleep = index, n, clock, sleep
        self.every, self.calm, self.last = 1, 0, -1

    def wait(self) -> None:
        """Return within this task's next free slot."""
        while True:
            slot = max(int(self.clock() / self.width), self.last + 1)
            step = self.n * self.every
            slot += (self.index - slot) % step
            ahead = slot * self.width - self.clock()
            if ahead > 0:
                self.sleep(ahead)
            if int(self.clock() / self.width) == slot or ahead <= 0:
                self.last = slot
                return

    def passed(self) -> None:
        self.calm += 1
        if self.calm >= self.CALM and self.every > 1:
            self.every, self.calm = self.every // 2, 0

    def limited(self) -> None:
        self.every, self.calm = min(self.every * 2, self.MOST), 0

    def paced(self, fn):
        """``fn``, each call in a slot."""
        def call(arg):
            self.wait()
            try:
                out = fn(arg)
            except RateLimited:
                self.limited()
                raise
            self.passed()
            return out
        return call


def task_pacer(rate: float | None, n: int | None, sleep=time.sleep):
    """In a task: what paces calls to ``rate`` a second over ``n`` tasks; nothing without a rate."""
    if not rate:
        return lambda fn: fn
    from pyspark import TaskContext

    return SlotPacer(rate, TaskContext.get().partitionId() % (n or 1), n or 1, sleep=sleep).paced


def run_batched(texts: list, fn, batch_size: int, max_retries: int, base_delay: float, sleep,
                check_len: bool = True):
    """Call ``fn`` over ``texts`` in batches; returns (results, errors), one per text. A batch that is refused
    goes again text by text, to spare its neighbours; one whose retries ran out does not, because the
    service is down for each of them."""
    results: list = [None] * len(texts)
    errors: list = [None] * len(texts)
    todo = [slice(i, min(i + batch_size, len(texts))) for i in range(0, len(texts), batch_size)]
    while todo:
        part = todo.pop()
        size = part.stop - part.start
        try:
            got = call_with_retry(fn, texts[part], max_retries, base_delay, sleep)
            if check_len and len(got) != size:
                raise EmbedError(f"expected {size} results, got {len(got)}")
            results[part] = list(got)
        except EmbedError as exc:
            if size == 1 or exc.service_down:
                errors[part] = [str(exc)] * size
            else:
                todo += [slice(i, i + 1) for i in range(part.start, part.stop)]
    return results, errors


def _embed_steps(batch: pa.RecordBatch, text_col: str, names: list, vectors_of, batch_size: int):
    """The rows of an Arrow batch with their vectors and errors, a bounded number of calls at a time."""
    rows = batch_size * max(1, _STEP_ROWS // batch_size)
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        vecs, errs = vectors_of(part.column(text_col).to_pandas().fillna("").astype(str).tolist())
        vecs = [None if v is None else np.asarray(v, dtype=np.float32) for v in vecs]
        yield pa.RecordBatch.from_arrays(
            [*part.columns, pa.array(vecs, pa.list_(pa.float32()), from_pandas=True), pa.array(errs, pa.string())], names=names)


def embed(df: DataFrame, embedder, text_col: str = "text", out_col: str = "embedding",
          batch_size: int = DEFAULT_EMBED_BATCH, max_retries: int = DEFAULT_RETRY_MAX,
          base_delay: float = DEFAULT_RETRY_BASE_DELAY, sleep=time.sleep,
          concurrency: int | None = None, rate: float | None = None) -> DataFrame:
    """V1: add ``out_col`` (array<float>) and ``embed_error`` (string) to ``df``. ``concurrency``: number of
    tasks; ``rate``: calls a second over all of them together (``SlotPacer``; needs ``concurrency``)."""
    if rate and not concurrency:
        raise ValueError("a rate is shared by a known number of tasks: set concurrency")
    if concurrency:
        df = df.repartition(concurrency)
    fields = [f for f in df.schema.fields if f.name not in (out_col, "embed_error")]
    schema = T.StructType(fields + [T.StructField(out_col, T.ArrayType(T.FloatType())),
                                    T.StructField("embed_error", T.StringType())])
    keep = [f.name for f in fields]

    def run(batches):
        call = task_pacer(rate, concurrency)(embedder)

        def vectors_of(texts):
            return run_batched(texts, call, batch_size, max_retries, base_delay, sleep)

        for batch in batches:
            yield from _embed_steps(batch, text_col, schema.fieldNames(), vectors_of, batch_size)

    return df.select(*keep).mapInArrow(run, schema)


_BETWEEN = r"[^\pL\pN]+"  # what lies between two terms
_STEP_CHARS = 1 << 20  # characters split at once
_STEP_ROWS = 512  # rows of an Arrow batch that are Python objects at one time
_BUCKETS: dict = {}
_BUCKET_CACHE_MAX = 1 << 16


def _term_buckets(terms: list, dim: int) -> np.ndarray:
    """Bucket of each term (md5 prefix, 32 bits, mod ``dim``), -1 for the empty one. Buckets of terms seen
    are memoised per worker process (bounded)."""
    cache = _BUCKETS.setdefault(dim, {"": -1})
    if len(cache) > _BUCKET_CACHE_MAX:
        cache.clear()
        cache[""] = -1
    md5 = hashlib.md5
    for t in terms:
        if t not in cache:
            cache[t] = int.from_bytes(md5(t.encode("utf-8")).digest()[:4], "big") % dim
    return np.fromiter(map(cache.__getitem__, terms), np.int64, len(terms))


def _count_step(texts: list, dim: int) -> np.ndarray:
    parts = pc.split_pattern_regex(pa.array(texts, pa.large_string()), _BETWEEN)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy())
    terms = pc.list_flatten(parts).dictionary_encode()  # each different term of the step is hashed once
    bucket = _term_buckets(terms.dictionary.to_pylist(), dim)[terms.indices.to_numpy()]
    own = bucket >= 0
    return np.bincount(owner[own] * dim + bucket[own], minlength=len(texts) * dim).reshape(len(texts), dim)


def hash_matrix(texts, dim: int) -> np.ndarray:
    """Counts of terms by bucket, a row for each text; a null is an empty text."""
    lows = [t.lower() if isinstance(t, str) else "" for t in texts]
    out = np.zeros((len(lows), dim))
    at, held = 0, 0
    for i, low in enumerate(lows):
        held += len(low)
        if held >= _STEP_CHARS:
            out[at:i + 1] = _count_step(lows[at:i + 1], dim)
            at, held = i + 1, 0
    if at < len(lows):
        out[at:] = _count_step(lows[at:], dim)
    return out


def hash_unit_vectors(texts, dim: int) -> np.ndarray:
    counts = hash_matrix(texts, dim)
    norm = np.sqrt((counts * counts).sum(1, keepdims=True))
    return counts / np.where(norm > 0, norm, 1)


def _hash_udf(dim: int):
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def vec(texts: pa.Array) -> pa.Array:
        out = np.empty((len(texts), dim))
        for at in range(0, len(texts), _STEP_ROWS):
            out[at:at + _STEP_ROWS] = hash_unit_vectors(texts.slice(at, _STEP_ROWS).to_pylist(), dim)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim), pa.array(out.ravel()))
    # Deterministic, so a retried task after an executor loss recomputes the same rows.
    # Callers keep it evaluated once: no filter on the vector column (a pushed-down filter
    # would call it again) and outer generators (no inferred size filter).
    return vec


def hash_embed(df: DataFrame, text_col: str = "text", out_col: str = "embedding", dim: int = 64,
               as_float: bool = True, engine: str = "arrow") -> DataFrame:
    """Hashed bag-of-terms vector (unit length) for every row, row-local."""
    if engine == "native":
        out = with_hash_vector(df, text_col, out_col, dim)
    else:
        out = df.withColumn(out_col, _hash_udf(dim)(F.col(text_col)))
    return out.withColumn(out_col, F.col(out_col).cast("array<float>")) if as_float else out


class HashEmbedder:
    """The V1a vector as a Python ``list[str] -> list[vector]`` callable (for V1/V4)."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts):
        return hash_unit_vectors(texts, self.dim).tolist()


def quarantine(embedded: DataFrame, out_col: str = "embedding"):
    """split into (embedded rows, failed rows)."""
    ok = embedded.where(F.col(out_col).isNotNull())
    bad = embedded.where(F.col(out_col).isNull())
    return ok, bad


def as_pandas_vectors(series: pd.Series) -> np.ndarray:
    """Arrow list column (one vector per row, same length) as a float64 matrix."""
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.stack(series.to_numpy()).astype(np.float64, copy=False)
