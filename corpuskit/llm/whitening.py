"""Embedding whitening by a weighted covariance of distinct vectors.

Each entry c becomes the integer ``x = floor(1024 * c) + 100000``. Rows with the same x are one distinct
vector with a count; the covariance is a sum over distinct vectors, weighted by their counts (or by one),
of centred products. Each distinct vector is whitened once, and the results go back to the rows by a join.

* Sums are integers, so ``n * x - S`` (n times the deviation from the mean) is exact; it is divided by n
  before the products, which are matrix products of one task's vectors.
* Only sums (dimensions squared numbers) and the eigenvectors made of them pass through the driver.
* A vector that more than a 1,000th of all rows hold is joined to its rows by a broadcast: there are fewer
  than 1,000 of those, whatever the input. The others meet their rows in a shuffle.

Defined results: a vector that is null, empty, or holds a null, non-finite or (as x) more than 64-bit entry is
left out with its row; a row with a null id counts and is returned like any other, and so is each of several
rows with one id; components of no variance (an eigenvalue below 1e-12 of the largest) are not returned, so
that a table of equal vectors gives no rows, like an empty table; vectors of different lengths are refused
with an error. Extra columns are not carried. The sign of a component makes its largest entry positive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (BinaryType, DecimalType, DoubleType, IntegerType, LongType, StructField, StructType)

from corpuskit.llm import blocksum
from corpuskit.llm.staging import staged
from corpuskit.session import ship_package

SCALE, SHIFT = 1024, 100_000
HOT_SHARE = 1_000  # vectors with more than 1 / HOT_SHARE of the rows are joined by a broadcast
NO_VARIANCE = 1e-12
ROWS = 4_096  # vectors of a matrix product
_WIDTHS = (("<i2", 1), ("<i4", 2), ("<i8", 3))


def pack_vector(x: np.ndarray) -> bytes:
    """``x - SHIFT`` in the fewest of 2, 4 or 8 bytes an entry that hold all of them: equal bytes are equal x."""
    y = x - SHIFT
    for kind, tag in _WIDTHS:
        if tag == 3 or (np.abs(y) < np.iinfo(kind).max).all():
            return bytes([tag]) + y.astype(kind).tobytes()
    raise AssertionError


def unpack_vectors(column: pa.Array) -> np.ndarray:
    """x of each packed vector, one row each."""
    kinds = {tag: kind for kind, tag in _WIDTHS}
    packed = column.to_pylist()
    x = [np.frombuffer(b, kinds[b[0]], offset=1).astype(np.int64) for b in packed]
    sizes = {len(v) for v in x}
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(sizes)}")
    return np.stack(x) + SHIFT if x else np.zeros((0, 0), np.int64)


def _packed(column: pa.Array) -> list[bytes | None]:
    """Each vector packed, or None where the row is left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = pc.list_flatten(column).cast(pa.float64())  # entries of null vectors are not among them
    c = pc.fill_null(entries, float("nan")).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        y = np.floor(SCALE * c)
        fits = np.abs(y) < 2.0 ** 62
    x = np.where(fits, y, 0).astype(np.int64) + SHIFT
    stops = np.cumsum(lengths)
    good = np.concatenate(([0], np.cumsum(~fits)))
    good = (good[stops] == good[stops - lengths]) & (lengths > 0)
    return [pack_vector(x[b - n:b]) if ok else None
            for b, n, ok in zip(stops.tolist(), lengths.tolist(), good.tolist(), strict=True)]


def packed_rows(df: DataFrame, vector: str, id_col: str) -> DataFrame:
    """(id, x packed) of the rows that remain."""
    ship_package(df.sparkSession)
    source = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector}`").alias("vector"))
    schema = StructType([source.schema["id"], StructField("x", BinaryType())])

    def run(batches):
        for batch in batches:
            keys = pa.array(_packed(batch.column(1)), pa.binary())
            out = pa.RecordBatch.from_arrays([batch.column(0), keys], names=["id", "x"])
            yield out.filter(pc.is_valid(keys))

    return source.mapInArrow(run, schema)


def _distinct_batches(batches, weights: str):
    """(x, weight of each) of the distinct vectors of a task, in blocks."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            x = unpack_vectors(part.column(0))
            w = np.asarray(part.column(1)) if weights == "count" else np.ones(len(x), np.int64)
            yield x, w


@dataclass
class Whitening:
    """What a fit knows: number of vectors n, integer sums S, eigenvalues (falling) and components (rows)."""

    n: int
    sums: list[int]
    trace: float
    eigenvalues: np.ndarray
    components: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exact: 64-bit integers where they fit, Python's otherwise."""
    widest = int(max(abs(int(x.max())), abs(int(x.min())), 1)) if x.size else 1
    if n * widest + max(map(abs, sums), default=0) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _sum_squares(d: np.ndarray) -> list[int]:
    if d.dtype != object and d.size and float(np.abs(d).max()) ** 2 * d.shape[1] < 2.0 ** 62:
        return (d * d).sum(1).tolist()
    return [sum(v * v for v in row) for row in d.tolist()]


def fit_whitening(distinct: DataFrame, weights: str = "count") -> Whitening | None:
    """Fit over ``distinct`` (x packed, count): each vector counted ``count`` times, or once each
    (``weights="one"``). None when there is no vector."""
    low = np.int64((1 << 31) - 1)

    def add(batches):  # n, and of each dimension the high and low halves of the sum
        n = hi = lo = 0
        for x, w in _distinct_batches(batches, weights):
            n += int(w.sum())
            hi = hi + ((x >> 31) * w[:, None]).sum(0)
            lo = lo + ((x & low) * w[:, None]).sum(0)
            if np.shape(hi) != x.shape[1:]:
                raise ValueError("vectors of different lengths")
        if n:
            yield blocksum.rows(0, pa.int32(), np.array([n, len(hi)]))
            yield blocksum.rows(1, pa.int32(), np.array([1, 0]))  # tasks, to find the length again
            yield blocksum.rows(2, pa.int32(), hi)
            yield blocksum.rows(3, pa.int32(), lo)

    source = distinct.select("x", "count")
    sums = blocksum.fetch(source.mapInArrow(add, blocksum.schema(IntegerType(), LongType())))
    if not sums:
        return None
    n, lengths, tasks = int(sums[0][0]), int(sums[0][1]), int(sums[1][0])
    size = lengths // tasks
    if size * tasks != lengths:
        raise ValueError("vectors of different lengths")
    s = [(int(h) << 31) + int(v) for h, v in zip(sums[2][:size], sums[3][:size], strict=True)]

    def multiply(batches):
        total = np.zeros((size, size))
        for x, w in _distinct_batches(batches, weights):
            if x.shape[1] != size:
                raise ValueError(f"vectors of different lengths: {size}, {x.shape[1]}")
            z = (deviations(x, n, s) / n).astype(np.float64)
            total += z.T @ (z * w[:, None])
        yield blocksum.rows(0, pa.int32(), total)

    moments = blocksum.fetch(source.mapInArrow(multiply, blocksum.schema(IntegerType(), DoubleType())))
    v = moments[0][:size * size].reshape(size, size) / n
    v = (v + v.T) / 2
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1].T.copy()
    vectors *= np.sign(vectors[np.arange(size), np.abs(vectors).argmax(1)])[:, None]
    return Whitening(n, s, float(np.trace(v)), values, vectors)


def _whiten_distinct(distinct: DataFrame, fit: Whitening, shown: int) -> DataFrame:
    """(x, count, deviation, z): each distinct vector whitened once; z is its ``shown`` components."""
    n, sums = fit.n, fit.sums
    basis = fit.components[:shown] / np.sqrt(fit.eigenvalues[:shown])[:, None]
    schema = StructType([StructField("x", BinaryType()), StructField("count", LongType()),
                         StructField("deviation", DecimalType(38, 0)),
                         *[StructField(f"z{i}", DoubleType()) for i in range(shown)]])

    def run(batches):
        from decimal import Decimal

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                d = deviations(unpack_vectors(part.column(0)), n, sums)
                z = (d / n).astype(np.float64) @ basis.T
                exact = [Decimal(v) if v < 10 ** 38 else None for v in _sum_squares(d)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(exact, pa.decimal128(38, 0)),
                     *[pa.array(np.ascontiguousarray(z[:, i])) for i in range(shown)]], names=schema.fieldNames())

    return distinct.select("x", "count").mapInArrow(run, schema)


def identity_error(whitened: DataFrame, n: int, shown: int, weights: str = "count") -> float:
    """Largest absolute entry of (covariance of the whitened vectors minus the identity)."""
    w = F.col("count") if weights == "count" else F.lit(1)
    pairs = [(i, j) for i in range(shown) for j in range(i, shown)]
    row = whitened.agg(*[F.sum(F.col(f"z{i}") * w).alias(f"s{i}") for i in range(shown)],
                       *[F.sum(F.col(f"z{i}") * F.col(f"z{j}") * w).alias(f"s{i}_{j}") for i, j in pairs]).first()
    return max(abs(row[f"s{i}_{j}"] / n - row[f"s{i}"] / n * row[f"s{j}"] / n - (i == j)) for i, j in pairs)


def whiten(df: DataFrame, vector: str = "embedding", id_col: str = "vec_id", components: int = 8,
           weights: str = "count") -> DataFrame:
    """One row for each remaining row of ``df`` and component (numbered from 1 by falling eigenvalue):
    ``id_col, component, n, deviation, whitened, explained, identity_error``.

    ``deviation`` is the exact sum over dimensions of ``(n * x - S)^2`` as decimal(38, 0) (null beyond
    it); ``whitened`` is the centred vector's coordinate on the component over the root of its eigenvalue.
    """
    spark = df.sparkSession
    rows = staged(packed_rows(df, vector, id_col))
    distinct = staged(rows.groupBy("x").agg(F.count(F.lit(1)).alias("count")))
    fit = fit_whitening(distinct, weights)
    id_type = rows.schema["id"].dataType
    schema = StructType([StructField(id_col, id_type), StructField("component", IntegerType()),
                         StructField("n", LongType()), StructField("deviation", DecimalType(38, 0)),
                         StructField("whitened", DoubleType()), StructField("explained", DoubleType()),
                         StructField("identity_error", DoubleType())])
    shown = 0
    if fit is not None and fit.eigenvalues[0] > 0:
        shown = min(components, int((fit.eigenvalues > NO_VARIANCE * fit.eigenvalues[0]).sum()))
    if not shown:
        return spark.createDataFrame([], schema)
    whitened = staged(_whiten_distinct(distinct, fit, shown))
    error = identity_error(whitened, fit.n, shown, weights)
    values = ["deviation", *[f"z{i}" for i in range(shown)]]
    n_rows = rows.count()
    often = F.col("count") * HOT_SHARE > n_rows
    hot = F.broadcast(whitened.where(often).select("x", *values))
    parts = [rows.join(hot, "x"),
             rows.join(F.broadcast(whitened.where(often).select("x")), "x", "left_anti")
                 .join(whitened.where(~often).select("x", *values), "x")]
    explained = (fit.eigenvalues / fit.trace).tolist()
    lines = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("component"), F.col(f"z{i}").alias("whitened"),
                                         F.lit(explained[i]).alias("explained")) for i in range(shown)]))
    out = parts[0].unionByName(parts[1]).select("id", "deviation", lines.alias("c"))
    return out.select(F.col("id").alias(id_col), "c.component", F.lit(fit.n).cast("long").alias("n"), "deviation",
                      "c.whitened", "c.explained", F.lit(error).alias("identity_error"))
