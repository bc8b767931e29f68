"""Sums of arrays over all tasks: tasks write rows of 64 numbers, which Spark adds up place by place.

A task that holds a partial sum (a covariance, a bundle of vectors) writes it as rows
``(key, at, v0 .. v63)``; the aggregate combines them before and after the shuffle, so nothing larger than
one row meets in one place until the finished sums are fetched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType

WIDTH = 64


def schema(key: DataType, value: DataType) -> StructType:
    return StructType([StructField("key", key), StructField("at", LongType()),
                       *[StructField(f"v{j}", value) for j in range(WIDTH)]])


def rows(key, key_type: pa.DataType, values: np.ndarray) -> pa.RecordBatch:
    """``values`` (any shape, taken in order) as rows of one key; the last row is filled up with zeros."""
    flat = values.ravel()
    n = -(-len(flat) // WIDTH)
    grid = np.zeros(n * WIDTH, flat.dtype)
    grid[:len(flat)] = flat
    grid = grid.reshape(n, WIDTH)
    return pa.RecordBatch.from_arrays(
        [pa.array([key] * n, key_type), pa.array(np.arange(n)),
         *[pa.array(np.ascontiguousarray(grid[:, j])) for j in range(WIDTH)]],
        names=["key", "at", *[f"v{j}" for j in range(WIDTH)]])


def total(parts: DataFrame) -> DataFrame:
    return parts.groupBy("key", "at").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(WIDTH)])


def fetch(parts: DataFrame) -> dict:
    """Key -> its sum, flat and in order (one array for each key: the caller bounds their number)."""
    out: dict = {}
    for batch in total(parts).orderBy("key", "at").toArrow().to_batches():
        if batch.num_rows:
            grid = np.stack([batch.column(2 + j).to_numpy(zero_copy_only=False) for j in range(WIDTH)], axis=1)
            for i, key in enumerate(batch.column(0).to_pylist()):
                out.setdefault(key, []).append(grid[i])
    return {k: np.concatenate(v) for k, v in out.items()}
