"""Intermediate tables written to the shared folder of the session, so that they survive executors."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame

from corpuskit.session import scratch_path

_WRITTEN: list = []


def staged(df: DataFrame) -> DataFrame:
    """``df`` as a written table: computed once, and read back by column where it is needed again.

    The table lies below ``spark.checkpoint.dir`` (see ``scratch_path``) and goes when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"stage-{uuid.uuid4().hex}")
    if not _WRITTEN:
        atexit.register(_remove)
    _WRITTEN.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already; then the folder stays
        for spark, path in _WRITTEN:
            context = spark.sparkContext
            if context._jsc is not None and not context._jsc.sc().isStopped():
                target = context._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
    _WRITTEN.clear()
