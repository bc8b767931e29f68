"""Session helpers: a configured SparkSession and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every corpuskit job expects; all are ordinary Spark SQL options.
SESSION_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_spark(master: str | None = None, app: str = "corpuskit",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or fetch) a session with the defaults above."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def is_local(spark: SparkSession) -> bool:
    """One process on this machine; ``local-cluster[...]`` has executors of its own and does not count."""
    return spark.sparkContext.master.split("[")[0] == "local"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and staged tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir). Only a
    local-mode session without one gets a fresh temporary folder; on a cluster a
    missing setting is an error, never a machine-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
    path = tempfile.mkdtemp(prefix="corpuskit-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss).

    The input is persisted for the duration of the checkpoint: a reliable checkpoint
    otherwise computes its input twice (once for the job, once for the write). Partitioning
    and row order are kept, which ``model_latency`` relies on.
    """
    from pyspark import StorageLevel

    checkpoint_dir(df.sparkSession)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


_PASSING: list = []


def passing_path(spark: SparkSession, name: str) -> str:
    """A ``scratch_path`` that is deleted when the driver ends: for tables that a query writes on its way and
    that its result may still be read from."""
    path = scratch_path(spark, name)
    if not _PASSING:
        atexit.register(_delete_passing)
    _PASSING.append((spark, path))
    return path


def _delete_passing() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already; then the folders stay
        for spark, path in _PASSING:
            context = spark.sparkContext
            if context._jsc is not None and not context._jsc.sc().isStopped():
                target = context._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
    _PASSING.clear()


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``corpuskit`` importable in Python workers (zip added with ``addPyFile``).

    Functions that run in workers (pandas UDFs, ``mapInPandas``) refer to this package
    by module name, so the workers need it on their path; this is what ``--py-files``
    does for a submitted job. Done once per application.
    """
    import os
    import zipfile

    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - sessions without a local context ship code otherwise
        return
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="corpuskit-pyfiles-")
    target = os.path.join(folder, "corpuskit.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition a *scan* that would leave most task slots idle.

    Row-local work (chunking, hashing, html, mail parsing) runs one task per input
    split; a small file with one row group would run it on one core. A scan with at least a
    quarter as many splits as there are slots is left as it is, so a large input is never
    shuffled for this. Call it on scans only: asking a plan with exchanges for its
    partition count would run those exchanges.
    """
    try:
        n = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        return df.repartition(n) if 4 * df.rdd.getNumPartitions() <= n else df
    except Exception:  # noqa: BLE001 - sessions without RDD access: keep the scan as is
        return df
