"""ST1: incremental ingest on Structured Streaming.

Each micro-batch goes through the batch ingest (D2 + J1 against the store + chunk +
embed + K1) in ``foreachBatch``. There is no watermark: the store is the memory of seen
ids, so a replayed file adds nothing. ``foreachBatch`` can run a batch twice after a
failure; J1 against the store makes that harmless as long as one query writes the
collection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from corpuskit.config import Settings
from corpuskit.plans.ingest import ingest
from corpuskit.session import scratch_path
from corpuskit.store import CollectionStore


def stream_documents(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """A file-source stream of documents (new files are picked up per trigger)."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def stream_ingest(stream: DataFrame, store: CollectionStore, collection: str, checkpoint: str | None = None,
                  embedder=None, settings: Settings = Settings(), chunker: str = "sentence",
                  available_now: bool = True):
    """Start the ingest query; returns the ``StreamingQuery``. With ``available_now`` it
    processes what is there and stops (``query.awaitTermination()``)."""
    reports = []

    def each(batch: DataFrame, epoch_id: int) -> None:
        reports.append(ingest(batch, store, collection, embedder, settings, chunker))

    ckpt = checkpoint or scratch_path(stream.sparkSession, f"stream-ingest-{collection}")
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    query = writer.start()
    query.reports = reports
    return query
