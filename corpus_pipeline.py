"""A training-corpus pipeline over ``documents``: five stages of the operators in ``corpuskit.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read back
as the next stage's ``docs``. All but the last return the columns of ``documents``; ``n_chars`` follows the
text where lines went. Nulls, empty texts, repeated rows and empty tables are handled as each operator says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm.bpe import bpe_round_trip
from corpuskit.llm.decontaminate import decontaminate
from corpuskit.llm.line_dedup import drop_lines
from corpuskit.llm.minhash_dedup import near_dedup
from corpuskit.llm.quality_rules import quality_filter
from corpuskit.llm.queries import vocabulary_file
from corpuskit.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy keeps."""
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier, equal or within two edits; a document that loses all its
    lines goes."""
    kept = drop_lines(docs)
    if "n_chars" in docs.columns:
        length = F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", length)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return near_dedup(docs, k=5, percent=80).select(*[F.col(f"`{c}`") for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontaminate(docs, items).select(*[F.col(f"`{c}`") for c in docs.columns])


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the bytes decoded from them."""
    named = [c for c in ("doc_id", "lang", "source", "text") if c in docs.columns]
    return bpe_round_trip(docs.select(*named), vocabulary_file("byte_bpe_multi_50k.tiktoken"), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_level_bpe", byte_level_bpe),
]

# Edit distances, bands and byte-pair merges are not for SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole of ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    base = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
