"""A1: what an ingest would do with a documents table, in one aggregation pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.config import DEFAULT_CHUNK_OVERLAP, DEFAULT_CHUNK_SIZE
from corpuskit.functions.tokens import chunk_tokens
from corpuskit.operators.chunking import window_count


def ingest_report(docs: DataFrame, existing: DataFrame, size: int = DEFAULT_CHUNK_SIZE,
                  overlap: int = DEFAULT_CHUNK_OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: ``docs_loaded, docs_unique, docs_existing, docs_new, chunks``.

    Unique = first document (smallest id) per distinct text; existing = unique documents
    whose id is already stored; chunks = window chunks of the new documents. The text
    de-duplication is one partially-aggregated shuffle; the id check is a left join
    against the distinct stored ids.
    """
    # chunk counts come first, so only (hash, id, count) is aggregated and crosses the join
    n_chunks = window_count(F.size(chunk_tokens(F.col(text_col))), size, overlap)
    slim = (docs.select(F.sha1(F.col(text_col)).alias("_k"), F.col(id_col).alias("_id"), n_chunks.alias("_nch"))
                .groupBy("_k").agg(F.min("_id").alias("_id"), F.max("_nch").alias("_nch"), F.count("*").alias("_dup")))
    known = existing.select(F.col(id_col).alias("_id")).where(F.col("_id").isNotNull()).distinct() \
        .withColumn("_known", F.lit(True))
    marked = slim.join(known, "_id", "left")
    is_new = F.col("_known").isNull()
    return marked.agg(
        F.sum("_dup").cast("bigint").alias("docs_loaded"),
        F.count("*").cast("bigint").alias("docs_unique"),
        F.count("_known").cast("bigint").alias("docs_existing"),
        F.count_if(is_new).cast("bigint").alias("docs_new"),
        F.coalesce(F.sum(F.when(is_new, F.col("_nch"))), F.lit(0)).cast("bigint").alias("chunks"))
