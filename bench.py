"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs to completion through the ``noop`` sink (every row computed, nothing
collected); the first query also pays for session start-up and is run once untimed.
Prints one JSON line: ``{"metric", "value", "unit", "queries", "sf", ...}``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from corpuskit.operators.search import exact_top_k  # noqa: E402
from corpuskit.plans.catalog import QUERIES, TOP_K, vector_questions  # noqa: E402
from corpuskit.session import get_spark  # noqa: E402

HEADLINE = [
    "retrieve_sources", "dedupe_first_text", "skip_existing", "ingest_report", "window_chunks",
    "sentence_chunks", "hash_embed", "page_text", "page_documents", "mail_select", "exact_top_k",
    "approx_top_k", "build_prompts", "model_latency", "model_latency_exact", "first_token_latency",
    "cumulative_text",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [a for a in sys.argv[1:] if a in QUERIES] or HEADLINE
    spark = get_spark(f"local[{cpus}]", app="corpuskit-bench", shuffle_partitions=max(8, 2 * cpus),
                      extra={"spark.driver.memory": "16g"})
    # warm-up (untimed): JVM code paths and the Python workers of UDF / mapInPandas stages
    for warm in ("window_chunks", "exact_top_k"):
        QUERIES[warm](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    # quality of the approximate search: recall@k against the exact one, for the same questions
    exact = exact_top_k(vector_questions(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"),
                        TOP_K, c_id="vec_id").select("question_id", "vec_id")
    approx = QUERIES["approx_top_k"](spark, sf_dir).select("question_id", "vec_id")
    n_exact = exact.count()
    recall = exact.join(approx, ["question_id", "vec_id"], "left_semi").count() / max(1, n_exact)
    # a fresh store: seconds, new documents and chunk rate.
    import uuid

    from corpuskit.plans.ingest import ingest
    from corpuskit.session import scratch_path
    from corpuskit.store import CollectionStore
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("doc_id"), "text")
    store = CollectionStore(spark, scratch_path(spark, f"bench-store-{uuid.uuid4().hex[:12]}"))
    report = ingest(docs, store, "documents")
    again = ingest(docs, store, "documents")  # a re-run finds everything stored
    ingest_stats = {"seconds": round(report.seconds, 3), "docs_loaded": report.docs_loaded,
                    "docs_new": report.docs_new, "chunks": report.chunks,
                    "chunks_per_sec": round(report.chunks_per_second, 1),
                    "rerun_seconds": round(again.seconds, 3), "rerun_docs_new": again.docs_new}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": cpus, "master": f"local[{cpus}]", "approx_recall_at_5": round(recall, 4),
                      "ingest": ingest_stats}))
    spark.stop()


if __name__ == "__main__":
    main()
