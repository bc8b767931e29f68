"""The ingest job: documents -> new documents -> chunks -> vectors -> collection.

``leftover stages -> read -> skip stored ids (J1) -> one row per id (D2) -> chunk (G1/G2) -> stage (K6)
-> embed (V1) -> quarantine failures (F5) -> append (K1)``. The stage write is the one forced
materialisation: a run that fails after it is finished by the next call, before that call's own
documents, in the run's own mode (append or replace). The commit names its run, so a run that was committed
but not cleared, or a stream's micro-batch that comes twice, adds nothing.

Stored ids are looked up in the store's id index. Two jobs may write to one collection: the one that
commits second sees that the collection has moved on, leaves out documents that the other stored
meanwhile, and commits the rest.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from corpuskit.config import Settings
from corpuskit.operators.chunking import sentence_chunks, token_chunks, window_chunks
from corpuskit.operators.dedupe import dedupe_first, skip_existing
from corpuskit.operators.embedding import embed, hash_embed, quarantine
from corpuskit.operators.vector_index import VectorIndex
from corpuskit.store import MAX_COMMITS, CollectionStore, CommitConflict, stored_form


@dataclass
class IngestReport:
    collection: str
    docs_loaded: int = 0
    docs_new: int = 0
    docs_skipped: int = 0
    docs_without_id: int = 0
    chunks: int = 0
    chunks_failed: int = 0
    resumed_run: str | None = None
    seconds: float = 0.0

    @property
    def chunks_per_second(self) -> float:
        return self.chunks / self.seconds if self.seconds else 0.0


def document_id(id_col: str, text_col: str) -> Column:
    """The id as text; a document without one is named by its text, so that it is stored once."""
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("sha1:"), F.sha1(F.coalesce(text_col, F.lit("")))))


def ingest(docs: DataFrame, store: CollectionStore, collection: str, embedder=None,
           settings: Settings = Settings(), chunker: str = "sentence", fresh: bool = False,
           text_col: str = "text", id_col: str = "doc_id", by_text: bool = False) -> IngestReport:
    """Add the documents of ``docs`` that the collection does not hold yet, by their ids.

    Of rows with one id the one with the least text counts. A null id is replaced by the hash of the text
    (``docs_without_id`` counts them). A document without any chunk (an empty text) is remembered as
    seen. ``chunker``: ``sentence`` and ``window`` count words between blanks, ``token`` sub-word tokens. ``by_text`` also takes documents with equal texts for one (the smallest id stays).

    ``embedder=None`` uses the built-in hashed vector (V1a). ``fresh`` replaces the
    collection only after the new chunks are written (the old data survives a failure).
    Returns the counts; ``docs_new`` is the number of documents added.
    """
    t0 = time.monotonic()
    report = IngestReport(collection)
    store.drop_broken_stages(collection)
    for run in store.staged_runs(collection):
        if fresh:  # what it would add is about to be replaced
            store.clear_stage(collection, run)
        else:
            report.resumed_run = run
            _embed_and_store(store, collection, run, embedder, settings, report)
    base = store.version(collection)
    obs_in, obs_new = Observation("docs_in"), Observation("docs_new")
    loaded = docs.observe(obs_in, F.count(F.lit(1)).alias("n"), F.count_if(F.col(id_col).isNull()).alias("no_id"))
    loaded = loaded.withColumn(id_col, document_id(id_col, text_col))
    # J1 first: its anti join needs no order, and what is stored already need not be de-duplicated
    new = loaded
    if not fresh:
        named = docs.select(document_id(id_col, text_col).alias(id_col))
        new = skip_existing(loaded, store.known_ids(named, collection, id_col), id_col)
    new = dedupe_first(new, id_col, text_col)
    if by_text:
        new = dedupe_first(new, F.sha1(F.col(text_col)), id_col)
    new = new.observe(obs_new, F.count(F.lit(1)).alias("n"))
    split = {"sentence": sentence_chunks, "window": window_chunks, "token": token_chunks}[chunker]
    chunks = split(new, settings.chunk_size, settings.chunk_overlap, id_col=id_col, text_col=text_col, keep_empty=True)
    renamed = {id_col: "doc_id", text_col: "text"}
    run, _ = store.stage(stored_form(chunks.withColumnsRenamed(renamed)).drop("embedding"), collection,
                         mode="fresh" if fresh else "append", base=base)
    report.docs_loaded = obs_in.get.get("n", 0)
    report.docs_without_id = obs_in.get.get("no_id", 0)
    report.docs_new = obs_new.get.get("n", 0)
    report.docs_skipped = report.docs_loaded - report.docs_new
    _embed_and_store(store, collection, run, embedder, settings, report)
    if len(store.manifest(collection)["entries"]) > MAX_COMMITS:
        store.compact(collection)
    VectorIndex(store, collection).update()
    report.seconds = time.monotonic() - t0
    return report


def _vectors(staged: DataFrame, embedder, settings: Settings) -> DataFrame:
    if embedder is None:
        return hash_embed(staged, "text", "embedding", settings.hash_dim).withColumn(
            "embed_error", F.lit(None).cast("string"))
    return embed(staged, embedder, "text", "embedding", settings.embed_batch, settings.retry_max,
                 settings.retry_base_delay, concurrency=settings.embed_concurrency)


def _embed_and_store(store: CollectionStore, collection: str, run: str, embedder, settings: Settings,
                     report: IngestReport) -> None:
    """Embed a staged run, put its chunks into the collection and clear the stage, in this order."""
    if not store.is_committed(collection, run):
        note = store.staged_note(collection, run)
        rows = store.staged(collection, run)  # a row with a null chunk_id: a document without chunks
        obs = Observation()
        vectors = _vectors(rows.where("chunk_id is not null"), embedder, settings).observe(
            obs, F.count(F.lit(1)).alias("n"), F.count_if(F.col("embedding").isNull()).alias("failed"))
        # one pass over the vectors: written to a second staging run, then split
        _, written = store.stage(vectors, collection, run_id=f"{run}-vectors")
        ok, bad = quarantine(written)
        counts = obs.get
        if counts.get("failed", 0):
            store.quarantine(bad, collection, run)
        _commit(store, collection, run, note, ok.drop("embed_error"), rows.select("doc_id"))
        report.chunks += counts.get("n", 0)
        report.chunks_failed += counts.get("failed", 0)
    store.clear_stage(collection, f"{run}-vectors")
    store.clear_stage(collection, run)


def _commit(store: CollectionStore, collection: str, run: str, note: dict, chunks: DataFrame, ids: DataFrame) -> None:
    """Commit a run's chunks. Documents that others committed since the run looked for stored ids are left
    out, and again whenever somebody else commits first."""
    if note["mode"] == "fresh":
        return store.replace(chunks, collection, ids, run)
    while True:
        state = store.manifest(collection)
        others = store.commits_since(collection, note["base"])
        left, left_ids = chunks, ids
        if others:
            theirs = store.known_ids(ids, collection, commits=others)
            left, left_ids = (skip_existing(x, theirs) for x in (chunks, ids))
        try:
            return store.append(left, collection, left_ids, run, expected=state["version"])
        except CommitConflict:
            continue


def retry_failed(store: CollectionStore, collection: str, embedder=None, settings: Settings = Settings()) -> int:
    """Re-embed quarantined chunks (Q2 fixed); returns how many are now stored."""
    failed = store.quarantined(collection)
    if failed is None:
        return 0
    failed = failed.drop("embedding", "embed_error").dropDuplicates(["chunk_id"])
    stored = store.read(collection)
    if stored is not None:  # chunks of an earlier retry that died before it was done
        failed = failed.join(stored.select("chunk_id"), "chunk_id", "left_anti")
    run, _ = store.stage(failed, collection, base=store.version(collection))
    # the quarantine goes only when its chunks are staged; chunks that fail again come back to it
    store.clear_quarantine(collection)
    report = IngestReport(collection)
    _embed_and_store(store, collection, run, embedder, settings, report)
    VectorIndex(store, collection).update()
    return report.chunks - report.chunks_failed
