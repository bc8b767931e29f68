"""The question job (V4 + A5 + P1 + P2): a whole table of questions in one plan.

``questions(question_id, question[, model]) -> embed with the ingest embedder -> top-k
over the collection -> ranked sources -> prompts -> answers``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.config import Settings
from corpuskit.functions.text import canonical_collection, clip_snippet, default_score, source_label
from corpuskit.functions.tokens import Subwords
from corpuskit.operators.embedding import embed, hash_embed
from corpuskit.operators.prompts import answer_batch, build_prompts, context_budget
from corpuskit.operators.search import answer_sources, exact_top_k
from corpuskit.operators.vector_index import VectorIndex
from corpuskit.session import cut_lineage
from corpuskit.store import CollectionStore


def _metadata(chunks: DataFrame) -> F.Column:
    if "metadata" in chunks.columns:
        return F.col("metadata")
    keys = [c for c in ("source_type", "file_path", "page", "url", "slug", "title", "message_id", "subject",
                        "from_addr", "from_name", "to_addr", "date", "folder") if c in chunks.columns]
    pairs = []
    for k in keys:
        pairs += [F.lit(k), F.col(k).cast("string")]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def embed_questions(questions: DataFrame, settings: Settings = Settings(), embedder=None,
                    q_text: str = "question") -> DataFrame:
    """``questions`` with ``embedding`` and ``embed_error``, by the embedder of the ingest."""
    if embedder is None:
        return hash_embed(questions, q_text, "embedding", settings.hash_dim, as_float=False).withColumn(
            "embed_error", F.lit(None).cast("string"))
    return embed(questions, embedder, q_text, "embedding", settings.embed_batch, settings.retry_max,
                 settings.retry_base_delay)


def retrieve(questions: DataFrame, chunks: DataFrame, settings: Settings = Settings(), embedder=None,
             index: VectorIndex | None = None, share: float = 0.2, q_text: str = "question",
             top_k: int | None = None) -> DataFrame:
    """V4: ranked hits ``question_id, rank, chunk_id, doc_id, score, distance, text,
    n_tokens, metadata, label, snippet`` (k per question). Questions may bring their vectors.
    ``index``: search only cells of this stored index that hold ``share`` of its rows; nothing is trained here.
    The hits are written out once; only their chunks' texts are looked up."""
    qv = questions if "embedding" in questions.columns else embed_questions(questions, settings, embedder, q_text)
    k = top_k or settings.top_k
    if index is not None:
        hits = index.search(qv, k, share)
    else:
        hits = exact_top_k(qv, chunks, k, max_block=settings.max_broadcast_questions)
    hits = cut_lineage(hits)
    info = chunks.select("chunk_id", "doc_id", "text", "n_tokens", _metadata(chunks).alias("metadata"))
    out = hits.join(info, "chunk_id")
    return (out.withColumn("score", default_score(F.col("score")))
               .withColumn("label", source_label(F.col("metadata"), F.col("score")))
               .withColumn("snippet", clip_snippet(F.col("text"), settings.snippet_chars)))


def ask(questions: DataFrame, store: CollectionStore, collection: str = "documents", completer=None,
        settings: Settings = Settings(), embedder=None, approximate: bool = False, local_model: bool = False,
        q_text: str = "question", share: float = 0.2, counter: Subwords | None = None) -> DataFrame:
    """One row for each question: ``question_id, answer, answer_error, sources, tokens_used`` and the
    prompt (tokens_used stays null). Questions may name their own ``collection``, ``top_k`` and ``model``;
    collection names are canonicalised (T20). A question that cannot be embedded, whose collection holds
    nothing, or that finds nothing has a null prompt and answer and the reason in ``answer_error``.
    Without a completer ``answer`` stays null. ``approximate`` searches collections that have a stored index
    (``VectorIndex(store, name).build()``) by it, others exactly. ``counter`` as in ``build_prompts``: the model's
    window then holds for the whole prompt."""
    own = lambda name, kind: F.col(name).cast(kind) if name in questions.columns else F.lit(None).cast(kind)
    q = questions.select(
        "question_id", F.col(q_text).alias("question"),
        canonical_collection(F.coalesce(own("collection", "string"), F.lit(collection))).alias("collection"),
        F.coalesce(own("top_k", "int"), F.lit(settings.top_k)).alias("top_k"), own("model", "string").alias("model"))
    q = cut_lineage(embed_questions(q, settings, embedder))  # the embedder is called once a question
    # one row for each collection that is asked: no more than there are collections, and names that are not
    asked = q.groupBy("collection").agg(F.max("top_k").alias("k")).where("k > 0")
    stored = store.list_collections()
    found = None
    for row in asked.where(F.col("collection").isin(stored)).collect():
        index = VectorIndex(store, row["collection"]) if approximate else None
        part = retrieve(q.where(F.col("collection") == row["collection"]), store.read(row["collection"]), settings,
                        index=index, share=share, top_k=row["k"])
        found = part if found is None else found.unionByName(part)
    reason = (F.when(F.col("embed_error").isNotNull(), F.col("embed_error"))
              .when(~F.col("collection").isin(stored), F.concat(F.lit("no chunks in collection "), F.col("collection")))
              .otherwise(F.lit("nothing found")))
    if found is None:
        empty = F.lit(None)
        return q.select("question_id", empty.cast("bigint").alias("n_chunks"), empty.cast("string").alias("prompt"),
                        empty.cast("string").alias("answer"), reason.alias("answer_error"),
                        F.array().cast("array<struct<rank:int>>").alias("sources"), empty.cast("bigint").alias("tokens_used"))
    hits = cut_lineage(found.join(q.select("question_id", "top_k"), "question_id").where("rank <= top_k").drop("top_k"))
    budget = q.select("question_id", "question", context_budget(F.col("model"), local_model).alias("_budget"))
    prompts = build_prompts(hits, budget, F.col("_budget"), meta_col="metadata", counter=counter)
    if completer is not None:
        answered = answer_batch(prompts, completer)
    else:
        answered = prompts.withColumn("answer", F.lit(None).cast("string")).withColumn(
            "answer_error", F.lit(None).cast("string"))
    whole = (q.select("question_id", reason.alias("_reason")).join(answered, "question_id", "left")
             .join(answer_sources(hits), "question_id", "left"))
    return whole.withColumn("answer_error", F.when(F.col("prompt").isNull(), F.col("_reason")).otherwise(
        F.col("answer_error"))).drop("_reason").withColumn("tokens_used", F.lit(None).cast("bigint"))
