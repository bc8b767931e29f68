"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole given tables. Column names and types match the DuckDB statements in
``corpuskit.plans.oracle``; long texts are compared through their sha1.
"""

from __future__ import annotations

import contextlib
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskit.config import LOCAL_CONTEXT_WINDOW, REPLY_RESERVE_TOKENS, Settings
from corpuskit.functions.html import html_text, html_title
from corpuskit.functions.ids import file_doc_id, page_label
from corpuskit.functions.tokens import Subwords
from corpuskit.functions.text import canonical_collection, clip_snippet, source_kind, source_label
from corpuskit.operators.chunking import merge_metadata, sentence_chunks, token_chunks, window_chunks
from corpuskit.operators.dedupe import dedupe_first, skip_existing
from corpuskit.operators.embedding import embed, hash_embed, quarantine
from corpuskit.operators.latency import (first_token_latency, model_latency, model_latency_exact,
                                         models_with_stats, cumulative_text)
from corpuskit.operators.prompts import answer_batch, answer_stream, build_prompts, chat_messages
from corpuskit.operators.report import ingest_report
from corpuskit.operators.search import approx_top_k, exact_top_k, ivf_from_centroids
from corpuskit.operators.vector_index import VectorIndex
from corpuskit.session import cut_lineage, passing_path, ship_package, spread
from corpuskit.store import CollectionStore
from corpuskit.plans.ask import ask
from corpuskit.plans.ingest import ingest
from corpuskit.plans.fixtures import mime_mail_from_turns, raw_mail_from_turns
from corpuskit.sources import registry
from corpuskit.sources.mail import list_folders, parse_mail, read_mbox, select_mail, write_mbox
from corpuskit.sources.web import extract_links, read_pages
from corpuskit.streaming.ingest import stream_documents, stream_ingest
from corpuskit.streaming.state import LatencyTable, stream_cumulative_text, stream_latency_table

MAIL_FOLDERS = ["user", "assistant", "system", "archive", "Sent"]
LINK_PATTERN = r"^/[^/]+$"
HASH_DIM = 64
TOP_K = 5
PROMPT_K = 8


def table(spark: SparkSession, sf_dir: str, name: str, row_local: bool = False) -> DataFrame:
    """Scan a driver table. ``row_local``: CPU-heavy row-local work (regex, hashing,
    parsing) follows the scan with no shuffle in between, so spread a scan with fewer
    splits than task slots (a no-op on large inputs)."""
    ship_package(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if row_local else df


def _sha(c) -> F.Column:
    return F.sha1(F.col(c) if isinstance(c, str) else c)


# ------------------------------------------------------------------ documents

def q_dedupe_first_text(spark, d):
    docs = table(spark, d, "documents")
    return dedupe_first(docs, F.sha1("text"), "doc_id", order_is_unique=True).select(
        "doc_id", "lang", "source", "n_chars", _sha("text").alias("text_sha1"))


def q_skip_existing(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return skip_existing(docs, labels, "doc_id").select("doc_id", "lang", "source", "n_chars")


def q_file_doc_ids(spark, d):
    # documents stand for files: path = source, page = doc_id (0 reads as no page)
    docs = table(spark, d, "documents", row_local=True)
    label = page_label(F.col("doc_id"))
    return docs.select("doc_id", file_doc_id(F.col("source"), label, F.col("text")).alias("file_doc_id"),
                       label.alias("page"))


def q_ingest_report(spark, d):
    return ingest_report(table(spark, d, "documents"), table(spark, d, "labels"))


def _chunks(spark, d):
    return window_chunks(table(spark, d, "documents", row_local=True))


def q_window_chunks(spark, d):
    return _chunks(spark, d).select("chunk_id", "doc_id", "chunk_index", "n_chunks", "n_tokens",
                                    _sha("text").alias("text_sha1"))


def q_sentence_chunks(spark, d):
    return sentence_chunks(table(spark, d, "documents", row_local=True)).select(
        "chunk_id", "doc_id", "chunk_index", "n_chunks", "n_tokens", _sha("text").alias("text_sha1"))


def q_token_chunks(spark, d):
    """Of each document: its sub-word tokens as its chunks hold them, and whether no chunk has more than 512, each
    has the tokens that it states, and together they hold all without a gap."""
    rule = Subwords()
    chunks = token_chunks(table(spark, d, "documents", row_local=True), rule=rule, places=True)
    behind = F.col("token_start") + F.col("n_tokens")
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    return (chunks.withColumn("_from", F.coalesce(F.lag(behind).over(w), F.lit(0)))
            .groupBy("doc_id").agg(F.max(behind).cast("bigint").alias("n_tokens"),
                                   F.every(F.col("n_tokens").between(1, 512)).alias("within"),
                                   F.every(rule.count("text") == F.col("n_tokens")).alias("counted"),
                                   F.every((F.col("token_start") <= F.col("_from")) & (behind > F.col("_from"))).alias("whole")))


def q_chunk_neighbours(spark, d):
    return _chunks(spark, d).select("chunk_id", "prev_chunk_id", "next_chunk_id")


def q_merge_metadata(spark, d):
    ch = _chunks(spark, d)
    parent = F.create_map(F.lit("source_type"), F.lit("document"), F.lit("file_path"), F.col("source"),
                          F.lit("lang"), F.col("lang"))
    own = F.create_map(F.lit("chunk_index"), F.col("chunk_index").cast("string"),
                       F.lit("source_type"), F.lit("chunk"))
    merged = ch.select("chunk_id", merge_metadata(parent, own, F.col("doc_id")).alias("m"))
    return merged.select("chunk_id", F.explode("m").alias("key", "value"))


# ------------------------------------------------------------------ web pages

def q_page_title(spark, d):
    return table(spark, d, "pages", row_local=True).select("page_id", html_title(F.col("html")).alias("title"))


def q_page_text(spark, d):
    t = table(spark, d, "pages", row_local=True).select("page_id", html_text(F.col("html")).alias("t"))
    return t.select("page_id", _sha("t").alias("text_sha1"), F.length("t").cast("bigint").alias("n_chars"))


def q_page_documents(spark, d):
    return read_pages(table(spark, d, "pages", row_local=True)).select(
        "page_id", "doc_id", "slug", "title", _sha("text").alias("text_sha1"))


def q_page_links(spark, d):
    return extract_links(table(spark, d, "pages"), pattern=LINK_PATTERN)


def q_first_links(spark, d):
    return extract_links(table(spark, d, "pages"), pattern=LINK_PATTERN, limit=3)


# ------------------------------------------------------------------ mail

def _raw_mail(spark, d):
    # the mail parse (Python, row-local) follows this scan without a shuffle
    return raw_mail_from_turns(table(spark, d, "conversations", row_local=True))


def _known_mail_ids(spark, d):
    conv, labels = table(spark, d, "conversations"), table(spark, d, "labels")
    stored = conv.join(labels.select(F.col("doc_id").alias("conv_id")).distinct(), "conv_id", "left_semi")
    return stored.select(F.concat(F.lit("<"), F.col("conv_id").cast("string"), F.lit("."),
                                  F.col("turn").cast("string"), F.lit("@example.org>")).alias("doc_id"))


def q_mail_documents(spark, d):
    docs = parse_mail(_raw_mail(spark, d))
    return docs.select("doc_id", "message_id", "subject", "from_addr", "from_name", "to_addr", "date", "folder",
                       _sha("text").alias("text_sha1"))


def q_mbox_documents(spark, d):
    """S1 + S2 + K5: the raw mail written as mbox text files into a fresh folder under the
    checkpoint directory, scanned back with the splittable mbox reader and parsed."""
    import uuid

    raw = raw_mail_from_turns(table(spark, d, "conversations", row_local=True), extra_folder=None)
    path = passing_path(spark, f"mbox-{uuid.uuid4().hex[:12]}")
    write_mbox(raw, path)
    docs = parse_mail(read_mbox(spark, path))
    return docs.select("doc_id", "subject", "folder", _sha("text").alias("text_sha1"))


def q_mime_documents(spark, d):
    """Encoded words, transfer encodings, unknown charsets, alternatives, attachments."""
    docs = parse_mail(mime_mail_from_turns(table(spark, d, "conversations", row_local=True)))
    return docs.select("doc_id", "subject", "from_name", "from_addr", "folder", _sha("text").alias("text_sha1"))


def q_text_file_documents(spark, d):
    """Benchmark texts as files of a directory tree, read back by the text source."""
    import uuid

    path = passing_path(spark, f"files-{uuid.uuid4().hex[:12]}")
    table(spark, d, "benchmark").select("item_id", F.col("text").alias("value")).where("value is not null").write.partitionBy(
        "item_id").text(path)
    docs = registry.load(spark, "text", path=path)
    named = F.regexp_extract("file_path", r"item_id=(\d+)", 1).cast("bigint")
    own_id = F.sha1(F.concat(F.col("file_path"), F.lit("||"), _sha("text")))
    return docs.select(named.alias("item_id"), _sha("text").alias("text_sha1"), "page", "source_type",
                       (F.col("doc_id") == own_id).alias("id_is_of_path_and_text"))


class RefusesT:
    """Test embedder: refuses a batch in which a text begins with T."""

    def __call__(self, texts):
        if any(t.startswith("T") for t in texts):
            raise ValueError("begins with T")
        return [[float(len(t)), 1.0] for t in texts]


def q_embed_quarantine(spark, d):
    """Every chunk through an embedder that refuses some; what failed is kept with its reason."""
    chunks = _chunks(spark, d).select("chunk_id", "text")
    ok, bad = quarantine(cut_lineage(embed(chunks, RefusesT()).drop("text")))
    return ok.select("chunk_id", F.element_at("embedding", 1).cast("bigint").alias("n_chars"), F.lit(None).cast("string").alias("error")) \
        .unionByName(bad.select("chunk_id", F.lit(-1).cast("bigint").alias("n_chars"), F.col("embed_error").alias("error")))


def _stream(spark, d, name):
    # a pattern, because a file stream takes the path of a single file for a folder
    return stream_documents(spark, f"{d.rstrip('/')}/{name}.[p]arquet", table(spark, d, name).schema)


def q_stream_ingest(spark, d):
    """S9 + ST1: the documents table as a stream into a fresh store, twice: the second query, which knows
    nothing of the first, adds nothing."""
    import uuid

    store = _fresh_store(spark)
    for _ in range(2):
        stream = _stream(spark, d, "documents").select("doc_id", "text")
        stream_ingest(stream, store, "documents", passing_path(spark, f"ck-{uuid.uuid4().hex[:12]}"), chunker="window").awaitTermination()
    return store.read("documents").select("doc_id", "chunk_id", F.col("n_tokens").cast("bigint").alias("n_tokens"))


def q_stream_latency(spark, d):
    """ST2: the events as a stream, folded into the table of running means."""
    import uuid

    root = passing_path(spark, f"latency-{uuid.uuid4().hex[:12]}")
    stream_latency_table(_stream(spark, d, "events"), root, f"{root}/checkpoint", model="event_type", value="value").awaitTermination()
    return LatencyTable(spark, root).read()


def q_stream_text(spark, d):
    """ST3: the turns of all conversations as deltas of a stream; the text so far after each."""
    import uuid

    root = passing_path(spark, f"text-{uuid.uuid4().hex[:12]}")
    texts = stream_cumulative_text(_stream(spark, d, "conversations"), response="conv_id", seq="turn", delta="text")
    texts.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option(
        "checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("response_id string, seq bigint, text_so_far string").parquet(f"{root}/out")
    return out.select(F.col("response_id").cast("bigint").alias("conv_id"), F.col("seq").alias("turn"),
                      F.length("text_so_far").cast("bigint").alias("cum_chars"), _sha("text_so_far").alias("cum_sha1"))


def _mail_select(spark, d, limit):
    out = select_mail(_raw_mail(spark, d), MAIL_FOLDERS, limit=limit, existing=_known_mail_ids(spark, d))
    return out.select("doc_id", "folder", "seq", "subject", _sha("text").alias("text_sha1"))


def q_mail_select(spark, d):
    return _mail_select(spark, d, None)


def q_mail_newest(spark, d):
    return _mail_select(spark, d, 50)


def q_mail_folders(spark, d):
    return list_folders(_raw_mail(spark, d))


# ------------------------------------------------------------------ vectors and search

def q_hash_embed(spark, d):
    docs = table(spark, d, "documents", row_local=True).select("doc_id", "text")
    v = hash_embed(docs, "text", "v", HASH_DIM, as_float=False)
    return (v.select("doc_id", F.posexplode_outer("v").alias("bucket", "w")).where(F.col("w") > 0)
             .select("doc_id", "bucket", F.round("w", 6).alias("weight")))


def _questions(spark, d):
    b = table(spark, d, "benchmark")
    return hash_embed(b.select(F.col("item_id").alias("question_id"), F.col("text").alias("question")),
                      "question", "embedding", HASH_DIM, as_float=False)


def _ranked_out(hits):
    return hits.select("question_id", "rank", "vec_id", F.round("distance", 6).alias("distance"),
                       F.round("score", 6).alias("score"))


def q_exact_top_k(spark, d):
    hits = exact_top_k(_questions(spark, d), table(spark, d, "embeddings"), TOP_K,
                       c_id="vec_id", c_vec="embedding")
    return _ranked_out(hits)


def vector_questions(spark, d):
    """Every stored vector whose id is divisible by 50, as a question against all of them."""
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(
        F.col("vec_id").alias("question_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def label_centroids(spark, d):
    """One mean vector for each label (labels x dimensions numbers: the cell table of the index)."""
    parts = table(spark, d, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    rows = parts.groupBy("label", "i").agg(F.avg("x").alias("m")).orderBy("label", "i").toPandas()
    return rows.pivot(index="label", columns="i", values="m").to_numpy()


def q_approx_top_k(spark, d):
    index = ivf_from_centroids(table(spark, d, "embeddings"), label_centroids(spark, d), c_id="vec_id")
    return _ranked_out(approx_top_k(vector_questions(spark, d), index, TOP_K, n_probe=8))


def corpus_chunks(spark, d):
    """Documents de-duplicated by text, window-chunked and hash-embedded."""
    docs = table(spark, d, "documents")
    uniq = dedupe_first(docs, F.sha1("text"), "doc_id", order_is_unique=True)
    return hash_embed(window_chunks(uniq), "text", "embedding", HASH_DIM, as_float=False)


def _retrieve(spark, d, k):
    chunks = corpus_chunks(spark, d)
    # The hits (questions x k rows) are read twice below: checkpointed once into the
    # shared checkpoint folder instead of running the search twice.
    hits = cut_lineage(exact_top_k(_questions(spark, d), chunks, k))
    # Late materialisation: only documents that own a hit are re-chunked for text and
    # metadata. The hits were written out, so Spark knows their size and broadcasts their ids
    # only if they are small; a hit's document is a dedupe winner.
    hit_docs = hits.select(F.element_at(F.split("chunk_id", "#"), 1).cast("bigint").alias("doc_id")).distinct()
    owners = table(spark, d, "documents").join(hit_docs, "doc_id", "left_semi")
    meta = F.create_map(F.lit("source_type"), F.lit("document"), F.lit("file_path"), F.col("source"))
    info = window_chunks(owners).select("chunk_id", "doc_id", "text", "n_tokens", meta.alias("metadata"))
    return hits.join(info, "chunk_id")


def q_retrieve_sources(spark, d):
    hits = _retrieve(spark, d, TOP_K)
    return hits.select("question_id", "rank", "chunk_id", "doc_id",
                       F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"),
                       source_label(F.col("metadata"), F.col("score")).alias("label"),
                       clip_snippet(F.col("text")).alias("snippet"))


def _prompts(spark, d):
    hits = _retrieve(spark, d, PROMPT_K)
    qs = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return build_prompts(hits, qs, LOCAL_CONTEXT_WINDOW - REPLY_RESERVE_TOKENS)


def q_build_prompts(spark, d):
    return _prompts(spark, d).select("question_id", F.col("n_chunks").cast("bigint").alias("n_chunks"),
                                     "context_tokens", _sha("prompt").alias("prompt_sha1"),
                                     F.length("prompt").cast("bigint").alias("prompt_chars"))


CHARGED_BUDGET = 160


def q_charged_prompts(spark, d):
    """The first turn of each conversation as the question, the others in order as passages with metadata, packed so
    that the whole prompt keeps to the budget."""
    turns = table(spark, d, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    ranked = turns.withColumn("rank", F.row_number().over(order) - 1).withColumn("text", F.coalesce("text", F.lit("")))
    questions = ranked.where("rank = 0").select("conv_id", F.col("text").alias("question"))
    passages = ranked.where("rank > 0").select(
        "conv_id", "rank", "text", F.lit(0).alias("n_tokens"),
        F.create_map(F.lit("role"), F.col("role"), F.lit("turn"), F.col("turn").cast("string")).alias("metadata"))
    return build_prompts(passages, questions, CHARGED_BUDGET, q_id="conv_id", meta_col="metadata", counter=Subwords()).select(
        "conv_id", F.col("n_chunks").cast("bigint").alias("n_chunks"), F.col("n_dropped").cast("bigint").alias("n_dropped"),
        "context_tokens", F.col("prompt_tokens").cast("bigint").alias("prompt_tokens"), _sha("prompt").alias("prompt_sha1"))


class LengthCompleter:
    """Test completer: answers ``len=<characters of the prompt>``."""

    def __call__(self, prompts):
        return [f"len={len(p)}" for p in prompts]


def q_answer_batch(spark, d):
    return answer_batch(_prompts(spark, d), LengthCompleter()).select("question_id", "answer")


# ------------------------------------------------------------------ chat and latency

class LastWordsGenerator:
    """Test generator: streams the last message of a chat, word by word, each with its blanks."""

    def __call__(self, messages):
        yield from re.findall(r"[^ ]* *", messages[-1]["content"])


def q_token_stream(spark, d):
    """X4 into W3 and A4: a token stream for each conversation; the whole text put together from its deltas,
    and whether a first token was timed where there is one."""
    chats = chat_messages(table(spark, d, "conversations")).withColumn("model", F.lit("words"))
    tokens = cut_lineage(answer_stream(chats, LastWordsGenerator(), response="conv_id", prompt_col="messages", model="model"))
    whole = cumulative_text(tokens, response="conv_id", final_only=True)
    timed = first_token_latency(tokens.where("not is_final"), response="conv_id", start="start", model="model")
    ends = tokens.where("is_final and error is null").select("conv_id", F.col("seq").alias("n_deltas"))
    return (ends.join(whole, "conv_id", "left").join(timed, "conv_id", "left")
            .select("conv_id", "n_deltas", F.sha1(F.coalesce("text", F.lit(""))).alias("text_sha1"),
                    F.coalesce(F.col("ttft_ms") >= 0, F.lit(False)).alias("timed")))


def q_chat_messages(spark, d):
    m = chat_messages(table(spark, d, "conversations"))
    transcript = F.array_join(F.transform("messages", lambda s: F.concat(s["role"], F.lit(": "), s["content"])), "\n")
    return m.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"), F.sha1(transcript).alias("transcript_sha1"))


def q_cumulative_text(spark, d):
    c = table(spark, d, "conversations")
    out = cumulative_text(c, response="conv_id", seq="turn", delta="text")
    return out.select("conv_id", "turn", F.length("text_so_far").cast("bigint").alias("cum_chars"),
                      _sha("text_so_far").alias("cum_sha1"))


def _token_events(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id"), F.col("ts"),
                    F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.col("event_type")).alias("delta"))


def q_first_token_latency(spark, d):
    return first_token_latency(_token_events(spark, d), response="user_id").select("user_id", "n_events", "ttft_ms")


def q_model_latency(spark, d):
    e = table(spark, d, "events")
    return model_latency(e, model="event_type", value="value", order=("ts", "event_id"))


def q_model_latency_exact(spark, d):
    e = table(spark, d, "events")
    out = model_latency_exact(e, model="event_type", value="value")
    return out.select("model", "runs", F.round("avg_ttft_ms", 6).alias("avg_ttft_ms"))


def q_models_with_stats(spark, d):
    part, e = table(spark, d, "part"), table(spark, d, "events")
    models = part.select(F.concat(F.lit("model-"), F.col("p_partkey").cast("string")).alias("name"),
                         (F.round(F.col("p_retailprice") * F.lit(1e7)).cast("bigint") + F.col("p_partkey")).alias("size_bytes"))
    samples = e.select(F.concat(F.lit("model-"), F.col("user_id").cast("string")).alias("model"), "ts", "event_id",
                       F.col("value").alias("ttft_ms"))
    stats = model_latency(samples, model="model", value="ttft_ms", order=("ts", "event_id"))
    return models_with_stats(models, stats)


# ------------------------------------------------------------------ collections

def q_stored_doc_ids(spark, d):
    """K1 + S8 + K3/K4 through the real store: chunks of every document are written into
    a fresh store (collection = source) under the checkpoint folder, then the distinct
    stored ids are read back."""
    import uuid

    docs = table(spark, d, "documents", row_local=True).select(
        F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("source").alias("collection"))
    store = CollectionStore(spark, passing_path(spark, f"store-{uuid.uuid4().hex[:12]}"))
    store.append_many(window_chunks(docs).select("collection", "doc_id", "chunk_id", "chunk_index", "text"))
    return store.stored_ids()


def _fresh_store(spark):
    import uuid

    return CollectionStore(spark, passing_path(spark, f"store-{uuid.uuid4().hex[:12]}"))


def q_ingest_documents(spark, d):
    """The whole ingest job into a fresh store, twice: the second run must add nothing. What is stored is
    read back."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    store = _fresh_store(spark)
    for _ in range(2):
        ingest(docs, store, "documents", chunker="window")
    return store.read("documents").select("doc_id", "chunk_id", F.col("n_tokens").cast("bigint").alias("n_tokens"))


def q_stored_metadata(spark, d):
    """Documents and web pages ingested into one store: each collection's metadata, key by key."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang",
                                               F.col("source").alias("file_path"), F.lit("document").alias("source_type"))
    store = _fresh_store(spark)
    ingest(docs, store, "documents", chunker="window")
    pages = read_pages(table(spark, d, "pages", row_local=True)).select("doc_id", "text", "slug", "title", "source_type")
    ingest(pages, store, "paulgraham", chunker="window")
    both = store.read("documents").unionByName(store.read("paulgraham"))
    return both.select("collection", "doc_id", F.explode("metadata").alias("key", "value")).distinct()


class _LosesOnePublish(CollectionStore):
    """A store whose first commit is lost after its folders are written, as if the job had died there."""

    lost = False

    def _publish(self, *args, **kwargs):
        if not self.lost:
            self.lost = True
            raise ConnectionError("lost before the commit")
        return super()._publish(*args, **kwargs)


def q_ingest_resume(spark, d):
    """K6 over the commit log: an ingest of all documents that dies before its commit is finished by the next
    call, from its stage; a third call adds nothing; then the commits are compacted, and the folders that no
    manifest names are deleted."""
    import uuid

    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    store = _LosesOnePublish(spark, passing_path(spark, f"store-{uuid.uuid4().hex[:12]}"), small_index=0)
    with contextlib.suppress(ConnectionError):
        ingest(docs, store, "documents", chunker="window")
    second, third = (ingest(docs, store, "documents", chunker="window") for _ in range(2))
    pages = read_pages(table(spark, d, "pages", row_local=True)).select("doc_id", "text")
    ingest(pages, store, "documents", chunker="window")
    store.compact("documents")
    store.vacuum("documents")
    seen = F.lit(f"{second.resumed_run is not None},{second.docs_new},{third.docs_new},{len(store.manifest('documents')['entries'])}")
    return store.read("documents").groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), F.sum("n_tokens").cast("bigint").alias("n_tokens")).withColumn("seen", seen)


def _chunk_store(spark, d):
    """Documents with different texts, window-chunked, embedded and stored."""
    store = _fresh_store(spark)
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    ingest(docs, store, "documents", chunker="window", by_text=True)
    return store


def q_ask_documents(spark, d):
    """``ask`` over a stored collection: every benchmark text a question, eight sources each, the local
    model's budget; the answer and the sources in their order."""
    store = _chunk_store(spark, d)
    qs = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    out = ask(qs, store, "documents", completer=LengthCompleter(), settings=Settings(top_k=PROMPT_K), local_model=True)
    return out.select("question_id", "answer", "answer_error", F.size("sources").alias("n_sources"),
                      F.array_join(F.transform("sources", lambda s: s["chunk_id"]), ",").alias("sources"))


INDEX_SHARE = 0.25


def q_indexed_top_k(spark, d):
    """V3 over the stored index: every benchmark text against all chunks of the collection.
    ``recall_reached``: at least 0.9 of the exact five nearest were found; ``share_kept``: a question's
    probed cells hold at most a quarter of the rows."""
    store = _chunk_store(spark, d)
    index = VectorIndex(store, "documents")
    index.build()
    questions = cut_lineage(_questions(spark, d).select("question_id", "embedding"))
    hits = cut_lineage(index.search(questions, TOP_K, share=INDEX_SHARE))
    exact = exact_top_k(questions, store.read("documents"), TOP_K).select("question_id", "chunk_id")
    found = exact.join(hits.select("question_id", "chunk_id", F.lit(1).alias("hit")), ["question_id", "chunk_id"], "left")
    recall = found.agg((F.sum(F.coalesce("hit", F.lit(0))) >= F.lit(0.9) * F.count("*")).alias("ok")).first()["ok"]
    n_chunks = store.read("documents").count()
    probed = index.probes(questions, TOP_K, INDEX_SHARE).groupBy("qid").agg(F.sum("n").alias("n"))
    kept = probed.agg((F.max("n") <= F.lit(INDEX_SHARE * n_chunks)).alias("ok")).first()["ok"]
    return hits.groupBy("question_id").agg(F.count("*").alias("n_hits")).withColumns(
        {"recall_reached": F.lit(bool(recall)), "share_kept": F.lit(bool(kept))})


def q_list_collections(spark, d):
    """K3 through the store: documents appended under their sources, then the names and their ids."""
    docs = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit("x").alias("text"),
        canonical_collection(F.col("source")).alias("collection"))
    store = _fresh_store(spark)
    store.append_many(docs)
    ids = store.stored_ids().groupBy("collection").agg(F.count("*").alias("n_documents"))
    return ids.where(F.col("collection").isin(store.list_collections()))


def q_canonical_collection(spark, d):
    # roles stand for the spellings that users type, too: each alias of a collection occurs
    spelled = F.when(F.col("role") == "user", "Email").when(F.col("role") == "assistant", "PG").otherwise("Paul_Graham")
    names = (table(spark, d, "documents").select(F.col("source").alias("name"))
             .unionByName(table(spark, d, "conversations").select(F.explode(F.array(
                 F.col("role"), spelled)).alias("name"))).distinct())
    return names.select("name", canonical_collection(F.col("name")).alias("collection"),
                        source_kind(F.col("name")).alias("kind"))


QUERIES = {
    "dedupe_first_text": q_dedupe_first_text,
    "skip_existing": q_skip_existing,
    "file_doc_ids": q_file_doc_ids,
    "ingest_report": q_ingest_report,
    "window_chunks": q_window_chunks,
    "sentence_chunks": q_sentence_chunks,
    "token_chunks": q_token_chunks,
    "chunk_neighbours": q_chunk_neighbours,
    "merge_metadata": q_merge_metadata,
    "page_title": q_page_title,
    "page_text": q_page_text,
    "page_documents": q_page_documents,
    "page_links": q_page_links,
    "first_links": q_first_links,
    "mail_documents": q_mail_documents,
    "mbox_documents": q_mbox_documents,
    "mime_documents": q_mime_documents,
    "text_file_documents": q_text_file_documents,
    "embed_quarantine": q_embed_quarantine,
    "stream_ingest": q_stream_ingest,
    "stream_latency": q_stream_latency,
    "stream_text": q_stream_text,
    "mail_select": q_mail_select,
    "mail_newest": q_mail_newest,
    "mail_folders": q_mail_folders,
    "hash_embed": q_hash_embed,
    "exact_top_k": q_exact_top_k,
    "approx_top_k": q_approx_top_k,
    "retrieve_sources": q_retrieve_sources,
    "build_prompts": q_build_prompts,
    "charged_prompts": q_charged_prompts,
    "answer_batch": q_answer_batch,
    "chat_messages": q_chat_messages,
    "cumulative_text": q_cumulative_text,
    "token_stream": q_token_stream,
    "first_token_latency": q_first_token_latency,
    "model_latency": q_model_latency,
    "model_latency_exact": q_model_latency_exact,
    "models_with_stats": q_models_with_stats,
    "ingest_documents": q_ingest_documents,
    "ingest_resume": q_ingest_resume,
    "ask_documents": q_ask_documents,
    "indexed_top_k": q_indexed_top_k,
    "stored_metadata": q_stored_metadata,
    "stored_doc_ids": q_stored_doc_ids,
    "list_collections": q_list_collections,
    "canonical_collection": q_canonical_collection,
}
