"""Context budgets, prompt packing, answers in batches and as streams, chat transcripts."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.config import (CONTEXT_WINDOWS, DEFAULT_CONTEXT_WINDOW, DEFAULT_RETRY_BASE_DELAY,
                              DEFAULT_RETRY_MAX, LOCAL_CONTEXT_WINDOW, REPLY_RESERVE_TOKENS)
from corpuskit.functions.tokens import Subwords, chunk_tokens
from corpuskit.operators.embedding import EmbedError, call_with_retry, run_batched, task_pacer

# The layout of a prompt: what was found, then the question.
QA_TEMPLATE = (
    "Use only the passages below to answer; say so if they do not hold the answer.\n\n"
    "=== Passages ===\n"
    "{context}\n"
    "=== Question ===\n"
    "{question}\n"
    "=== Answer ===\n"
)
# Metadata keys never shown to the model for mail chunks.
MAIL_HIDDEN_KEYS = ["message_id", "folder", "source_type"]


def context_budget(model: Column, local: bool = False, windows: dict | None = None) -> Column:
    """Tokens available for context: the model's window less the reply reserve."""
    if local:
        return F.lit(LOCAL_CONTEXT_WINDOW - REPLY_RESERVE_TOKENS)
    win = F.lit(DEFAULT_CONTEXT_WINDOW)
    for name, size in (windows or CONTEXT_WINDOWS).items():
        win = F.when(model == name, F.lit(size)).otherwise(win)
    return win - F.lit(REPLY_RESERVE_TOKENS)


def _shown_text(text: Column, meta: Column | None) -> Column:
    if meta is None:
        return text
    hidden = F.coalesce(meta["source_type"] == "email", F.lit(False))
    shown = F.map_filter(meta, lambda k, v: ~(hidden & k.isin(*MAIL_HIDDEN_KEYS)) & v.isNotNull())
    lines = F.array_join(F.transform(F.map_entries(shown), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return F.when(F.size(shown) > 0, F.concat(lines, F.lit("\n\n"), text)).otherwise(text)


def build_prompts(hits: DataFrame, questions: DataFrame, budget, q_id: str = "question_id",
                  question_col: str = "question", text_col: str = "text", tokens_col: str = "n_tokens",
                  meta_col: str | None = None, template: str = QA_TEMPLATE, counter: Subwords | None = None) -> DataFrame:
    """Pack ranked chunks (best first) into one context per question.

    Chunks are kept while the running token total stays within ``budget`` (an int or a
    column of ``questions``); the first chunk is always kept, cut to the budget. Output:
    ``q_id, n_chunks, n_dropped, context_tokens, prompt``; ``n_dropped`` counts the hits that the
    budget had no room for. Work per question is bounded by k.

    Without a ``counter`` a chunk is charged its ``tokens_col`` and nothing else is. With one, ``budget`` holds for
    the whole prompt: the template and the question are charged first, and each chunk as it is shown,
    with its metadata lines; ``prompt_tokens`` is added, at most ``budget`` unless template and question alone are
    more (then the context is empty).
    """
    q = questions.select(F.col(q_id), F.col(question_col).alias("_question"),
                         (budget if isinstance(budget, Column) else F.lit(int(budget))).alias("_budget"))
    h = hits.join(q, q_id)  # one row per question on the right: a key join, not a fan-out
    w = Window.partitionBy(q_id).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    meta = F.col(meta_col) if meta_col else None
    if counter is None:
        shown = h.withColumn("_cost", F.col(tokens_col))
        cut = F.array_join(F.slice(chunk_tokens(F.col(text_col)), 1, F.col("_budget")), " ")
    else:
        fixed = counter.count(F.lit(template.replace("{context}", " ").replace("{question}", " ")))
        room = F.greatest(F.col("_budget") - fixed - counter.count("_question"), F.lit(0))
        shown = (h.withColumn("_budget", room).withColumn(text_col, _shown_text(F.coalesce(F.col(text_col), F.lit("")), meta))
                  .withColumn("_cost", counter.count(text_col)))
        cut = counter.cut(text_col, F.col("_budget"))
        meta = None
    shown = shown.withColumn("_toks_run", F.sum("_cost").over(w))
    first_cut = F.when(F.col("_cost") > F.col("_budget"), cut).otherwise(F.col(text_col))
    fits = (F.col("rank") == 1) | (F.col("_toks_run") <= F.col("_budget"))
    kept = (shown.withColumn("_fits", fits)
                 .withColumn("_text", F.when(F.col("rank") == 1, first_cut).otherwise(F.col(text_col)))
                 .withColumn("_ntok", F.least(F.col("_cost"), F.col("_budget")))
                 .withColumn("_shown", _shown_text(F.col("_text"), meta)))
    ctx = kept.groupBy(q_id, "_question").agg(
        F.count_if("_fits").alias("n_chunks"), F.count_if(~F.col("_fits")).alias("n_dropped"),
        F.sum(F.when(F.col("_fits"), F.col("_ntok"))).cast("bigint").alias("context_tokens"),
        F.array_sort(F.collect_list(F.when(F.col("_fits"), F.struct("rank", "_shown")))).alias("_parts"))
    context = F.array_join(F.transform(F.col("_parts"), lambda s: s["_shown"]), "\n\n")
    head, rest = template.split("{context}")
    mid, tail = rest.split("{question}")
    prompt = F.concat(F.lit(head), context, F.lit(mid), F.col("_question"), F.lit(tail))
    out = ctx.select(q_id, "n_chunks", "n_dropped", "context_tokens", prompt.alias("prompt"))
    return out if counter is None else out.withColumn("prompt_tokens", counter.count("prompt"))


def answer_batch(prompts: DataFrame, completer, prompt_col: str = "prompt", batch_size: int = 8,
                 max_retries: int = DEFAULT_RETRY_MAX, base_delay: float = DEFAULT_RETRY_BASE_DELAY,
                 sleep=time.sleep, concurrency: int | None = None, rate: float | None = None) -> DataFrame:
    """``completer(list) -> list[str]`` over Arrow batches: of prompts (strings), or of chats when
    ``prompt_col`` holds messages (lists of ``{"role", "content"}``). A null reply becomes ``""``; a
    failure is a row error in ``answer_error`` with a null ``answer``. ``rate`` as in ``embed``."""
    if rate and not concurrency:
        raise ValueError("a rate is shared by a known number of tasks: set concurrency")
    if concurrency:
        prompts = prompts.repartition(concurrency)
    fields = [f for f in prompts.schema.fields if f.name not in ("answer", "answer_error")]
    keep = [f.name for f in fields]
    schema = T.StructType(fields + [T.StructField("answer", T.StringType()),
                                    T.StructField("answer_error", T.StringType())])

    def run(batches):
        call = task_pacer(rate, concurrency)(completer)
        for pdf in batches:
            outs, errs = run_batched([request(v) for v in pdf[prompt_col]], call, batch_size, max_retries, base_delay, sleep)
            res = pdf[keep].copy()
            res["answer"] = [("" if o is None else str(o)) if e is None else None for o, e in zip(outs, errs)]
            res["answer_error"] = errs
            yield res

    return prompts.select(*keep).mapInPandas(run, schema)


def request(value):
    """What a completer gets: the prompt's text, or the messages of a chat as a list of dicts."""
    if value is None or isinstance(value, float):  # a null
        return ""
    if isinstance(value, str):
        return value
    return [{"role": m["role"], "content": m["content"]} for m in value]


STREAM_ROWS = 64  # deltas that a task holds back at most before it hands them on


def answer_stream(prompts: DataFrame, generator, response: str = "response_id", prompt_col: str = "prompt",
                  model: str | None = None, max_retries: int = DEFAULT_RETRY_MAX,
                  base_delay: float = DEFAULT_RETRY_BASE_DELAY, sleep=time.sleep, concurrency: int | None = None,
                  rate: float | None = None) -> DataFrame:
    """A token stream for each prompt (or chat): ``response, model, seq, start, ts, delta, is_final, error``.

    ``generator(request)`` gives the deltas of one answer, in order (None ends it). Each becomes a row as it comes; a task
    hands rows on in small batches and asks the generator for more only when Spark has taken them, so a slow
    reader slows the stream down, and no answer is held whole. Every response ends with a row of its own
    (``is_final``, delta ``""``), which names the error where the stream broke. A stream that fails in a passing
    way before its first delta is asked for again; one that breaks later is not, for its deltas are out.

    The rows are what ``first_token_latency`` (``ts``, ``start``), ``cumulative_text`` (``seq``, ``delta``) and their
    streaming forms take."""
    if rate and not concurrency:
        raise ValueError("a rate is shared by a known number of tasks: set concurrency")
    if concurrency:
        prompts = prompts.repartition(concurrency)
    kind = prompts.schema[response].dataType
    source = prompts.select(F.col(response).alias("r"), (F.col(model) if model else F.lit(None)).cast("string").alias("m"),
                            F.col(prompt_col).alias("p"))
    when = T.TimestampType()
    schema = T.StructType([T.StructField(response, kind), T.StructField("model", T.StringType()), T.StructField("seq", T.LongType()),
                           T.StructField("start", when), T.StructField("ts", when), T.StructField("delta", T.StringType()),
                           T.StructField("is_final", T.BooleanType()), T.StructField("error", T.StringType())])
    names = schema.fieldNames()

    def answer(r, m, p, pace):
        """Rows of one response."""
        seq, start, error = 0, pd.Timestamp.now("UTC"), None

        def begin(req):
            stream = iter(generator(req))
            return stream, next(stream, None)

        try:
            stream, delta = call_with_retry(pace(begin), request(p), max_retries, base_delay, sleep)
            while delta is not None:
                yield r, m, seq, start, pd.Timestamp.now("UTC"), str(delta), False, None
                seq += 1
                delta = next(stream, None)
        except EmbedError as exc:
            error = str(exc)
        except Exception as exc:  # noqa: BLE001 - whatever breaks a stream is its row's error
            error = f"{type(exc).__name__}: {exc}"
        yield r, m, seq, start, pd.Timestamp.now("UTC"), "", True, error

    def run(batches):
        pace = task_pacer(rate, concurrency)
        for pdf in batches:
            held = []
            for r, m, p in zip(pdf["r"], pdf["m"], pdf["p"], strict=True):
                for row in answer(r, m, p, pace):
                    held.append(row)
                    if len(held) >= STREAM_ROWS:
                        yield pd.DataFrame(held, columns=names)
                        held = []
            if held:
                yield pd.DataFrame(held, columns=names)

    return source.mapInPandas(run, schema)


def chat_messages(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """Per conversation, ``messages`` = ordered array<struct<role, content>>
    (null content becomes ``""``). A conversation is one model request, so its size is
    bounded by the model's context."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.col(role).alias("role"),
                                                  F.coalesce(F.col(text), F.lit("")).alias("content"))))
    return (turns.groupBy(conv).agg(packed.alias("_m"))
                 .select(conv, F.transform("_m", lambda s: F.struct(s["role"].alias("role"),
                                                                    s["content"].alias("content"))).alias("messages")))
