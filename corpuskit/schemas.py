"""

Tables are wide where the reference keeps free-form dicts: per-source metadata lives in
typed columns on the way in and is folded into ``metadata MAP<STRING,STRING>`` at the
store, because a map lets collections of different sources share one dataset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

S = T.StringType()
META = T.MapType(S, S)

DOCUMENTS = T.StructType([
    T.StructField("doc_id", S), T.StructField("text", S), T.StructField("source_type", S),
    T.StructField("metadata", META),
])

MAIL_FIELDS = T.StructType([T.StructField(n, S) for n in (
    "source_type", "message_id", "subject", "from_addr", "from_name", "to_addr", "date", "folder")])
FILE_FIELDS = T.StructType([T.StructField(n, S) for n in ("source_type", "file_path", "page")])
WEB_FIELDS = T.StructType([T.StructField(n, S) for n in ("source_type", "url", "slug", "title")])

# What a collection stores of a chunk, whatever its source: the one schema of all files of the store.
STORED = T.StructType([
    T.StructField("doc_id", S), T.StructField("chunk_id", S), T.StructField("chunk_index", T.IntegerType()),
    T.StructField("n_chunks", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()),
    T.StructField("prev_chunk_id", S), T.StructField("next_chunk_id", S), T.StructField("text", S),
    T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("metadata", META),
])

QUESTIONS = T.StructType([
    T.StructField("question_id", T.LongType()), T.StructField("question", S),
    T.StructField("collection", S), T.StructField("top_k", T.IntegerType()), T.StructField("model", S),
])

SOURCE = T.StructType([
    T.StructField("rank", T.IntegerType()), T.StructField("score", T.DoubleType()),
    T.StructField("doc_id", S), T.StructField("metadata", META), T.StructField("text", S),
])
ANSWERS = T.StructType([
    T.StructField("question_id", T.LongType()), T.StructField("answer", S),
    T.StructField("sources", T.ArrayType(SOURCE)), T.StructField("tokens_used", T.LongType()),
])

MESSAGES = T.ArrayType(T.StructType([T.StructField("role", S), T.StructField("content", S)]))

TOKEN_EVENTS = T.StructType([
    T.StructField("response_id", S), T.StructField("model", S), T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()), T.StructField("delta", S),
])

MODEL_STATS = T.StructType([
    T.StructField("model", S), T.StructField("runs", T.LongType()), T.StructField("avg_ttft_ms", T.DoubleType()),
])


def check(df: DataFrame, schema: T.StructType, required=None) -> DataFrame:
    """Raise unless ``df`` has the ``required`` fields of ``schema`` (all by default)
    with the same types; extra columns are allowed. Returns ``df``."""
    have = {f.name: f.dataType for f in df.schema.fields}
    names = list(required) if required is not None else [f.name for f in schema.fields]
    want = {f.name: f.dataType for f in schema.fields}
    missing = [n for n in names if n not in have]
    if missing:
        raise ValueError(f"missing columns {missing}")
    wrong = [n for n in names if have[n] != want[n]]
    if wrong:
        raise TypeError("wrong column types: " + ", ".join(f"{n} {have[n].simpleString()} != "
                                                        f"{want[n].simpleString()}" for n in wrong))
    return df
