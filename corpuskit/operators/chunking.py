"""Split documents into overlapping chunks.

Both chunkers are row-local generators (``posexplode``): no shuffle, the document's
other columns travel with every chunk, and neighbour ids (W4) are plain expressions
because ``chunk_id`` is ``doc_id#index`` and the chunk count is known at generation.

* ``window_chunks`` (G2): fixed windows of ``size`` tokens, step ``size - overlap``;
  tokens are runs of non-whitespace and chunk text is the tokens joined by one space.
* ``sentence_chunks`` (G1): lossless split into paragraphs, sentences, clauses and at
  last words, greedily packed to at most ``size`` tokens with a suffix of the previous
  chunk's pieces (at most ``overlap`` tokens) carried over. The packing is a small
  per-document Python helper run as an Arrow-batched pandas UDF.
* ``token_chunks``: chunks of at most ``size`` sub-word tokens, cut at the strongest break in reach. Tokens
  and breaks of a batch of texts are found at once in numpy; only the cuts are chosen one by one. A text
  without blanks is cut like any other.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.config import DEFAULT_CHUNK_OVERLAP, DEFAULT_CHUNK_SIZE
from corpuskit.functions.ids import chunk_id
from corpuskit.functions.tokens import Subwords, chunk_tokens, let


def _check(size: int, overlap: int):
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("need size > 0 and 0 <= overlap < size")


def window_count(n_tokens: Column, size: int, overlap: int) -> Column:
    step = size - overlap
    return (F.when(n_tokens <= 0, F.lit(0))
            .when(n_tokens <= size, F.lit(1))
            .otherwise(F.ceil((n_tokens - size) / F.lit(step)).cast("int") + 1)).cast("int")


def _with_neighbours(df: DataFrame, id_col: str) -> DataFrame:
    idx, n = F.col("chunk_index"), F.col("n_chunks")
    return (df.withColumn("chunk_id", chunk_id(F.col(id_col), idx))
              .withColumn("prev_chunk_id", F.when(idx > 0, chunk_id(F.col(id_col), idx - 1)))
              .withColumn("next_chunk_id", F.when(idx < n - 1, chunk_id(F.col(id_col), idx + 1))))


def window_chunks(docs: DataFrame, size: int = DEFAULT_CHUNK_SIZE, overlap: int = DEFAULT_CHUNK_OVERLAP,
                  id_col: str = "doc_id", text_col: str = "text", keep_empty: bool = False) -> DataFrame:
    """G2 + W4. Output: the document's columns (``text`` = chunk text) plus
    ``chunk_index, n_chunks, n_tokens, chunk_id, prev_chunk_id, next_chunk_id``. ``keep_empty``: a document
    without a chunk has one row, with null for ``chunk_index`` and ``chunk_id``."""
    _check(size, overlap)
    step = size - overlap

    def pieces(toks):
        n_chunks = window_count(F.size(toks), size, overlap)
        starts = F.when(n_chunks > 0, F.sequence(F.lit(0), n_chunks - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(toks, i * step + 1, size), " "))

    # tokens bound once per row (see tokens.let); the outer generator adds no inferred
    # filter that would re-evaluate the pieces below the projection
    arr = let(chunk_tokens(F.col(text_col)), pieces)
    rest = [c for c in docs.columns if c != text_col]
    out = (docs.select(*rest, arr.alias("_pieces"))
               .select(*rest, F.size("_pieces").alias("n_chunks"),
                       F.posexplode_outer("_pieces").alias("chunk_index", text_col))
               .where(F.lit(keep_empty) | F.col("chunk_index").isNotNull())
               .withColumn("n_tokens", F.size(chunk_tokens(F.col(text_col)))))
    return _with_neighbours(out, id_col)


# ---------------------------------------------------------------- sentence-aware (G1)

# Whitespace is the ASCII set that Java's and RE2's ``\s`` match, so token counts agree
# with the native ``n_tokens`` column and with SQL engines.
_WS = " \t\n\x0b\f\r"
_TOKEN_RE = re.compile(f"[^{_WS}]+")
# Split points, from coarse to fine; a piece ends right after a match.
_LEVELS = [
    re.compile(r"\n\n\n+"),                                          # paragraphs
    re.compile(f"(?:[.!?]+[\"')\\]]*[{_WS}]+|。[{_WS}]*)"),          # sentences
    re.compile(f"[,.;:!?。，；！？]+[{_WS}]*"),                           # clauses
    re.compile(f"[^{_WS}]+[{_WS}]*"),                                   # words
]


def _split_after(text: str, pattern: re.Pattern) -> list:
    cuts = [m.end() for m in pattern.finditer(text) if m.end() < len(text)]
    pieces, start = [], 0
    for c in cuts:
        if c > start:
            pieces.append(text[start:c])
            start = c
    pieces.append(text[start:])
    return [p for p in pieces if p]


def split_units(text: str, size: int, level: int = 0) -> list:
    """Lossless list of (piece, n_tokens), every piece at most ``size`` tokens."""
    n = len(_TOKEN_RE.findall(text))
    if n <= size or level >= len(_LEVELS):
        return [(text, n)]
    out = []
    for piece in _split_after(text, _LEVELS[level]):
        out.extend(split_units(piece, size, level + 1))
    return out


def pack_chunks(text: str, size: int = DEFAULT_CHUNK_SIZE, overlap: int = DEFAULT_CHUNK_OVERLAP) -> list:
    """G1 on one text: list of chunk strings (stripped, non-empty), each <= size tokens."""
    if not text:
        return []
    units = split_units(text, size)
    chunks, cur, cur_n = [], [], 0
    for piece, n in units:
        if cur_n + n > size and cur_n > 0:
            chunks.append("".join(p for p, _ in cur))
            carry, t = [], 0
            for p, m in reversed(cur):
                if t + m > overlap:
                    break
                carry.insert(0, (p, m))
                t += m
            while carry and t + n > size:
                t -= carry[0][1]
                carry.pop(0)
            cur, cur_n = carry, t
        cur.append((piece, n))
        cur_n += n
    if cur_n > 0:
        chunks.append("".join(p for p, _ in cur))
    return [c.strip(_WS) for c in chunks if c.strip(_WS)]


def _sentence_udf(size: int, overlap: int):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pack_chunks(t or "", size, overlap))
    return split


def sentence_chunks(docs: DataFrame, size: int = DEFAULT_CHUNK_SIZE, overlap: int = DEFAULT_CHUNK_OVERLAP,
                    id_col: str = "doc_id", text_col: str = "text", keep_empty: bool = False) -> DataFrame:
    """G1 + W4, same output columns as ``window_chunks``."""
    _check(size, overlap)
    rest = [c for c in docs.columns if c != text_col]
    arr = _sentence_udf(size, overlap)(F.col(text_col))
    out = (docs.select(*rest, arr.alias("_chunks"))
               .select(*rest, F.size("_chunks").alias("n_chunks"),
                       F.posexplode_outer("_chunks").alias("chunk_index", text_col))
               .where(F.lit(keep_empty) | F.col("chunk_index").isNotNull())
               .withColumn("n_tokens", F.size(chunk_tokens(F.col(text_col)))))
    return _with_neighbours(out, id_col)


# ---------------------------------------------------------------- sub-word budgets (G1, G2 in model tokens)

BLANK, LETTER, DIGIT, OTHER = range(4)
_CLASS = np.full(128, OTHER, np.int8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = BLANK
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
_CLASS[0x30:0x3A] = DIGIT
# Marks that end a sentence (the wide ones also without a blank behind them) or a clause, and
# marks that may close a sentence after its end.
SENTENCE_MARKS, WIDE_MARKS, CLAUSE_MARKS, CLOSERS = ".!?。！？", "。！？", ",;:，；：、", "\"')]”’」』）"
WORD, CLAUSE, SENTENCE, PARAGRAPH = 1, 2, 3, 4
BATCH_CHARS = 2_000_000


def _among(codes: np.ndarray, marks: str) -> np.ndarray:
    return np.isin(codes, np.array([ord(m) for m in marks], np.uint32))


def token_breaks(text: str, rule: Subwords = Subwords()):
    """(starts, ends, level): the character ranges of the tokens, and how strong the break before each is.

    4: a blank line; 3: a sentence ends; 2: a clause or line ends; 1: blanks; 0: inside a word."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int8)
    kind = np.where(codes < 128, _CLASS[np.minimum(codes, 127)], OTHER)
    run = np.ones(len(codes), bool)
    run[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == OTHER)
    place = np.arange(len(codes))
    place = place - np.maximum.accumulate(np.where(run, place, 0))
    limit = np.array([1, rule.letters, rule.digits, 1])[kind]
    begins = (place % limit == 0) & (kind != BLANK)
    finish = kind != BLANK
    finish[:-1] &= begins[1:] | (kind[1:] == BLANK)
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finish) + 1
    level = np.zeros(len(starts), np.int8)
    if len(starts) > 1:
        gap = starts[1:] > ends[:-1]
        lines = np.cumsum(codes == 10)
        lines = lines[starts[1:]] - lines[ends[:-1] - 1]
        last = codes[ends[:-1] - 1]
        before = np.where(_among(last, CLOSERS) & (ends[:-1] > 1), codes[ends[:-1] - 2], last)
        level[1:][gap] = WORD
        level[1:][(gap & _among(last, CLAUSE_MARKS)) | _among(last, "，；：、") | (lines == 1)] = CLAUSE
        level[1:][(gap & _among(before, SENTENCE_MARKS)) | _among(last, WIDE_MARKS)] = SENTENCE
        level[1:][lines > 1] = PARAGRAPH
    return starts, ends, level


def choose_cuts(level: np.ndarray, size: int, overlap: int) -> list:
    """[(first, behind)]: token ranges of the chunks. Each has ``size`` tokens at most and, but for the last, more than
    half as many; it ends at the strongest break of its second half (the latest of them). The next begins where a
    sentence does within the last ``overlap`` tokens, else a word, else ``overlap`` tokens back."""
    n = len(level)
    if n <= size:
        return [(0, n)] if n else []
    at = np.arange(n)
    latest = {k: np.maximum.accumulate(np.where(level >= k, at, 0)) for k in (PARAGRAPH, SENTENCE, CLAUSE, WORD)}
    soonest = {k: np.minimum.accumulate(np.where(level >= k, at, n)[::-1])[::-1] for k in (SENTENCE, WORD)}
    out, first = [], 0
    while n - first > size:
        end = first + size
        least = first + max(overlap, size // 2)
        end = next((int(c[end]) for c in latest.values() if c[end] > least), end)
        out.append((first, end))
        back = end - overlap
        first = next((int(b[back]) for b in soonest.values() if overlap and b[back] < end), back)
    return [*out, (first, n)]


def _groups(texts: list, chars: int):
    """Slices of the list whose texts hold ``chars`` characters, or one text that holds more."""
    first = held = 0
    for i, t in enumerate(texts):
        if i > first and held + len(t) > chars:
            yield first, i
            first, held = i, 0
        held += len(t)
    if texts:
        yield first, len(texts)


def budget_chunks(texts: list, size: int, overlap: int, rule: Subwords = Subwords()) -> list:
    """For each text its chunks: {text, token_start, n_tokens}."""
    out = []
    for lo, hi in _groups(texts, BATCH_CHARS):
        whole = "\n".join(texts[lo:hi])
        starts, ends, level = token_breaks(whole, rule)
        at = 0
        for text in texts[lo:hi]:
            a, b = np.searchsorted(starts, [at, at + len(text)])
            out.append([{"text": whole[starts[a + f]:ends[a + e - 1]], "token_start": f, "n_tokens": e - f}
                        for f, e in choose_cuts(level[a:b], size, overlap)])
            at += len(text) + 1
    return out


def token_chunks(docs: DataFrame, size: int = DEFAULT_CHUNK_SIZE, overlap: int = DEFAULT_CHUNK_OVERLAP,
                 id_col: str = "doc_id", text_col: str = "text", keep_empty: bool = False,
                 rule: Subwords = Subwords(), places: bool = False) -> DataFrame:
    """Chunks of at most ``size`` tokens of ``rule``, output columns as ``window_chunks``; ``places`` adds
    ``token_start``, the number of the chunk's first token in its document. Null, empty and blank texts have none."""
    _check(size, overlap)
    kind = "array<struct<text:string,token_start:int,n_tokens:int>>"

    @F.pandas_udf(kind)
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series(budget_chunks([t or "" for t in texts], size, overlap, rule), index=texts.index, dtype=object)

    rest = [c for c in docs.columns if c != text_col]
    out = (docs.select(*rest, split(F.col(text_col)).alias("_chunks"))
               .select(*rest, F.size("_chunks").alias("n_chunks"), F.posexplode_outer("_chunks").alias("chunk_index", "_c"))
               .where(F.lit(keep_empty) | F.col("chunk_index").isNotNull()))
    out = out.select(*rest, "n_chunks", "chunk_index", F.col("_c.text").alias(text_col),
                     F.coalesce("_c.n_tokens", F.lit(0)).alias("n_tokens"),
                     *([F.col("_c.token_start").alias("token_start")] if places else []))
    return _with_neighbours(out, id_col)


def merge_metadata(parent: Column, own: Column, parent_id: Column) -> Column:
    """Parent metadata overlaid by the chunk's own, plus ``doc_id`` = parent id,
    else the chunk's own ``doc_id``, else ``""``. Keys are de-duplicated explicitly so
    the result does not depend on ``spark.sql.mapKeyDedupPolicy``."""
    own_keys = F.map_keys(own)
    p = F.map_filter(parent, lambda k, v: (~F.array_contains(own_keys, k)) & (k != F.lit("doc_id")))
    o = F.map_filter(own, lambda k, v: k != F.lit("doc_id"))
    did = F.coalesce(parent_id.cast("string"), own.getItem("doc_id"), F.lit(""))
    return F.map_concat(p, o, F.create_map(F.lit("doc_id"), did))
