"""Quality rules as a bitmask ledger.

``quality_ledger`` evaluates every rule once per text and stores its measurements and one failure bit
per rule. Policies are bitmasks with a version: ``apply_policy`` keeps a row when none of the policy's
bits failed, and ``ablations`` counts, from the ledger alone, what each rule of each policy rejects on
its own, without reading a text again.

Defined results: a null or blank text has no words (``too_short`` and ``no_words`` fail; it is the row
that stays in the ledger). Repeated rows are judged one by one. Extra columns are kept; a column that
has the name of a measurement is replaced. An empty table gives an empty ledger. Texts are whole: the
work is row-local and no shuffle is made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpuskit.llm.textvec import (Words, per_doc_sum, pieces, repeated, shingle_places, shingles, span_hashes,
                                   with_doc)
from corpuskit.session import ship_package

MIN_WORDS = 20
REPEAT_WORDS = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

# One bit per rule, by name; a rule that is added takes the next bit, and bits are never reused.
RULES = {
    "too_short": f"n_words < {MIN_WORDS}",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "5 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 12 * n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "no_words": "n_words = 0",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["too_short"] | BIT["repeats"]
POLICIES = {
    "base-1": BASE,
    "default-1": BASE | BIT["symbols"] | BIT["word_length"] | BIT["no_words"],
    "strict-1": BASE | BIT["symbols"] | BIT["word_length"] | BIT["dup_lines"] | BIT["no_words"],
}
DEFAULT_POLICY = "default-1"


def _measure(piece) -> list[np.ndarray]:
    data, bounds = piece.data, piece.bounds
    words = Words(piece)
    in_word = ~words.gap
    chars = per_doc_sum(in_word & ((data & 0xC0) != 0x80), bounds)
    symbols = per_doc_sum(SYMBOLS[data], bounds)
    # lines: text between newlines and document ends, counted where they hold a word
    newline = data == 0x0A
    at = np.flatnonzero(newline)
    starts = np.concatenate((bounds[:-1], at + 1))
    ends = np.concatenate((at, bounds[1:]))
    starts.sort()
    ends.sort()
    docs = np.searchsorted(bounds, starts, "right") - 1
    # an empty text shares its start with the next one; such empty lines hold no word and drop out
    has_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, docs = starts[has_word], ends[has_word], docs[has_word]
    n_lines = np.bincount(docs, minlength=piece.n_docs)
    _, once = np.unique(with_doc(span_hashes(data, starts, ends), docs), return_index=True)
    n_dup = n_lines - np.bincount(docs[once], minlength=piece.n_docs)
    # words within windows that the text holds twice or more
    places, owner = shingle_places(words.of, REPEAT_WORDS)
    keys = with_doc(shingles(words.hashes, REPEAT_WORDS)[places], owner) if len(places) else np.zeros(0, np.uint64)
    twice = places[repeated(keys)] if len(keys) else places
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + REPEAT_WORDS, -1)
    n_repeat = per_doc_sum(np.cumsum(cover[:-1]) > 0, words.of)
    return [words.counts, chars, symbols, n_lines, n_dup, n_repeat]


def quality_ledger(docs: DataFrame, text: str = "text", drop_text: bool = True) -> DataFrame:
    """``docs`` with the measurements and ``failed`` (bitmask over RULES, bigint)."""
    keep = [c for c in docs.columns if c not in (*MEASURES, "failed") and not (drop_text and c == text)]
    source = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])])
    return _judged(source, keep, lambda batch: batch.column(batch.schema.get_field_index(text)))


def _judged(source: DataFrame, keep: list[str], text_of) -> DataFrame:
    """The columns ``keep`` of ``source``, the measurements of ``text_of(batch)`` and the failure bits."""
    ship_package(source.sparkSession)
    schema = StructType([f for f in source.schema if f.name in keep]
                        + [StructField(m, LongType()) for m in MEASURES])
    keep = [f.name for f in schema][:-len(MEASURES)]

    def measure(batches):
        for batch in batches:
            parts = [_measure(p) for p in pieces(text_of(batch))]
            cols = [np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)] if parts else \
                [np.zeros(0, np.int64)] * len(MEASURES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(c) for c in cols],
                names=[*keep, *MEASURES])

    bits = sum((F.when(F.expr(rule), F.lit(BIT[name])).otherwise(0) for name, rule in RULES.items()), F.lit(0))
    return source.mapInArrow(measure, schema).withColumn("failed", bits.cast("bigint"))


def apply_policy(ledger: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Adds ``kept``: no bit of the named policy failed."""
    return ledger.withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[policy]).cast("bigint")) == 0)


def ablations(ledger: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """Rows (policy, rule, n_failed, n_only): rows of the ledger that fail the rule, and rows that the
    policy rejects for this rule alone, so that would be kept without it.

    One aggregation to at most 2**rules masks, whatever the number of rows; the rest is on those.
    """
    policies = policies or POLICIES
    spark = ledger.sparkSession
    masks = ledger.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    wanted = spark.createDataFrame(
        [(p, m, rule, BIT[rule]) for p, m in policies.items() for rule in RULES if m & BIT[rule]],
        "policy string, mask bigint, rule string, bit bigint")
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    only = F.col("failed").bitwiseAND(F.col("mask")) == F.col("bit")
    # the rule table is bounded by policies x rules
    pairs = masks.withColumn("on", F.lit(1)).join(F.broadcast(wanted.withColumn("on", F.lit(1))), "on")
    return pairs.groupBy("policy", "rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(only, F.col("n")).otherwise(0)).alias("n_only"))


def quality_filter(docs: DataFrame, policy: str = DEFAULT_POLICY, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with the columns of ``docs``."""
    at = docs.columns.index(text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    judged = _judged(rows, ["row"], lambda batch: batch.column(0).field(at))
    return apply_policy(judged, policy).where("kept").select("row.*")
