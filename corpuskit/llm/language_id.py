"""Language identification by hyperdimensional profiles.

Every letter has a random vector of ``DIMENSIONS`` signs. An n-gram of letters is one vector: its letters'
vectors, each permuted by its place in the n-gram, bound by multiplication. A text is the sum (bundle) of
the vectors of its n-grams, a language the sum over its documents of their unit vectors, and a document gets
the language whose prototype has the largest cosine with it.

* Signs are kept as bits, so binding is an exclusive or. The permutation of a letter's vector for place p is
  a vector that its code point and p draw. The sums of a batch of texts are one matrix product: n-gram counts by
  n-gram vectors, exact integers in floating point.
* Prototypes add up unit vectors, so a long document weighs like a short one; they are rounded to integers
  (2**20 a unit) before they are added, so that the sum does not depend on the order of tasks.
* Prototypes are compared less their mean: what all languages share (the space between words) tells nothing.

Letters are the code points of the Unicode category L, lower-cased one by one; whatever stands between two
runs of letters is one boundary, and each run is read with a boundary at both ends.

Defined results: a text that is null, empty or without letters is ``und`` with score 0; so is every text
when no labelled document with a letter is there to learn from; ties go to the first language in order; a label
of null teaches nothing; repeated rows are judged one by one, each of them teaches; extra columns stay, but
for those that the result's own columns replace. Prototypes go with the tasks in blocks of
``BLOCK_LANGUAGES``; more languages mean more passes, not larger tasks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from corpuskit.llm import blocksum
from corpuskit.llm.bpe import L, _base_classes, _clean
from corpuskit.llm.textvec import U64, mix, pieces
from corpuskit.session import ship_package

DIMENSIONS = 1024
SIZES = (3,)  # letters of an n-gram
UNIT = 1 << 20  # what one document adds to a prototype, as integers
BLOCK_LANGUAGES = 1_024
PIECE_BYTES = 256 << 10
_SEED = 0x5851F42D4C957F2D


@lru_cache(maxsize=1)
def _lower_points() -> np.ndarray:
    """The lower-case code point of every code point (itself where that is not one code point)."""
    out = np.arange(0x110000, dtype=np.uint32)
    for i in np.flatnonzero(_base_classes() == L).tolist():
        low = chr(i).lower()
        if len(low) == 1:
            out[i] = ord(low)
    return out


def letter_runs(piece) -> tuple[np.ndarray, np.ndarray]:
    """(code points, document of each): lower-case letters, every run with a 0 before and behind it."""
    piece, text = _clean(piece)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(points):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    at = np.flatnonzero((piece.data & 0xC0) != 0x80)
    docs = np.searchsorted(piece.bounds, at, "right") - 1
    keep = np.flatnonzero(_base_classes()[points] == L)
    points, docs = _lower_points()[points[keep]], docs[keep]
    # a run begins where the letter before is not the neighbour or belongs to another document
    begins = np.flatnonzero(np.diff(keep, prepend=-2) != 1)
    begins = np.union1d(begins, np.flatnonzero(np.diff(docs, prepend=-1) != 0))
    inside = np.insert(points, begins, 0)  # one boundary between runs,
    owner = np.insert(docs, begins, docs[begins])
    last = np.flatnonzero(np.diff(owner, append=-1) != 0) + 1  # and one at the end of a document
    return np.insert(inside, last, 0), np.insert(owner, last, owner[last - 1])


def ngrams(piece, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters, of each distinct n-gram the places of its letters among them, document, n-gram and count of
    each pair of the two that occurs)."""
    points, docs = letter_runs(piece)
    letters, index = np.unique(points, return_inverse=True)
    m = len(points) - size + 1
    if m <= 0:
        return letters, np.zeros((0, size), np.int64), np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    whole = np.flatnonzero(docs[:m] == docs[size - 1:])
    code = np.zeros(len(whole), np.int64)
    for j in range(size):
        code = code * len(letters) + index[whole + j]
    grams, gram = np.unique(code, return_inverse=True)
    pairs, counts = np.unique(docs[whole] * len(grams) + gram, return_counts=True)
    places = np.stack([grams // len(letters) ** (size - 1 - j) % len(letters) for j in range(size)], axis=1)
    return letters, places, np.stack(np.divmod(pairs, len(grams)), axis=1), counts


def letter_bits(letters: np.ndarray, place: int, dimensions: int) -> np.ndarray:
    """Random bits of each letter at a place of the n-gram, 64 to a word."""
    words = np.arange(dimensions // 64, dtype=U64)
    start = mix(letters.astype(U64) * U64(64) + U64(place + 1) + U64(_SEED))
    return mix(start[:, None] + words[None, :] * U64(0x9E3779B97F4A7C15))


def document_vectors(piece, dimensions: int, sizes=SIZES) -> np.ndarray:
    """Sum of the n-gram vectors of each document of a piece (zeros where it has no letter)."""
    out = np.zeros((piece.n_docs, dimensions))
    for size in sizes:
        letters, places, pairs, counts = ngrams(piece, size)
        if not len(places):
            continue
        kind = np.float32 if counts.sum() < 1 << 24 else np.float64  # sums are exact in either
        for at in range(0, len(places), 8192):  # bounds the matrices, whatever the alphabet
            part = places[at:at + 8192]
            bits = np.zeros((len(part), dimensions // 64), U64)
            for j in range(size):
                bits ^= letter_bits(letters, 8 * size + j, dimensions)[part[:, j]]
            signs = 1 - 2 * np.unpackbits(bits.view(np.uint8), axis=1).astype(kind)
            mine = (pairs[:, 1] >= at) & (pairs[:, 1] < at + len(part))
            have, row = np.unique(pairs[mine, 0], return_inverse=True)
            grid = np.zeros((len(have), len(part)), kind)
            grid[row, pairs[mine, 1] - at] = counts[mine]
            out[have] += grid @ signs
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.sqrt((vectors * vectors).sum(-1, keepdims=True))
    return vectors / np.where(norm > 0, norm, 1)


def language_prototypes(docs: DataFrame, text: str = "text", lang: str = "lang",
                        dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Language -> sum of the unit vectors of its documents, as integers, over every row of ``docs`` that has
    a language and a letter. One array for each language comes to the driver."""
    ship_package(docs.sparkSession)
    source = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).where(
        "lang is not null and text is not null")
    schema = blocksum.schema(StringType(), LongType())

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0)
            for p in pieces(batch.column(1), PIECE_BYTES):
                vectors = document_vectors(p, dimensions)
                units = np.rint(_unit(vectors) * UNIT).astype(np.int64)
                for i, name in enumerate(names.slice(p.first, p.n_docs).to_pylist()):
                    if units[i].any():
                        held[name] = held[name] + units[i] if name in held else units[i]
            if len(held) > BLOCK_LANGUAGES:
                yield from (blocksum.rows(k, pa.string(), v) for k, v in held.items())
                held = {}
        yield from (blocksum.rows(k, pa.string(), v) for k, v in held.items())

    sums = blocksum.fetch(source.mapInArrow(run, schema))
    return {name: sums[name][:dimensions] for name in sorted(sums)}


def _centred(prototypes: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(names, unit prototypes less their mean, that mean); a single language is compared as it is."""
    names = sorted(prototypes)
    units = _unit(np.stack([prototypes[n].astype(np.float64) for n in names]))
    mean = units.mean(0) if len(names) > 1 else np.zeros(units.shape[1])
    return names, _unit(units - mean), mean


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the cosine with the prototype, from 0 (negative ones) to 1."""
    ship_package(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = StructType([*[docs.schema[c] for c in keep], StructField("lang_pred", StringType()),
                         StructField("score", DoubleType())])
    out = docs.select(*[F.col(f"`{c}`") for c in keep], F.lit("und").alias("lang_pred"), F.lit(-2.0).alias("score"))
    where = keep.index(text)
    if prototypes:
        names, units, mean = _centred(prototypes)
        for at in range(0, len(names), BLOCK_LANGUAGES):
            out = out.mapInArrow(_compare(names[at:at + BLOCK_LANGUAGES], units[at:at + BLOCK_LANGUAGES], mean, where),
                                 schema)
    return out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))))


def _compare(names: list[str], units: np.ndarray, mean: np.ndarray, where: int):
    """Better of what a row has so far and the best of these prototypes."""
    dimensions = units.shape[1]

    def run(batches):
        for batch in batches:
            k = batch.num_columns - 2
            for p in pieces(batch.column(where), PIECE_BYTES):
                vectors = document_vectors(p, dimensions)
                known = vectors.any(1)
                cosine = np.round(_unit(_unit(vectors) - mean) @ units.T, 12)
                best = cosine.argmax(1)
                score = np.where(known, cosine[np.arange(len(best)), best], -2.0)
                rows = batch.slice(p.first, p.n_docs)
                before = rows.column(k + 1).to_numpy(zero_copy_only=False)
                pred = [names[b] if s > q else old for b, s, q, old in
                        zip(best.tolist(), score.tolist(), before.tolist(), rows.column(k).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns[:k], pa.array(pred, pa.string()),
                                                  pa.array(np.maximum(score, before))], names=batch.schema.names)

    return run


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> F.Column:
    """Whether a document is kept from learning: by the crc32 of its id as text (a null id: the empty text)."""
    return F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")) % folds == fold
