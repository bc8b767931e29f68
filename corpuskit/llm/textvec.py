"""Vectorised word, line and shingle helpers over Arrow string columns.

Texts of a batch are looked at as one UTF-8 byte buffer with document offsets, cut into pieces of a
bounded number of bytes (a longer text is a piece of its own), so temporaries stay bounded. Words are
runs of bytes other than 0x20 and 0x09-0x0D. Identity of words, lines and shingles is a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of a sum reaches every bit of the hash."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int):
        if len(self.up) < n:
            n = max(n, PIECE_BYTES + 1)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                seq = np.full(n, U64(base))
                seq[0] = 1
                setattr(self, name, np.cumprod(seq, dtype=U64))
        return self.up, self.down


_POWERS = _Powers()


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each range ``values[start:end]`` of 64-bit values."""
    n = len(values)
    up, down = _POWERS.get(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(values * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range ``data[start:end]``."""
    return range_hashes(_BYTE_VALUE[data], starts, ends)


class Piece:
    """Rows ``first:last`` of a batch: their bytes and where each text starts and ends."""

    def __init__(self, first: int, last: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.last, self.data, self.bounds = first, last, data, bounds
        self.n_docs = last - first

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i]:self.bounds[i + 1]].tobytes()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, off, data = column.buffers()
    bounds = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, bounds


def pieces(column: pa.Array, max_bytes: int = PIECE_BYTES) -> Iterator[Piece]:
    """Consecutive rows whose texts sum to at most ``max_bytes`` (one row at least)."""
    if not len(column):
        return
    data, bounds = text_buffer(column)
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + max_bytes, "right")) - 1
        last = min(max(last, first + 1), n)
        lo, hi = bounds[first], bounds[last]
        yield Piece(first, last, data[lo:hi], bounds[first:last + 1] - lo)
        first = last


class Words:
    """Word spans of a piece. ``of[i]:of[i + 1]`` are the words of document i."""

    def __init__(self, piece: Piece, lower: bool = False, is_gap: np.ndarray = IS_SPACE):
        data, bounds = piece.data, piece.bounds
        self.data = TO_LOWER[data] if lower else data
        n = len(data)
        gap = is_gap[data]
        begins = ~gap
        stops = ~gap
        if n:
            inner = bounds[(bounds > 0) & (bounds < n)]
            prev_gap = np.concatenate(([True], gap[:-1]))
            prev_gap[inner] = True
            next_gap = np.concatenate((gap[1:], [True]))
            next_gap[inner - 1] = True
            begins &= prev_gap
            stops &= next_gap
        self.gap = gap
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.of = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(self.of)

    def __len__(self):
        return len(self.starts)

    @property
    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k consecutive words at each place (``len(words) - k + 1`` of them)."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    for j in range(k):
        out = out * U64(_BASE) + words[j:j + m]
    return mix(out)


def shingle_places(of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, documents) of the k-word windows that lie within one document."""
    counts = np.maximum(np.diff(of) - k + 1, 0)
    docs = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - np.repeat(begin - of[:-1], counts), docs


def per_doc_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values[bounds[i]:bounds[i + 1]]`` for each i."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def with_doc(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within a document."""
    return mix(hashes + mix(docs.astype(U64) + U64(1)))


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    order = np.argsort(keys, kind="stable")
    in_order = keys[order]
    same = in_order[1:] == in_order[:-1]
    flag = np.zeros(len(keys), bool)
    flag[order[1:]] = same
    flag[order[:-1]] |= same
    return flag


@lru_cache(maxsize=8)
def seeds(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n odd 32-bit multipliers and n 32-bit offsets, fixed by ``seed``."""
    draw = mix(np.arange(1, 2 * n + 1, dtype=U64) * U64(_BASE) + U64(seed))
    return (draw[:n] >> U64(32)).astype(np.uint32) | np.uint32(1), (draw[n:] >> U64(32)).astype(np.uint32)
