"""A compressed full-text index over word ids: the Burrows-Wheeler transform in a wavelet matrix.

Many backward searches advance together: each step takes one word of every search, and all ranks of a
step are a few numpy operations per level. The suffix order is by the first ``depth`` words, which is
enough for patterns up to that length.
"""

from __future__ import annotations

import numpy as np


class BitRank:
    """Bits with rank support: 64-bit words and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones
        self.zeros = n - int(ones.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Number of ones among the first ``at`` bits."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes, sorted by their first ``depth`` symbols at least (prefix doubling)."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:n - width] = rank[width:]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        in_order = key[order]
        width *= 2
        step = np.concatenate(([1], (in_order[1:] != in_order[:-1]).astype(np.int64)))
        if width >= depth or step.all():
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)


class RangeMin:
    """Least value of any range, from a table of the minima of ranges of 2**j values."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        self.begin = np.cumsum([0, *map(len, self.levels)])
        self.flat = np.concatenate(self.levels)
        self.levels = None

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of ``values[lo:hi]``; the ranges are not empty."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        base = self.begin[level]
        return np.minimum(self.flat[base + lo], self.flat[base + hi - (1 << level)])


class FMIndex:
    """Backward search over ``text`` (ids from 0), with a value per place of the text.

    ``least(lo, hi)`` is the smallest value among the places where the pattern of an interval starts.
    """

    def __init__(self, text: np.ndarray, values: np.ndarray, depth: int):
        n = len(text)
        order = suffix_order(text, depth)
        transform = text[order - 1]
        self.n = n
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))))
        self.depth_bits = max(1, int(text.max()).bit_length())
        self.levels = []
        column = transform
        for level in range(self.depth_bits - 1, -1, -1):
            bits = ((column >> level) & 1).astype(np.uint8)
            self.levels.append(BitRank(bits))
            column = np.concatenate((column[bits == 0], column[bits == 1]))
        # where each symbol begins in the last column of the wavelet matrix
        self.first = np.zeros(int(text.max()) + 1, np.int64)
        starts = np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1])))
        self.first[column[starts]] = starts
        self.minimum = RangeMin(values[order])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first ``at`` places of the transform."""
        for level, bits in zip(range(self.depth_bits - 1, -1, -1), self.levels, strict=True):
            ones = bits.ones(at)
            at = np.where((symbols >> level) & 1, bits.zeros + ones, at - ones)
        return at - self.first[symbols]

    def step(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol in front."""
        found = self.rank(np.concatenate((symbols, symbols)), np.concatenate((lo, hi)))
        base = self.before[symbols]
        return base + found[:len(lo)], base + found[len(lo):]

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.minimum.least(lo, hi)


def reach_left(index: FMIndex, text: np.ndarray, ends: np.ndarray, floors: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Matching statistics from the right: for each i the least start ``s >= floors[i]`` such that
    ``text[s:ends[i] + 1]`` also starts at a place whose value is below ``own[i]``
    (``ends[i] + 1`` if not even the last word does)."""
    reached = ends + 1
    lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), index.n, np.int64)
    live = np.flatnonzero(reached > floors)
    while len(live):
        lo_next, hi_next = index.step(text[reached[live] - 1], lo[live], hi[live])
        found = np.flatnonzero(hi_next > lo_next)
        found = found[index.least(lo_next[found], hi_next[found]) < own[live[found]]]
        live = live[found]
        lo[live], hi[live] = lo_next[found], hi_next[found]
        reached[live] -= 1
        live = live[reached[live] > floors[live]]
    return reached
