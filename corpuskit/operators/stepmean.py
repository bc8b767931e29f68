"""The step-rounded running mean as functions that compose.

One sample x takes the mean m of n samples to ``rint((m * n + x) / (n + 1))``. For whole m this is
``m + shift(m)``, and shift falls slowly as m grows: a list of the places where it changes is short, and so is
that of many samples one after another, which is the composition of theirs. Composition is associative, so
samples of a model can be folded in pieces by different tasks, without knowing the mean they start from.

The mean before a sample differs from the plain mean of its n samples by at most ``(n + 1) / 4`` (each
rounding adds at most a half and fades with n), and lies between the smallest and the largest sample. Only
there is a function needed. With that band, the number of changes stays below the number of samples, whatever
their values; samples that shift no mean in their band (all, once n exceeds the spread) have none.
"""

from __future__ import annotations

import numpy as np


def step(mean, n, x):
    """The mean after one more sample, rounded half to even."""
    return np.rint((mean * n + x) / (n + 1))


class StepFunction:
    """``f(m) = m + shifts[i]`` for whole m from ``starts[i]`` up to the next start; the domain begins at
    ``starts[0]``."""

    def __init__(self, starts: np.ndarray, shifts: np.ndarray):
        self.starts, self.shifts = starts, shifts

    def __call__(self, m):
        return m + self.shifts[np.maximum(np.searchsorted(self.starts, m, "right") - 1, 0)]

    def then(self, after: StepFunction) -> StepFunction:
        """``after(self(m))``."""
        s, d, t = self.starts, self.shifts, after.starts[1:]
        out = s + d
        piece = np.searchsorted(out, t)  # the first piece that begins at or above the place
        inside = piece > 0
        piece, t = piece[inside], t[inside]
        reach = np.append(s, np.iinfo(np.int64).max)[piece]
        places = np.minimum(t - d[piece - 1], reach)  # in the piece before, or where the piece begins
        starts = np.unique(np.concatenate((s, places[places != np.iinfo(np.int64).max])))
        shifts = after(self(starts)) - starts
        keep = np.append(True, shifts[1:] != shifts[:-1])
        return StepFunction(starts[keep], shifts[keep])


def _compose(functions: list[StepFunction]) -> StepFunction:
    while len(functions) > 1:
        pairs = [a.then(b) for a, b in zip(functions[::2], functions[1::2], strict=False)]
        functions = pairs + functions[len(pairs) * 2:]
    return functions[0]


class Fold:
    """Samples of one model, fed in order, as a function of the mean before the first of them.

    ``n, total, lo, hi``: number, sum, least and largest of the samples before."""

    def __init__(self, n: int, total: float, lo: float, hi: float):
        self.n, self.total, self.lo, self.hi = n, total, lo, hi
        low, _ = self._band(np.array([n], np.float64), np.array([total]), np.array([lo]), np.array([hi]))
        self.function = StepFunction(low.astype(np.int64), np.zeros(1, np.int64))

    @staticmethod
    def _band(n, total, lo, hi):
        mean, width = total / n, (n + 1) / 4 + 1
        return np.maximum(np.floor(lo), np.floor(mean - width)), np.minimum(np.ceil(hi), np.ceil(mean + width))

    def add(self, x: np.ndarray) -> None:
        if not len(x):
            return
        n = self.n + np.arange(len(x), dtype=np.float64)
        sums = self.total + np.concatenate(([0.0], np.cumsum(x)))
        lows = np.minimum.accumulate(np.concatenate(([self.lo], x)))
        highs = np.maximum.accumulate(np.concatenate(([self.hi], x)))
        low, high = self._band(n, sums[:-1], lows[:-1], highs[:-1])
        first, last = step(low, n, x) - low, step(high, n, x) - high  # the shift falls from first to last
        moves = np.flatnonzero((first != 0) | (last != 0))
        functions = [self.function, *self._steps(low[moves], high[moves], n[moves], x[moves], first[moves], last[moves])]
        self.function = _compose(functions)
        self.n, self.total, self.lo, self.hi = self.n + len(x), sums[-1], lows[-1], highs[-1]

    @staticmethod
    def _steps(low, high, n, x, first, last) -> list[StepFunction]:
        """Each sample's function: of every shift value below the first, the least mean that has it or less,
        found by bisection for all of them at once."""
        counts = (first - last).astype(np.int64)
        own = np.repeat(np.arange(len(low)), counts)
        rank = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
        want = first[own] - 1 - rank
        a, b = low[own], high[own]  # the shift is above ``want`` at a and not above it at b
        while True:
            wide = b - a > 1
            if not wide.any():
                break
            middle = np.floor((a + b) / 2)
            reached = step(middle, n[own], x[own]) - middle <= want
            b = np.where(wide & reached, middle, b)
            a = np.where(wide & ~reached, middle, a)
        bounds = np.concatenate(([0], np.cumsum(counts))).tolist()
        places, want = b.astype(np.int64), want.astype(np.int64)
        first, low = first.astype(np.int64), low.astype(np.int64)
        out = []
        for i, (p, q) in enumerate(zip(bounds, bounds[1:], strict=False)):
            starts = np.concatenate((low[i:i + 1], places[p:q]))
            shifts = np.concatenate((first[i:i + 1], want[p:q]))
            keep = np.append(starts[1:] != starts[:-1], True)  # of shifts that are jumped over, the last counts
            out.append(StepFunction(starts[keep], shifts[keep]))
        return out


def fold_from(mean: float, n: int, x: np.ndarray) -> float:
    """The mean after samples ``x``, from a known mean of n samples, one after another."""
    for value in x.tolist():
        mean = float(np.rint((mean * n + value) / (n + 1)))
        n += 1
    return mean
