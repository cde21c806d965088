"""Counts and order statistics over stretches of an array, many at once."""

from __future__ import annotations

import numpy as np


class RangeOrder:
    """A wavelet matrix over the ranks of the values: per bit of the ranks, from the highest on, how many zeros come before
    each place. All questions are answered for whole arrays of stretches at a time."""

    def __init__(self, values: np.ndarray) -> None:
        values = np.asarray(values, float)
        order = np.argsort(values, kind="stable")
        self.ordered = values[order]
        ranks = np.empty(len(values), np.int64)
        ranks[order] = np.arange(len(values))
        self.bits = max(1, len(values).bit_length())
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            zero = (ranks >> bit & 1) == 0
            self.zeros.append(np.concatenate(([0], np.cumsum(zero))))
            ranks = np.concatenate((ranks[zero], ranks[~zero]))

    def count_less(self, start: np.ndarray, stop: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many values of each stretch start..stop - 1 are less than its value."""
        below = np.searchsorted(self.ordered, value, "left")
        start, stop, count = start.astype(np.int64), stop.astype(np.int64), np.zeros(len(start), np.int64)
        for zeros, bit in zip(self.zeros, range(self.bits - 1, -1, -1)):
            a, b = zeros[start], zeros[stop]
            one = (below >> bit & 1) == 1
            count += np.where(one, b - a, 0)
            start, stop = np.where(one, zeros[-1] + start - a, a), np.where(one, zeros[-1] + stop - b, b)
        return count

    def smallest(self, start: np.ndarray, stop: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of each stretch; k must lie within it."""
        start, stop, k = start.astype(np.int64), stop.astype(np.int64), k.astype(np.int64)
        rank = np.zeros(len(start), np.int64)
        for zeros, bit in zip(self.zeros, range(self.bits - 1, -1, -1)):
            a, b = zeros[start], zeros[stop]
            one = k >= b - a
            rank |= one.astype(np.int64) << bit
            k = np.where(one, k - (b - a), k)
            start, stop = np.where(one, zeros[-1] + start - a, a), np.where(one, zeros[-1] + stop - b, b)
        return self.ordered[rank]
