"""Templates within a radius of each other, counted by bitmaps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

# Templates that are compared with as many others at a time.
TILE = 2048


class _Stretches:
    """Values in order of size, and a bitmap of each beginning of that order. The values within a radius of another are one
    stretch, and the bitmap of a stretch is that of its end less that of its beginning."""

    def __init__(self, values: np.ndarray) -> None:
        order = np.argsort(values, kind="stable")
        self.ordered = values[order]
        sets = np.zeros((len(values) + 1, (len(values) + 63) // 64), np.uint64)
        sets[np.arange(1, len(values) + 1), order // 64] = np.uint64(1) << (order % 64).astype(np.uint64)
        self.sets = np.bitwise_or.accumulate(sets, axis=0)

    def within(self, own: np.ndarray, radius: float) -> np.ndarray:
        """For each own value a bitmap of the values within the radius."""
        ordered = self.ordered
        first, last = np.searchsorted(ordered, own - radius, "left"), np.searchsorted(ordered, own + radius, "right")
        # Sums round; the difference decides, as everywhere.
        while True:
            wider = (first > 0) & (np.abs(own - ordered[np.maximum(first - 1, 0)]) <= radius)
            narrower = (first < len(ordered)) & (first < last) & (np.abs(own - ordered[np.minimum(first, len(ordered) - 1)]) > radius)
            if not (wider | narrower).any():
                break
            first = first - wider + narrower
        while True:
            wider = (last < len(ordered)) & (np.abs(own - ordered[np.minimum(last, len(ordered) - 1)]) <= radius)
            narrower = (last > first) & (np.abs(own - ordered[np.maximum(last - 1, 0)]) > radius)
            if not (wider | narrower).any():
                break
            last = last + wider - narrower
        return self.sets[last] ^ self.sets[np.minimum(first, last)]


def _planes(weights: np.ndarray, words: int) -> list[np.ndarray]:
    """Bitmaps of the weights that have each bit."""
    planes = []
    for bit in range(int(weights.max(initial=0)).bit_length()):
        flags = np.zeros(words * 64, np.uint8)
        flags[: len(weights)] = weights >> bit & 1
        planes.append(np.packbits(flags, bitorder="little").view(np.uint64))
    return planes


def _weigh(found: np.ndarray, planes: list[np.ndarray]) -> np.ndarray:
    """Sum of the weights in each bitmap, bit by bit."""
    counts = np.zeros(len(found), np.int64)
    for bit, plane in enumerate(planes):
        counts += np.bitwise_count(found & plane).sum(1, dtype=np.int64) << bit
    return counts


def matches(own: Sequence[np.ndarray], others: Sequence[np.ndarray], weights: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """For each own template the weight of the other templates within the radius in the first two values, and in all three."""
    x, y, z = (_Stretches(o).within(v, radius) for v, o in zip(own, others))
    two = x & y
    planes = _planes(weights, two.shape[1])
    return _weigh(two, planes), _weigh(two & z, planes)


def template_counts(x: np.ndarray, radii: Sequence[float]) -> np.ndarray:
    """(radius, 2, template): for the templates of three values of one array the number of templates within each radius in the
    first two values, and in all three, itself included.

    Equal templates are one with a weight. They are in order of their first value, so that tiles too far apart there are not
    compared."""
    templates = np.lib.stride_tricks.sliding_window_view(x, 3)
    own, place, weights = np.unique(templates, axis=0, return_inverse=True, return_counts=True)
    counts = np.zeros((len(radii), 2, len(own)), np.int64)
    for b in range(0, len(own), TILE):
        others = own[b : b + TILE]
        stretches = [_Stretches(o) for o in others.T]
        planes = _planes(weights[b : b + TILE], (len(others) + 63) // 64)
        for a in range(0, len(own), TILE):
            mine = own[a : a + TILE]
            apart = max(mine[0, 0] - others[-1, 0], others[0, 0] - mine[-1, 0])
            for r, radius in enumerate(radii):
                if apart > radius:
                    continue
                two = stretches[0].within(mine[:, 0], radius) & stretches[1].within(mine[:, 1], radius)
                counts[r, 0, a : a + TILE] += _weigh(two, planes)
                counts[r, 1, a : a + TILE] += _weigh(two & stretches[2].within(mine[:, 2], radius), planes)
    return counts[:, :, place.ravel()]


def match_shares(x: np.ndarray, m: int, radius: float) -> np.ndarray:
    """For each window of length m (2 or 3) of one array the number of windows within the radius, itself included."""
    parts = np.lib.stride_tricks.sliding_window_view(x, m).T
    third = parts[2] if m == 3 else np.zeros(parts.shape[1])
    counts = np.zeros(parts.shape[1], np.int64)
    for a in range(0, len(counts), TILE):
        own = [parts[0][a : a + TILE], parts[1][a : a + TILE], third[a : a + TILE]]
        for b in range(0, len(counts), TILE):
            others = [parts[0][b : b + TILE], parts[1][b : b + TILE], third[b : b + TILE]]
            counts[a : a + TILE] += matches(own, others, np.ones(len(others[0]), np.int64), radius)[m - 2]
    return counts.astype(float)
