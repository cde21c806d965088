"""Words of many texts as 64-bit hashes, cut and hashed over the bytes of all of them at once."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np

WORD = re.compile(r"[^\W_]+")

_BYTES = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
# Bytes of letters and digits; those from 0x80 on are parts of letters in the texts that are cut here.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
# Bytes of the texts that may be cut by byte as they are.
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(1, 0x80), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = True
_powers = _inverse = np.empty(0, np.uint64)


def _ensure_powers(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        steps = [np.full(2 * n, base, np.uint64) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
        for s in steps:
            s[0] = 1
        _powers, _inverse = (np.cumprod(s, dtype=np.uint64) for s in steps)


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return WORD.findall((text or "").lower())


def hashed_words(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts in order, number of words of each text); words as `words_of` gives them. Texts of
    other letters than ASCII and U+00C0 to U+017F are cut by `words_of` first."""
    if not len(texts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    encoded = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\0".join(encoded) + b"\0", np.uint8)
    ends = np.cumsum(np.array([len(e) + 1 for e in encoded], np.int64))
    odd = ~_PLAIN[data]
    odd[ends - 1] = False
    odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    if odd.any():
        for i in np.unique(np.searchsorted(ends, np.flatnonzero(odd), "right")).tolist():
            encoded[i] = " ".join(words_of(texts[i])).encode("utf-8", "surrogatepass")
        data = np.frombuffer(b"\0".join(encoded) + b"\0", np.uint8)
        ends = np.cumsum(np.array([len(e) + 1 for e in encoded], np.int64))
    _ensure_powers(len(data) + 1)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], _INSIDE[data]))))  # the last byte is outside
    starts, stops = edges[::2], edges[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _powers[: len(data)], dtype=np.uint64)))
    hashes = (sums[stops] - sums[starts]) * _inverse[starts]
    return hashes, np.diff(np.searchsorted(starts, ends), prepend=0)
