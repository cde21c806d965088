"""Discrete Fourier sums of blocks of a sequence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


# Complex numbers of the waves of one block that are held at a time (16 bytes each).
WAVE_CELLS = 1 << 20


def by_length(xs: pd.Series):
    """Row numbers and the stacked matrix of the arrays of each length."""
    arrays = xs.to_numpy()
    lengths = np.array([len(a) for a in arrays])
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        yield rows, int(size), np.stack([np.asarray(arrays[i], float) for i in rows])


def fourier_sums(xs: Column, start: Column, n: Column, terms: int) -> Column:
    """Real and imaginary parts, interleaved, of sum x_t exp(-2 pi i k t / n) for k < terms over the
    block that begins at `start`; terms above n / 2 are 0. Blocks of one sequence add up."""

    @F.pandas_udf("array<double>")
    def sums(xs: pd.Series, start: pd.Series, n: pd.Series) -> pd.Series:
        out = np.empty(len(xs), dtype=object)
        whole = (start.to_numpy() == 0) & (xs.map(len).to_numpy() == n.to_numpy())
        for rows, size, values in by_length(xs):
            if whole[rows].all() and size > 0:
                spectrum = np.fft.rfft(values, axis=1)[:, :terms]
                spectrum = np.pad(spectrum, ((0, 0), (0, terms - spectrum.shape[1])))
            else:
                # One row at a time and a few terms at once: waves of at most WAVE_CELLS numbers are held.
                spectrum = np.zeros((len(rows), terms), complex)
                step = max(1, WAVE_CELLS // max(size, 1))
                for i, (begin, total) in enumerate(zip(start.to_numpy()[rows].tolist(), n.to_numpy()[rows].tolist())):
                    t = begin + np.arange(size, dtype=np.int64)
                    for first in range(0, min(terms, total // 2 + 1), step):
                        k = np.arange(first, min(first + step, terms, total // 2 + 1))
                        spectrum[i, k] = np.exp(-2j * np.pi * (np.multiply.outer(k, t) % total) / total) @ values[i]
            pairs = np.stack([spectrum.real, spectrum.imag], axis=2).reshape(len(rows), -1)
            for i, row in zip(rows, pairs):
                out[i] = row
        return pd.Series(out)

    return sums(xs, start, n)


def fft_name(k: int, attr: str) -> str:
    return f'fft_coefficient__coeff_{k}__attr_"{attr}"'


def fft_columns(sums: str, terms: int, name=fft_name) -> dict[str, Column]:
    """real, imag, abs and angle (degrees) of each term from the column of interleaved sums."""
    def parts(k: int) -> dict[str, str]:
        re, im = f"get({sums}, {2 * k})", f"get({sums}, {2 * k + 1})"
        return {"real": re, "imag": im, "abs": f"hypot({re}, {im})", "angle": f"degrees(atan2({im}, {re}))"}

    return {name(k, a): F.expr(parts(k)[a]) for a in ("real", "imag", "abs", "angle") for k in range(terms)}
