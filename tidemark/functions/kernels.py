"""Array helpers for features that need the whole ordered sequence.

Each is a vectorised pandas UDF over one array column; equal-length sequences of
a batch are handled as one matrix where the definition allows it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.fourier import by_length
from tidemark.functions.matches import template_counts
from tidemark.functions.phrases import PhraseParse
from tidemark.functions.range_order import RangeOrder

_ARRAY = T.ArrayType(T.DoubleType())
# Values of overlapping stretches that are sorted at once.
SORTED_CELLS = 1 << 18
# Sequences up to this length have the distances of all their values worked out at once, as many as hold these cells.
DISTANCE_LENGTH, DISTANCE_CELLS = 256, 1 << 17


def _matrix_udf(width: int | None, fn: Callable[[np.ndarray], np.ndarray], column: Column) -> Column:
    """Apply fn(rows x length) -> (rows x width) to the arrays of each length; no width, no empty arrays."""

    @F.pandas_udf(_ARRAY)
    def run(xs: pd.Series) -> pd.Series:
        out = np.empty(len(xs), dtype=object)
        for rows, size, values in by_length(xs):
            with np.errstate(all="ignore"):
                result = fn(values) if size else np.full((len(rows), width or 0), np.nan)
            for i, row in zip(rows, result):
                out[i] = row
        return pd.Series(out)

    return run(column)


def _row_udf(width: int, fn: Callable[[np.ndarray], list], column: Column) -> Column:
    def each(values: np.ndarray) -> np.ndarray:
        out = np.full((len(values), width), np.nan)
        for i, x in enumerate(values):
            if np.isfinite(x).all():
                out[i] = fn(x)
        return out

    return _matrix_udf(width, each, column)


def _finite_udf(width: int, fn: Callable[[np.ndarray], np.ndarray], column: Column) -> Column:
    """Like `_matrix_udf`, without the sequences that hold values that are not finite."""

    def each(values: np.ndarray) -> np.ndarray:
        out = np.full((len(values), width), np.nan)
        good = np.isfinite(values).all(axis=1)
        if good.any():
            out[good] = fn(values[good])
        return out

    return _matrix_udf(width, each, column)


def welch_density(values: np.ndarray) -> np.ndarray:
    """Averaged periodogram: Hann windows of up to 256 values, half overlapping, mean removed."""
    size = min(values.shape[1], 256)
    hop = max(1, size - size // 2)
    starts = range(0, values.shape[1] - size + 1, hop)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size) if size > 1 else np.ones(1)
    total = 0.0
    for s in starts:
        part = values[:, s : s + size]
        part = (part - part.mean(axis=1, keepdims=True)) * hann
        total = total + np.abs(np.fft.rfft(part, axis=1)) ** 2
    density = total / len(starts) / (hann**2).sum()
    last = -1 if size % 2 == 0 else None
    density[:, 1:last] *= 2
    return density


def _take(matrix: np.ndarray, columns) -> np.ndarray:
    out = np.full((len(matrix), len(columns)), np.nan)
    for j, c in enumerate(columns):
        if c < matrix.shape[1]:
            out[:, j] = matrix[:, c]
    return out


def welch_coefficients(xs: Column, coefficients) -> Column:
    return _matrix_udf(len(coefficients), lambda v: _take(welch_density(v), coefficients), xs)


def _moments(s: np.ndarray) -> np.ndarray:
    """Centroid, variance, skew and kurtosis from the sums of a spectrum times the powers 0..4 of the place."""
    m1, m2, m3, m4 = (s[:, p] / s[:, 0] for p in range(1, 5))
    var = m2 - m1**2
    small = var < 0.5
    skew = np.where(small, np.nan, (m3 - 3 * m1 * var - m1**3) / var**1.5)
    kurt = np.where(small, np.nan, (m4 - 4 * m1 * m3 + 6 * m2 * m1**2 - 3 * m1) / var**2)
    return np.stack([m1, var, skew, kurt], axis=1)


def spectrum_moments(xs: Column) -> Column:
    """Centroid, variance, skew and kurtosis of the absolute Fourier spectrum."""

    def moments(values):
        a = np.abs(np.fft.rfft(values, axis=1))
        k = np.arange(a.shape[1])
        return _moments(np.stack([a @ k**p for p in (0.0, 1.0, 2.0, 3.0, 4.0)], axis=1))

    return _matrix_udf(4, moments, xs)


def moments_of_sums(sums: Column) -> Column:
    """The same from the sums of the spectrum times the powers 0..4 of the place."""
    return _matrix_udf(4, _moments, sums)


def _entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log(p)).sum())


def _density_entropy(density: np.ndarray, bins) -> np.ndarray:
    """Entropy of each row over equal-width bins from its lowest to its highest value, after scaling to a maximum of 1."""
    out = np.full((len(density), len(bins)), np.nan)
    good = density.max(axis=1) > 0
    d = density[good]
    if not len(d):
        return out
    d = d / d.max(axis=1, keepdims=True)
    rows, size = d.shape
    low, high = d.min(axis=1, keepdims=True), d.max(axis=1, keepdims=True)
    flat = low == high
    low, high = low - 0.5 * flat, high + 0.5 * flat
    line = np.arange(rows)[:, None]
    for i, b in enumerate(bins):
        edges = np.linspace(low[:, 0], high[:, 0], b + 1, axis=1)
        place = np.minimum(((d - low) / (high - low) * b).astype(np.int64), b - 1)
        # The edges decide where the division rounds.
        place = place - (d < edges[line, place])
        place = place + ((d >= edges[line, place + 1]) & (place < b - 1))
        out[good, i] = _code_entropy(place)
    return out


def spectrum_entropy(xs: Column, bins) -> Column:
    """Binned entropy of the averaged periodogram scaled to a maximum of 1."""
    return _finite_udf(len(bins), lambda v: _density_entropy(welch_density(v), bins), xs)


def density_entropy(density: Column, bins) -> Column:
    """The same from an averaged periodogram."""
    return _finite_udf(len(bins), lambda d: _density_entropy(d, bins), density)


def segment_density(xs: Column) -> Column:
    """Periodogram of one segment of at most 256 values."""
    return _matrix_udf(None, welch_density, xs)


def ricker(points: int, width: float) -> np.ndarray:
    t = np.arange(points) - (points - 1.0) / 2
    scale = 2 / (math.sqrt(3 * width) * math.pi**0.25)
    return scale * (1 - t**2 / width**2) * np.exp(-(t**2) / (2 * width**2))


def wavelet_coefficients(xs: Column, widths, n_coefficients: int) -> Column:
    """The first coefficients of the Ricker transform at each width, width by width."""

    def transform(values):
        size = values.shape[1]
        out = np.full((len(values), len(widths) * n_coefficients), np.nan)
        for i, w in enumerate(widths):
            points = min(10 * w, size)
            wave = ricker(points, w)
            c = np.arange(min(n_coefficients, size))[:, None]
            lag = c + (points - 1) // 2 - np.arange(size)[None, :]
            weight = np.where((lag >= 0) & (lag < points), wave[np.clip(lag, 0, points - 1)], 0.0)
            out[:, i * n_coefficients : i * n_coefficients + len(c)] = values @ weight.T
        return out

    return _matrix_udf(len(widths) * n_coefficients, transform, xs)


def ridge_lines(tops: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, level, length) of the lines that the peaks of the levels n - 1 .. 0 form, as far as they are alive at the end. A
    peak goes on with the nearest line within a quarter of its width (the earliest of several), or begins one; a line that
    finds no peak in two levels ends. Peaks of each level are in order of place."""
    at, level, length, gap = (np.empty(0, np.int64) for _ in range(4))
    for now in range(n - 1, -1, -1):
        peaks = np.asarray(tops[now], np.int64)
        gap = gap + 1
        alive = np.flatnonzero(gap <= 2)
        fresh = np.ones(len(peaks), bool)
        if len(alive) and len(peaks):
            ends, first = np.unique(at[alive], return_index=True)
            right = np.searchsorted(ends, peaks)
            left, right = np.maximum(right - 1, 0), np.minimum(right, len(ends) - 1)
            far_left, far_right = np.abs(ends[left] - peaks), np.abs(ends[right] - peaks)
            take_left = (far_left < far_right) | ((far_left == far_right) & (first[left] < first[right]))
            own = alive[first[np.where(take_left, left, right)]]
            fresh = np.minimum(far_left, far_right) > (now + 1) / 4
            np.add.at(length, own[~fresh], 1)
            at[own[~fresh]], level[own[~fresh]], gap[own[~fresh]] = peaks[~fresh], now, 0
        more = peaks[fresh]
        at, level = np.concatenate((at, more)), np.concatenate((level, np.full(len(more), now)))
        length, gap = np.concatenate((length, np.ones(len(more), np.int64))), np.concatenate((gap, np.zeros(len(more), np.int64)))
    alive = gap <= 1
    return at[alive], level[alive], length[alive]


def ridge_rows(x: np.ndarray, n: int, size: int) -> list[np.ndarray]:
    """The Ricker transform of (part of) a sequence of `size` values at the widths 1..n."""
    rows = []
    for w in range(1, n + 1):
        wave = ricker(min(10 * w, size), w)
        rows.append(np.convolve(x, wave, mode="full")[(len(wave) - 1) // 2 :][: len(x)])
    return rows


def standing_lines(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ridge lines that are long enough, and the transform there."""
    tops = [1 + np.flatnonzero((r[1:-1] > r[:-2]) & (r[1:-1] > r[2:])) for r in rows]
    at, level, length = ridge_lines(tops, len(rows))
    long = length >= math.ceil(len(rows) / 4)
    at, level = at[long], level[long]
    return at, np.stack(rows)[level, at] if len(at) else np.empty(0)


def noise_window(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the stretch around each place whose lowest tenth is the noise."""
    width = math.ceil(size / 20)
    return np.maximum(at - width // 2, 0), np.minimum(at + width // 2 + width % 2, size)


def wavelet_peaks(xs: Column, counts) -> Column:
    """Number of ridge lines of the Ricker transform over widths 1..n that stand out of the noise."""

    def peaks(x, n):
        rows = ridge_rows(x, n, len(x)) if len(x) > 2 else []
        at, value = standing_lines(rows) if rows else (np.empty(0, np.int64), np.empty(0))
        if not len(at):
            return 0.0
        start, stop = noise_window(at, len(x))
        place = 0.1 * (stop - start - 1)
        low = np.floor(place).astype(np.int64)
        high = np.minimum(low + 1, stop - start - 1)
        width = int((stop - start).max())
        if width * len(at) <= SORTED_CELLS:
            # Short stretches are sorted as they are.
            cells = start[:, None] + np.arange(width)
            ordered = np.sort(np.where(cells < stop[:, None], rows[0][np.minimum(cells, len(x) - 1)], np.inf), axis=1)
            a, b = ordered[np.arange(len(at)), low], ordered[np.arange(len(at)), high]
        else:
            noise = RangeOrder(rows[0])
            a, b = noise.smallest(start, stop, low), noise.smallest(start, stop, high)
        return float((np.abs(value) >= np.abs(a + (b - a) * (place - low))).sum())

    return _row_udf(len(counts), lambda x: [peaks(x, n) for n in counts], xs)


def peak_counts(xs: Column, supports) -> Column:
    """Number of values above all values up to n steps before and after them, for each n. As in SQL, NaN is above all numbers."""

    def peaks(values):
        rows, size = values.shape
        out = np.zeros((rows, len(supports)))
        no_number = np.isnan(values)
        top = np.ones(values.shape, bool)
        for k in range(1, min(max(supports), (size - 1) // 2) + 1):
            a, b, nan_a, nan_b = values[:, :-k], values[:, k:], no_number[:, :-k], no_number[:, k:]
            top[:, k:] &= (b > a) | (nan_b & ~nan_a)
            top[:, :-k] &= (a > b) | (nan_a & ~nan_b)
            if k in supports:
                out[:, supports.index(k)] = np.count_nonzero(top[:, k : size - k], axis=1)
        return out

    return _matrix_udf(len(supports), peaks, xs)


def corridor_changes(xs: Column, cuts: Column, corridors) -> Column:
    """Mean and population variance of the changes, and of their sizes, between neighbours that both lie between two of the
    sequence's cuts, for each pair of places of cuts; 0 where there are none. As in SQL, NaN is above all numbers."""

    def changes(values, edges):
        out = np.zeros((len(values), 4 * len(corridors)))
        step = np.diff(values, axis=1)
        kinds = (step, np.abs(step))
        no_number, no_edge = np.isnan(values), np.isnan(edges)
        # Which values lie at or above, and at or below, each cut that is asked for.
        high = {i: (values >= edges[:, i, None]) | no_number for i in {i for i, _ in corridors}}
        low = {j: (values <= edges[:, j, None]) | no_edge[:, j, None] for j in {j for _, j in corridors}}
        for c, (i, j) in enumerate(corridors):
            wide = (edges[:, i] < edges[:, j]) | (no_edge[:, j] & ~no_edge[:, i])
            inside = high[i] & low[j] & wide[:, None]
            inside = inside[:, 1:] & inside[:, :-1]
            n = inside.sum(axis=1)
            some = np.flatnonzero(n)
            for k, kind in enumerate(kinds):
                mean = np.where(inside, kind, 0.0).sum(axis=1) / n
                rest = np.where(inside, kind - mean[:, None], 0.0)
                out[some, 4 * c + 2 * k] = mean[some]
                out[some, 4 * c + 2 * k + 1] = ((rest * rest).sum(axis=1) / n)[some]
        return out

    @F.pandas_udf(_ARRAY)
    def run(xs: pd.Series, cuts: pd.Series) -> pd.Series:
        out, edges = np.empty(len(xs), dtype=object), np.stack(cuts.to_numpy()).astype(float)
        for rows, _size, values in by_length(xs):
            with np.errstate(all="ignore"):
                for i, row in zip(rows, changes(values, edges[rows])):
                    out[i] = row
        return pd.Series(out)

    return run(xs, cuts)


def autocovariances(values: np.ndarray, lags: int) -> np.ndarray:
    """Mean products of the centred values `k` apart, divided by n - k, for k = 0..lags."""
    d = values - values.mean(axis=1, keepdims=True)
    size = values.shape[1]
    return np.stack([(d[:, k:] * d[:, : size - k]).sum(axis=1) / (size - k) for k in range(lags + 1)], axis=1)


def _acf_summary(c: np.ndarray) -> np.ndarray:
    r = c[:, 1:] / c[:, :1]
    out = np.stack([r.mean(axis=1), np.median(r, axis=1), r.var(axis=1)], axis=1)
    return np.where(c[:, :1] < 1e-10, 0.0, out)


def autocorrelation_summary(xs: Column, maxlag: int) -> Column:
    """Mean, median and population variance of the autocorrelations at lags 1..maxlag."""

    def summary(values):
        lags = min(maxlag, values.shape[1] - 1)
        return _acf_summary(autocovariances(values, lags)) if lags >= 1 else np.zeros((len(values), 3))

    return _matrix_udf(3, summary, xs)


def covariance_summary(covariances: Column) -> Column:
    """The same from the autocovariances at lags 0, 1, ..."""
    return _matrix_udf(3, _acf_summary, covariances)


def _levinson(c: np.ndarray) -> list[float]:
    """Levinson-Durbin partial autocorrelations from the autocovariances at lags 0..k."""
    out = [1.0]
    phi, error = np.zeros(0), c[0]
    for k in range(1, len(c)):
        last = (c[k] - phi @ c[k - 1 : 0 : -1]) / error
        phi = np.append(phi - last * phi[::-1], last)
        error *= 1 - last * last
        out.append(last)
    return out


def partial_autocorrelations(xs: Column, max_lag: int) -> Column:
    """Partial autocorrelations at lags 0..max_lag; lags from n/2 on are missing."""

    def one(x):
        out = [np.nan] * (max_lag + 1)
        lags = min(max_lag, len(x) // 2 - 1)
        if len(x) <= 1 or lags < 1:
            return out
        c = autocovariances(x[None, :], lags)[0]
        if c[0] > 0:
            out[: lags + 1] = _levinson(c)
        return out

    return _row_udf(max_lag + 1, one, xs)


def covariance_partials(covariances: Column, max_lag: int) -> Column:
    """The same from the autocovariances at lags 0..max_lag."""
    return _row_udf(max_lag + 1, lambda c: _levinson(c) if c[0] > 0 else [np.nan] * (max_lag + 1), covariances)


def _lag_matrix(x: np.ndarray, lags: int, start: int) -> np.ndarray:
    return np.stack([x[start - k : len(x) - k] for k in range(1, lags + 1)], axis=1) if lags else np.empty((len(x) - start, 0))


def autoregression(xs: Column, order: int) -> Column:
    """Constant and coefficients of the least-squares autoregression of the given order."""

    def one(x):
        if len(x) - order < order + 1:
            return [np.nan] * (order + 1)
        design = np.column_stack([np.ones(len(x) - order), _lag_matrix(x, order, order)])
        return np.linalg.lstsq(design, x[order:], rcond=None)[0]

    return _row_udf(order + 1, one, xs)


def normal_equations(products: Column, order: int) -> Column:
    """Least squares from the mean products of (1, lag 1, ..., lag k, x), row by row."""
    size = order + 2

    def one(p):
        m = p.reshape(size, size)
        return np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]

    return _row_udf(order + 1, one, products)


# Response surface of the unit-root test with a constant (fixed published values).
_UNIT_ROOT_SMALL = (2.1659, 1.4412, 0.038269)
_UNIT_ROOT_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
_UNIT_ROOT_RANGE = (-18.83, -1.61, 2.74)


def unit_root_p(t: float) -> float:
    low, star, high = _UNIT_ROOT_RANGE
    if t > high:
        return 1.0
    if t < low:
        return 0.0
    c = _UNIT_ROOT_SMALL if t <= star else _UNIT_ROOT_LARGE
    z = sum(v * t**i for i, v in enumerate(c))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _triangle(columns: list[np.ndarray]) -> tuple[np.ndarray, bool]:
    """The triangle of the columns, the last of them the values to fit, and whether it may decide: not where columns nearly
    depend on each other, fit the values nearly exactly or are of very different size."""
    matrix = np.column_stack(columns)
    if len(matrix) < matrix.shape[1]:
        return matrix, False
    r = np.linalg.qr(matrix, mode="r")
    size = np.abs(np.diag(r))
    return r, bool((size > 1e-6 * np.sqrt((matrix * matrix).sum(axis=0).max())).all())


def unit_root(xs: Column) -> Column:
    """Augmented Dickey-Fuller statistic, p and lag chosen by the information criterion."""

    def fit(y, design):
        beta, *_ = np.linalg.lstsq(design, y, rcond=None)
        rest = y - design @ beta
        return beta, float(rest @ rest)

    def one(x):
        n = len(x)
        most = min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25))
        if most < 0 or np.ptp(x) == 0:
            return [np.nan] * 3
        dx = np.diff(x)

        def sample(lags, start):
            y = dx[start:]
            return y, np.column_stack([x[start:-1], np.ones(len(y)), _lag_matrix(dx, lags, start)])

        y, design = sample(most, most)
        # Each number of lags takes the first columns: what they leave of the values are sums over one triangle.
        triangle, whole = _triangle([*design.T, y])
        left = np.cumsum(triangle[::-1, -1] ** 2)[::-1] if whole else None
        best, used = math.inf, 0
        for lags in range(most + 1):
            ssr = float(left[lags + 2]) if whole else fit(y, design[:, : lags + 2])[1]
            if ssr <= 0:
                return [np.nan] * 3
            score = len(y) * (math.log(2 * math.pi * ssr / len(y)) + 1) + 2 * (lags + 2)
            if score < best:
                best, used = score, lags
        y, design = sample(used, used)
        free = len(y) - design.shape[1]
        if free <= 0:
            return [np.nan] * 3
        # With the level as the last column its coefficient and the spread of that are in the triangle's corner.
        triangle, whole = _triangle([*design.T[1:], design[:, 0], y])
        if whole:
            level, rest = triangle[-2, -2:], abs(triangle[-1, -1])
            t = float(level[1] * np.sign(level[0]) / (rest / math.sqrt(free)))
        else:
            beta, ssr = fit(y, design)
            t = beta[0] / math.sqrt(ssr / free * np.linalg.pinv(design.T @ design)[0, 0])
        return [t, unit_root_p(t), float(used)]

    return _row_udf(3, one, xs)


def _lag_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """sum_v a[v] b[v + s] for s = -(len(a) - 1) .. len(b) - 1, by Fourier transforms."""
    size = 1 << (len(a) + len(b) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(b, size) * np.fft.rfft(a[::-1], size), size)[: len(a) + len(b) - 1]


def decay_lag(xs: Column) -> Column:
    """First lag at which the autocorrelation has fallen to 1/e."""

    def one(x):
        d = x - x.mean()
        products = _lag_products(d, d)[len(d) - 1 :]
        low = np.flatnonzero(products[1:] <= products[0] / math.e)
        return [low[0] + 1.0 if len(low) else np.nan]

    return _row_udf(1, one, xs)


def block_products(a: Column, b: Column) -> Column:
    """Products of two blocks at all their shifts, from -(len(a) - 1) on."""

    @F.pandas_udf(_ARRAY)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_lag_products(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(a, b)])

    return run(a, b)


def phrase_complexity(xs: Column, bins) -> Column:
    """Distinct phrases of the equal-width symbol sequence over its length, per number of bins."""

    def one(x):
        edges = [np.linspace(x.min(), x.max(), b + 1)[1:] for b in bins]
        return [PhraseParse(b).feed(np.searchsorted(e, x).astype(np.uint8).tobytes()).count / len(x) for b, e in zip(bins, edges)]

    return _row_udf(len(bins), one, xs)


def threshold_complexity(xs: Column, threshold: float) -> Column:
    """The same over the two symbols above / not above a threshold."""
    return _row_udf(1, lambda x: [PhraseParse(2).feed((x > threshold).astype(np.uint8).tobytes()).count / len(x)], xs)


def _code_entropy(codes: np.ndarray) -> np.ndarray:
    """Entropy of the codes of each row."""
    rows, size = codes.shape
    ordered = np.sort(codes, axis=1)
    fresh = np.ones(ordered.shape, bool)
    fresh[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    first = np.flatnonzero(fresh)
    p = np.diff(np.append(first, rows * size)) / size
    return np.bincount(first // size, -p * np.log(p), rows)


def order_entropy(xs: Column, dimensions, tau: int = 1) -> Column:
    """Entropy of the order patterns of each dimension."""

    def entropies(values):
        rows, size = values.shape
        out = np.full((len(values), len(dimensions)), np.nan)
        # A pattern is told by which values are above which earlier ones: a bit for each pair.
        above = {k: (values[:, k * tau :] < values[:, : size - k * tau]).astype(np.int64) for k in range(1, max(dimensions)) if k * tau < size}
        for i, d in enumerate(dimensions):
            windows = size - (d - 1) * tau
            if windows < 1:
                continue
            codes = np.zeros((rows, windows), np.int64)
            for first in range(d):
                for k in range(1, d - first):
                    codes = 2 * codes + above[k][:, first * tau : first * tau + windows]
            out[:, i] = _code_entropy(codes)
        return out

    return _finite_udf(len(dimensions), entropies, xs)


def cubic_drift(points: Column, degree: int) -> Column:
    """Coefficients of the drift polynomial through (place, drift) pairs, highest power first, and its
    largest real root."""

    @F.pandas_udf(_ARRAY)
    def run(points: pd.Series) -> pd.Series:
        out = []
        for pairs in points:
            row = np.full(degree + 2, np.nan)
            xy = np.array([(p["x"], p["y"]) for p in pairs], float) if pairs is not None else np.empty((0, 2))
            if len(xy) > 0 and np.isfinite(xy).all():
                try:
                    row[:-1] = np.polyfit(xy[:, 0], xy[:, 1], degree)
                    row[-1] = np.max(np.real(np.roots(row[:-1])))
                except (np.linalg.LinAlgError, ValueError):
                    pass
            out.append(row)
        return pd.Series(out)

    return run(points)


def similar_windows(xs: Column, query, threshold: float, normalise: bool = True) -> Column:
    """Windows whose (standardised) distance to the query is at most the threshold."""
    q = np.asarray(query, float)
    if normalise:
        q = (q - q.mean()) / (q.std() or 1.0)

    def one(x):
        if len(q) < 3 or len(x) < len(q):
            return [np.nan]
        parts = np.lib.stride_tricks.sliding_window_view(x, len(q))
        if normalise:
            sd = parts.std(axis=1, keepdims=True)
            parts = (parts - parts.mean(axis=1, keepdims=True)) / np.where(sd > 0, sd, 1.0)
        return [float((np.sqrt(((parts - q) ** 2).sum(axis=1)) <= threshold).sum())]

    return _row_udf(1, one, xs)


def _counts_within(values: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(radius, row, window): for the windows of two and of three values of each row the number of windows within the radius of
    the row, itself included."""
    rows, size = values.shape
    two = np.empty((len(radii), rows, size - 1), np.int64)
    three = np.empty((len(radii), rows, size - 2), np.int64)
    if size > DISTANCE_LENGTH:
        for i, x in enumerate(values):
            found = template_counts(x, radii[:, i])
            # The last window of two begins no window of three.
            last = np.maximum(np.abs(x[:-1] - x[-2]), np.abs(x[1:] - x[-1])) <= radii[:, i, None]
            two[:, i, :-1], two[:, i, -1], three[:, i] = found[:, 0] + last[:, :-1], last.sum(axis=1), found[:, 1]
        return two, three
    step = max(1, DISTANCE_CELLS // size**2)
    for a in range(0, rows, step):
        part = values[a : a + step]
        far = np.abs(part[:, :, None] - part[:, None, :])
        pairs = np.maximum(far[:, :-1, :-1], far[:, 1:, 1:])
        triples = np.maximum(pairs[:, :-1, :-1], far[:, 2:, 2:])
        for r, radius in enumerate(radii[:, a : a + step, None, None]):
            two[r, a : a + step] = np.count_nonzero(pairs <= radius, axis=2)
            three[r, a : a + step] = np.count_nonzero(triples <= radius, axis=2)
    return two, three


def _radii(values: np.ndarray, shares) -> np.ndarray:
    deviations = np.array([x.std() for x in values])
    return np.array([s * deviations for s in shares])


def sample_entropy(xs: Column) -> Column:
    """-ln of the chance that windows alike over two steps stay alike over three."""

    def entropies(values):
        size = values.shape[1]
        if size < 4:
            return np.full((len(values), 1), np.nan)
        (two,), (three,) = _counts_within(values, _radii(values, [0.2]))
        # The last window of two begins no window of three, and no window counts itself.
        b = two.sum(axis=1) - 2 * two[:, -1] + 1 - (size - 2)
        a = three.sum(axis=1) - (size - 2)
        return -np.log(a / b)[:, None]

    return _finite_udf(1, entropies, xs)


def approximate_entropy(xs: Column, m: int, shares) -> Column:
    """Mean log share of like windows of m (2) steps less that of m + 1 steps, for a radius of each share of the deviation."""
    if m != 2:
        raise ValueError("windows of two steps are compared with windows of three")

    def entropies(values):
        if values.shape[1] <= m + 1:
            return np.zeros((len(values), len(shares)))
        phi = [np.log(c / c.shape[2]).sum(axis=2) / c.shape[2] for c in _counts_within(values, _radii(values, shares))]
        return np.abs(phi[0] - phi[1]).T

    return _finite_udf(len(shares), entropies, xs)
