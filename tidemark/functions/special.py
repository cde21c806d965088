"""Tail probabilities for small summary tables, as vectorised pandas UDFs.

Spark has no error, gamma or beta function; these helpers run on one row per
test, never on the data itself.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _each(fn, x):
    # A vectorised object at module level keeps a state that cannot be shipped to the workers.
    return np.vectorize(fn, otypes=[float])(x)


def _lgamma(x):
    """Log-gamma of positive numbers: sixteen steps up by the recurrence, then Stirling's series."""
    x = np.asarray(x, float)
    low = np.where(x < 16, x, 1.0)
    product = np.ones_like(low)
    for i in range(16):
        product = product * (low + i)
    y = np.where(x < 16, x + 16, x)
    z = 1 / (y * y)
    tail = 1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z * 691 / 360360))))
    with np.errstate(divide="ignore", invalid="ignore"):
        series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + tail / y
        return np.where(x < 16, series - np.log(product), series)


def _erfc(x):
    return _each(math.erfc, x)


def beta_cdf(a, b, x):
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    undefined = (a <= 0) | (b <= 0)
    a, b = np.where(undefined, 1.0, a), np.where(undefined, 1.0, b)
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (
            m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(
            _lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)
        )
    out = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * h / p))
    return np.where(undefined, np.nan, np.where(flip, 1 - out, out))


def t_two_sided(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def f_upper(f, d1, d2):
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def binomial_upper(k, n):
    """P(X >= k) for n fair draws."""
    inside = (k >= 1) & (k <= n)
    tail = beta_cdf(np.where(inside, k, 1), np.where(inside, n - k + 1, 1), 0.5)
    return np.where(k <= 0, 1.0, np.where(k > n, 0.0, tail))


def kolmogorov_upper(x):
    """Limit tail of sqrt(n) times the Kolmogorov-Smirnov distance."""
    x = np.asarray(x, float)
    j = np.arange(1, 101)[:, None]
    terms = 2 * (-1.0) ** (j - 1) * np.exp(-2 * j * j * x.ravel() ** 2)
    return np.where(x < 0.2, 1.0, np.clip(terms.sum(0).reshape(x.shape), 0, 1))


def t_quantile_values(p, df) -> np.ndarray:
    """Student quantiles by bisection on the tail, all at once and once for each different pair."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    pairs, back = np.unique(np.stack((p.ravel(), df.ravel())), axis=1, return_inverse=True)
    p, df = pairs
    lo, hi = np.full(len(p), -1e3), np.full(len(p), 1e3)
    for _ in range(200):
        mid = (lo + hi) / 2
        tail = t_two_sided(mid, df) / 2
        below = np.where(mid > 0, 1 - tail, tail) < p
        before, (lo, hi) = (lo, hi), (np.where(below, mid, lo), np.where(below, hi, mid))
        if np.array_equal(lo, before[0]) and np.array_equal(hi, before[1]):
            break
    return np.where(df > 0, (lo + hi) / 2, np.nan)[back.ravel()]


def t_quantile_value(p: float, df: float) -> float:
    return float(t_quantile_values(p, df)[0])


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _known(*series: pd.Series) -> np.ndarray:
    return np.logical_and.reduce([np.isfinite(s.to_numpy(float)) for s in series])


def _apply(fn, *series: pd.Series) -> pd.Series:
    out = np.full(len(series[0]), np.nan)
    ok = _known(*series)
    if ok.any():
        out[ok] = fn(*(s.to_numpy(float)[ok] for s in series))
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def _normal_two_sided(z: pd.Series) -> pd.Series:
    return _apply(lambda v: _erfc(np.abs(v) / math.sqrt(2)), z)


@F.pandas_udf(T.DoubleType())
def _t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return _apply(t_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def _f_upper(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _apply(f_upper, f, d1, d2)


@F.pandas_udf(T.DoubleType())
def _kolmogorov(x: pd.Series) -> pd.Series:
    return _apply(kolmogorov_upper, x)


@F.pandas_udf(T.DoubleType())
def _t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    return _apply(t_quantile_values, p, df)


@F.pandas_udf(T.DoubleType())
def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    def one(a, b, c, d):
        row, col, n = a + b, a + c, a + b + c + d
        if n == 0:
            return 1.0
        # Terms 40 deviations off the mean vanish, so large counts need no full support.
        centre, reach = row * col / n, 40 * math.sqrt(row * col / n * (n - row) / n * (n - col) / max(n - 1, 1)) + 50
        low, high = max(0, row + col - n, math.floor(centre - reach)), min(row, col, math.ceil(centre + reach))
        if not low <= a <= high:
            return 0.0
        # Ratios of neighbouring terms add up to all of them but for a factor, which their sum gives.
        k = np.arange(low, high, dtype=float)
        ratios = np.log(row - k) + np.log(col - k) - np.log(k + 1) - np.log(n - row - col + k + 1)
        logs = np.concatenate(([0.0], np.cumsum(ratios)))
        logs -= logs.max()
        logs -= np.log(np.exp(logs).sum())
        here = logs[int(a - low)]
        return min(1.0, float(np.exp(logs[logs <= here + 1e-7]).sum()))

    return _apply(np.vectorize(one, otypes=[float]), a, b, c, d)


def _clean(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def normal_p(z: Column) -> Column:
    """Two-sided normal tail; null where z is null."""
    return _clean(_normal_two_sided(z.cast("double")))


def student_p(t: Column, df: Column) -> Column:
    return _clean(_t_two_sided(t.cast("double"), df.cast("double")))


def fisher_f_p(f: Column, d1: Column, d2: Column) -> Column:
    return _clean(_f_upper(f.cast("double"), d1.cast("double"), d2.cast("double")))


def kolmogorov_p(x: Column) -> Column:
    return _clean(_kolmogorov(x.cast("double")))


def student_quantile(p: float, df: Column) -> Column:
    return _clean(_t_quantile(F.lit(p), df.cast("double")))


def fisher_exact_p(a: Column, b: Column, c: Column, d: Column) -> Column:
    return _clean(_fisher(*[v.cast("double") for v in (a, b, c, d)]))


@F.pandas_udf(T.DoubleType())
def _signed_rank(w: pd.Series, n: pd.Series) -> pd.Series:
    def one(w, n):
        # Number of sign patterns by rank sum.
        ways = np.ones(1)
        for r in range(1, int(n) + 1):
            longer = np.zeros(len(ways) + r)
            longer[: len(ways)] += ways
            longer[r:] += ways
            ways = longer
        return min(1.0, 2 * ways[: int(w) + 1].sum() / ways.sum())

    return _apply(np.vectorize(one, otypes=[float]), w, n)


def signed_rank_p(w: Column, n: Column) -> Column:
    """Exact two-sided p of the smaller signed-rank sum of n untied differences."""
    return _clean(_signed_rank(w.cast("double"), n.cast("double")))
