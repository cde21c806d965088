"""Exact p-values of small samples by dynamic programming over counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def smirnov_tail(n1: int, n0: int, distance: float) -> float:
    """P(D >= distance) for two samples of these sizes from one distribution without ties.

    A random order of the two samples is a lattice path; step by step the chance of each place is carried on, and what
    steps outside the band is summed up. Only chances are added, so small p keep their digits."""
    if not (n1 > 0 and n0 > 0) or math.isnan(distance):
        return math.nan
    edge = round(distance * n1 * n0)
    chance = np.zeros(n1 + 1)
    chance[0] = 1.0
    i, out, total = np.arange(n1 + 1, dtype=np.int64), 0.0, n1 + n0
    if edge <= 0:
        return 1.0
    for s in range(total):
        first = chance * np.clip(n1 - i, 0, None) / (total - s)
        other = chance * np.clip(n0 - (s - i), 0, None) / (total - s)
        chance = other
        chance[1:] += first[:-1]
        outside = np.abs(i * n0 - (s + 1 - i) * n1) >= edge
        out += chance[outside].sum()
        chance[outside] = 0.0
    return float(min(1.0, out))


def inversions_tail(n: int, discordant: int) -> float:
    """Two-sided p of Kendall's statistic without ties: twice the chance that a random order of n has as few discordant (or
    concordant) pairs, 1 at most."""
    pairs = n * (n - 1) // 2
    fewer = min(discordant, pairs - discordant)
    if n < 2:
        return 1.0
    # chance[c]: c inversions among the first m; the next element adds 0..m of them.
    chance = np.zeros(fewer + 1)
    chance[0] = 1.0
    for m in range(1, n):
        sums = np.concatenate(([0.0], np.cumsum(chance)))
        start = np.maximum(np.arange(fewer + 1) - m, 0)
        chance = (sums[1:] - sums[start]) / (m + 1)
    return float(min(1.0, 2 * chance.sum()))


def smirnov_exact_p(n1: Column, n0: Column, distance: Column) -> Column:
    @F.pandas_udf("double")
    def tail(n1: pd.Series, n0: pd.Series, d: pd.Series) -> pd.Series:
        sizes = zip(n1.tolist(), n0.tolist(), d.tolist())
        return pd.Series([math.nan if x != x or y != y else smirnov_tail(int(x), int(y), z) for x, y, z in sizes])

    return tail(n1, n0, distance)


def kendall_exact_p(n: Column, discordant: Column) -> Column:
    @F.pandas_udf("double")
    def tail(n: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([math.nan if x != x or y != y else inversions_tail(int(x), int(y)) for x, y in zip(n.tolist(), c.tolist())])

    return tail(n, discordant)
