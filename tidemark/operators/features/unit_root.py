"""Unit-root test of sequences of any length, from one table of lagged cross products."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.kernels import unit_root_p
from tidemark.operators.features.rows import SequenceRows

# Rows of the lag matrix that are held at a time.
STEP_ROWS = 8192


def most_lags(n: int) -> int:
    return min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25))


def _design(x: np.ndarray, first: int, lags: int) -> np.ndarray:
    """Rows (level, 1, the changes 1..lags before, the change) for each place j >= first of the values; the level is x[j]."""
    dx = np.diff(x)
    level = x[first:-1]
    before = [dx[first - k : len(dx) - k] for k in range(1, lags + 1)]
    return np.column_stack([level, np.ones(len(level)), *before, dx[first:]])


def cross_products(x: np.ndarray, lags: int) -> np.ndarray:
    """Sums of the products of all columns of the design, over the places from `lags` on."""
    total = np.zeros((lags + 3, lags + 3))
    for at in range(lags, len(x) - 1, STEP_ROWS):
        part = _design(x[at - lags : at + STEP_ROWS + 1], lags, lags)
        total += part.T @ part
    return total


def fitted(products: np.ndarray, first: np.ndarray, n: int, lags: int) -> list[float]:
    """[statistic, p, lags used] from the cross products over the places from `lags` on and the first lags + 1 values."""
    none = [math.nan] * 3
    scale = 1 / np.sqrt(np.maximum(np.diag(products), 1e-300))
    scaled = products * np.multiply.outer(scale, scale)
    size, rows = lags + 2, n - 1 - lags
    try:
        lower = np.linalg.cholesky(scaled[:size, :size])
        # What each column takes off the sum of squares; a shorter lag list is a leading part of a longer one.
        gains = np.linalg.solve(lower, scaled[:size, -1]) ** 2
        left = 1 - np.concatenate(([0.0], np.cumsum(gains)))[2:]
    except np.linalg.LinAlgError:
        left = np.array([_rest(scaled, 2 + k) for k in range(lags + 1)])
    left = left / scale[-1] ** 2
    if (left <= 0).any():
        return none
    scores = rows * (np.log(2 * math.pi * left / rows) + 1) + 2 * (np.arange(lags + 1) + 2)
    used = int(scores.argmin())
    # The chosen fit also takes the places that the longer lag lists had to leave out.
    columns = [*range(2 + used), lags + 2]
    whole = products[np.ix_(columns, columns)]
    if used < lags:
        early = _design(first[: lags + 1], used, used)
        whole = whole + early.T @ early
    free = n - 1 - used - (used + 2)
    if free <= 0:
        return none
    scale = 1 / np.sqrt(np.maximum(np.diag(whole), 1e-300))
    scaled = whole * np.multiply.outer(scale, scale)
    inverse = np.linalg.pinv(scaled[:-1, :-1])
    beta = inverse @ scaled[:-1, -1]
    rest = _rest(scaled, used + 2)
    if rest <= 0:
        return none
    t = float(beta[0] / math.sqrt(rest / free * inverse[0, 0]))
    return [t, unit_root_p(t), float(used)]


def _rest(scaled: np.ndarray, size: int) -> float:
    """Sum of squares left by the first columns, as a part of the whole."""
    beta = np.linalg.lstsq(scaled[:size, :size], scaled[:size, -1], rcond=None)[0]
    return float(scaled[-1, -1] - 2 * beta @ scaled[:size, -1] + beta @ scaled[:size, :size] @ beta)


def unit_root_table(rows: SequenceRows) -> DataFrame:
    """(keys, root): augmented Dickey-Fuller statistic, p and the lag count with the least information criterion; rows carry
    `mu`, `lo` and `hi`. A block takes the last values of the block before it; its products are summed over blocks. Sequences
    that are constant or hold values that are not finite have no result."""
    keys = list(rows.keys)
    blocks = rows.arrays(*[F.first(c).alias(c) for c in ("mu", "lo", "hi")])
    blocks = blocks.where("lo < hi AND abs(lo) < double('inf') AND abs(hi) < double('inf')")
    lags = F.least(F.floor(F.col("n") / 2) - 2, F.ceil(12 * F.pow(F.col("n") / 100, 0.25))).cast("int")
    blocks = blocks.withColumn("lags", lags).withColumn("xs", F.transform("xs", lambda x: x - F.col("mu")))
    tails = blocks.select(*keys, (F.col("block") + 1).alias("block"), F.slice("xs", -F.least(F.col("lags") + 1, F.size("xs")), F.col("lags") + 1).alias("tail"))
    joined = blocks.select(*keys, "block", "n", "lags", "xs").join(tails, [*keys, "block"], "left")
    key_sql = ", ".join(f"`{c}` {t}" for c, t in rows.df.select(*keys).dtypes)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*sums), types)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([m.ravel() for m in sums.values()], pa.list_(pa.float64()))], names=[*keys, "products"])

        types = None
        for batch in batches:
            types = [batch.schema.field(c).type for c in keys]
            for name, own_lags, xs, tail in zip(zip(*[batch.column(c).to_pylist() for c in keys]), batch.column("lags").to_pylist(), batch.column("xs"), batch.column("tail")):
                x = xs.values.to_numpy()
                if tail.is_valid:
                    x = np.concatenate((tail.values.to_numpy(), x))
                part = cross_products(x, own_lags)
                sums[name] = sums[name] + part if name in sums else part
                if len(sums) > 16:
                    yield out()
                    sums.clear()
        if sums:
            yield out()

    parts = joined.mapInArrow(summed, f"{key_sql}, products array<double>")
    cells = parts.select(*keys, F.posexplode("products").alias("i", "v")).groupBy(*keys, "i").agg(F.sum("v").alias("v"))
    whole = cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("products"))
    first = blocks.where("block = 0").select(*keys, "n", "lags", F.slice("xs", F.lit(1), F.col("lags") + 1).alias("first"))

    @F.pandas_udf("array<double>")
    def fit(products: pd.Series, first: pd.Series, n: pd.Series, lags: pd.Series) -> pd.Series:
        return pd.Series([fitted(np.asarray(p, float).reshape(k + 3, -1), np.asarray(f, float), m, k) for p, f, m, k in zip(products, first, n.tolist(), lags.tolist())])

    return whole.join(first, keys).select(*keys, fit("products", "first", "n", "lags").alias("root"))
