"""Summary statistics per sequence: hash aggregates with map-side combine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import id_column, ratio, value_columns
from tidemark.operators.features.rows import SequenceRows, sequence_rows
from tidemark.operators.position import exact_quantiles, fits_one_task


def _resolve(df: DataFrame, ids, channels):
    ids = [id_column(df)] if ids is None else [ids] if isinstance(ids, str) else list(ids)
    if channels is None:
        steps = [c for c in ("step", "time") if c in df.columns]
        channels = value_columns(df, [*ids, *steps])
    return ids, list(channels)


def _five(x: Column, sample: bool) -> dict[str, Column]:
    return {
        "mean": F.avg(x),
        "std": F.stddev_samp(x) if sample else F.stddev_pop(x),
        "min": F.min(x),
        "max": F.max(x),
        "energy": F.sum(x * x),
    }


def statistical_features(
    df: DataFrame, ids=None, channels: Sequence[str] | None = None, sample_std: bool = True
) -> DataFrame:
    """mean, std, min, max and energy of each channel, one row per sequence.

    `sample_std` picks the divisor n - 1; the array-based variant divides by n.
    """
    ids, channels = _resolve(df, ids, channels)
    aggs = [
        agg.alias(f"{c}__{name}")
        for c in channels
        for name, agg in _five(F.col(c).cast("double"), sample_std).items()
    ]
    return df.groupBy(*ids).agg(*aggs)


def minimal_features(df: DataFrame, ids=None, channels: Sequence[str] | None = None) -> DataFrame:
    """The ten features of the minimal set."""
    ids, channels = _resolve(df, ids, channels)

    def ten(x: Column) -> dict[str, Column]:
        return {
            "sum_values": F.sum(x),
            "mean": F.avg(x),
            "length": F.count(F.lit(1)).cast("double"),
            "standard_deviation": F.stddev_pop(x),
            "variance": F.var_pop(x),
            "root_mean_square": F.sqrt(F.avg(x * x)),
            "maximum": F.max(x),
            "absolute_maximum": F.max(F.abs(x)),
            "minimum": F.min(x),
        }

    aggs = [
        a.alias(f"{c}__{n}") for c in channels for n, a in ten(F.col(c).cast("double")).items()
    ]
    return with_quantiles(df, ids, channels, aggs, {"median": 0.5})


def with_quantiles(
    df: DataFrame, ids: Sequence[str], channels: Sequence[str], aggs: Sequence[Column], quantiles: dict[str, float]
) -> DataFrame:
    """Aggregates and exact quantiles per group: one pass for groups that fit a task, rank
    selection for longer ones."""
    if fits_one_task(df, ids):
        at = list(quantiles.values())
        out = df.groupBy(*ids).agg(
            *aggs, *[F.percentile(F.col(c).cast("double"), F.lit(at)).alias(f"__{c}") for c in channels]
        )
        parts = {f"{c}__{n}": F.col(f"__{c}")[i] for c in channels for i, n in enumerate(quantiles)}
        return out.withColumns(parts).drop(*[f"__{c}" for c in channels])
    out = df.groupBy(*ids).agg(*aggs)
    for c in channels:
        values = df.select(*ids, F.col(c).cast("double").alias(c))
        part = exact_quantiles(values, ids, c, {f"{c}__{n}": q for n, q in quantiles.items()})
        out = out.join(part, list(ids), "left")
    return out


def base_features(df: DataFrame, ids=None, channels: Sequence[str] | None = None) -> DataFrame:
    """mean, sample std, min, max, median, skew, kurtosis (population, excess), energy, mean |x|."""
    ids, channels = _resolve(df, ids, channels)
    aggs = []
    for c in channels:
        x = F.col(c).cast("double")
        more = _five(x, True) | {
            "skew": F.coalesce(F.skewness(x), F.lit(0.0)),
            "kurtosis": F.coalesce(F.kurtosis(x), F.lit(0.0)),
            "mean_abs": F.avg(F.abs(x)),
        }
        aggs += [a.alias(f"{c}__{n}") for n, a in more.items()]
    return with_quantiles(df, ids, channels, aggs, {"median": 0.5})


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over the pairs where both are known; 0 for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def lag_correlations(
    df: DataFrame,
    ids=None,
    step: str | Sequence[str] | None = None,
    channels: Sequence[str] | None = None,
    lags: Sequence[int] = (1, 2, 5, 10, 20),
    max_len: int | None = None,
) -> DataFrame:
    """Pearson correlation of each channel with itself `lag` steps before."""
    rows = sequence_rows(df, ids, step, channels, max_len, halo=max(lags))
    lagged = rows.with_columns({f"lag_{k}": F.lag("x", k).over(rows.ordered) for k in lags})
    return lagged.own().groupBy(*rows.keys).agg(
        *[guarded_corr(F.col("x"), F.col(f"lag_{k}")).alias(f"autocorr_{k}") for k in lags]
    )


__all__ = [
    "SequenceRows",
    "base_features",
    "guarded_corr",
    "lag_correlations",
    "minimal_features",
    "statistical_features",
    "with_quantiles",
]
