"""The compact set: 47 statistics and 4 columns per Fourier term for each channel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.fourier import fft_columns, fourier_sums
from tidemark.functions.special import student_p
from tidemark.operators.features.rows import SequenceRows, sequence_rows
from tidemark.operators.position import exact_quantiles

LAGS = range(1, 11)
QUANTILES = (0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9)
_ZERO = 1e-12


def moments(x: str) -> dict[str, str]:
    """SQL of the moments and extremes of the values; shape is 0 where the deviation vanishes."""
    shape = "CASE WHEN stddev_pop({x}) > {zero} THEN coalesce({fn}({x}), 0D) ELSE 0D END"
    return {
        "mean": f"avg({x})",
        "standard_deviation": f"stddev_pop({x})",
        "variance": f"var_pop({x})",
        "minimum": f"min({x})",
        "maximum": f"max({x})",
        "abs_energy": f"sum({x} * {x})",
        "absolute_maximum": f"max(abs({x}))",
        "root_mean_square": f"sqrt(avg({x} * {x}))",
        "skewness": shape.format(x=x, zero=_ZERO, fn="skewness"),
        "kurtosis": shape.format(x=x, zero=_ZERO, fn="kurtosis"),
    }


def changes(x: str, position: str, previous: str) -> dict[str, str]:
    return {
        "mean_change": f"coalesce(try_divide(max_by({x}, {position}) - min_by({x}, {position}), count(1) - 1), 0D)",
        "mean_abs_change": f"coalesce(avg(abs({x} - {previous})), 0D)",
        "absolute_sum_of_changes": f"coalesce(sum(abs({x} - {previous})), 0D)",
    }


def locations(x: str, position: str, last_shift: int = 0) -> dict[str, str]:
    """First and last index of the extremes over n; `last_shift` is added to the last ones."""
    def at(best: str, value: str, place: str) -> str:
        return f"{best}(named_struct('v', {value}, 'p', {place})).p"

    return {
        "first_location_of_minimum": f"{at('min', x, position)} / count(1)",
        "first_location_of_maximum": f"{at('min', f'-{x}', position)} / count(1)",
        "last_location_of_minimum": f"({last_shift} - {at('min', x, f'-{position}')}) / count(1)",
        "last_location_of_maximum": f"({last_shift} + {at('max', x, position)}) / count(1)",
    }


def trend(x: str, t: str) -> dict[str, str]:
    """SQL of the least squares of x on t: slope, intercept, r and the standard error of the slope."""
    sxx, sxy, syy = f"var_pop({t})", f"covar_pop({t}, {x})", f"var_pop({x})"
    slope = f"coalesce(try_divide({sxy}, {sxx}), 0D)"
    r = f"coalesce(try_divide({sxy}, sqrt({sxx} * {syy})), 0D)"
    rest = f"greatest(coalesce({syy} - {slope} * {sxy}, 0D), 0D)"
    return {
        "slope": slope,
        "intercept": f"CASE WHEN {sxx} > 0 THEN avg({x}) - {slope} * avg({t}) ELSE 0D END",
        "rvalue": f"CASE WHEN {syy} > {_ZERO} THEN greatest(-1D, least(1D, {r})) ELSE 0D END",
        "stderr": f"sqrt(coalesce(try_divide({rest}, {sxx} * (count({x}) - 2)), 0D))",
    }


def trend_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs; 0 for an exact fit, 1 where it is undefined."""
    t = F.abs(r) * F.sqrt(F.try_divide(n - 2, 1 - r * r))
    return F.when(n <= 2, 1.0).when(F.abs(r) >= 1, 0.0).otherwise(
        F.coalesce(student_p(t, n - 2), F.lit(1.0))
    )


def autocorrelations(lags: Sequence[int]) -> dict[str, str]:
    """SQL of sum (x_t - mu)(x_{t-k} - mu) / sum (x - mu)^2 * n / (n - k); 0 where undefined."""
    total = "sum((x - mu) * (x - mu))"
    out = {}
    for k in lags:
        cov = f"sum((x - mu) * (lag_{k} - mu))"
        out[f"autocorrelation__lag_{k}"] = (
            f"CASE WHEN count(1) > {k} AND {total} >= {_ZERO} "
            f"THEN coalesce(try_divide({cov} * count(1), {total} * (count(1) - {k})), 0D) ELSE 0D END"
        )
    return out


def fourier_features(rows: SequenceRows, terms: int) -> DataFrame:
    """(keys, __fft): interleaved Fourier sums per sequence; blocks are added term by term."""
    blocks = rows.arrays().withColumn("__fft", fourier_sums(F.col("xs"), F.col("start"), F.col("n"), terms))
    if not rows.split:
        return blocks.select(*rows.keys, "__fft")
    parts = blocks.select(*rows.keys, F.posexplode("__fft").alias("__i", "__v"))
    sums = parts.groupBy(*rows.keys, "__i").agg(F.sum("__v").alias("__v"))
    ordered = F.array_sort(F.collect_list(F.struct("__i", "__v")))
    return sums.groupBy(*rows.keys).agg(F.transform(ordered, lambda s: s["__v"]).alias("__fft"))


def compact_features(
    df: DataFrame,
    ids=None,
    step=None,
    channels: Sequence[str] | None = None,
    n_fft_coeffs: int = 25,
    max_len: int | None = None,
    legacy_ratios: bool = False,
) -> DataFrame:
    """One row per (sequence, channel) with 47 + 4 * n_fft_coeffs feature columns.

    With `legacy_ratios` the two columns `ratio_value_number_to_time_series_length` and
    `ratio_beyond_r_sigma__r_1` hold the shares of values above and below the mean.
    """
    rows = sequence_rows(df, ids, step, channels, max_len, halo=max(LAGS))
    rows = rows.with_stats({"mu": F.avg("x"), "sd": F.stddev_pop("x")})
    x = F.col("x")
    rows = rows.with_runs({"above": x > F.col("mu"), "below": x < F.col("mu")})
    rows = rows.with_columns({f"lag_{k}": F.lag("x", k).over(rows.ordered) for k in LAGS})

    aggs = moments("x") | changes("x", "position", "lag_1") | locations("x", "position")
    aggs |= {
        "count_above_mean": "double(count_if(above))",
        "count_below_mean": "double(count_if(below))",
        "longest_strike_above_mean": "double(max(above_run))",
        "longest_strike_below_mean": "double(max(below_run))",
        "variance_larger_than_standard_deviation": "double(var_pop(x) > stddev_pop(x))",
    }
    if legacy_ratios:
        aggs["ratio_value_number_to_time_series_length"] = "count_if(above) / count(1)"
        aggs["ratio_beyond_r_sigma__r_1"] = "count_if(below) / count(1)"
    else:
        if not rows.split:
            aggs["ratio_value_number_to_time_series_length"] = "size(collect_set(x)) / count(1)"
        aggs["ratio_beyond_r_sigma__r_1"] = "count_if(abs(x - mu) > sd) / count(1)"
    aggs |= autocorrelations(LAGS)
    aggs |= {f'linear_trend__attr_"{a}"': c for a, c in trend("x", "double(position)").items()}
    aggs["__n"] = "count(1)"
    names = {f"quantile__q_{q}": q for q in QUANTILES}
    final = [*aggs, *names, 'linear_trend__attr_"pvalue"']
    final.remove("__n")

    keys = list(rows.keys)
    picked = [F.expr(c).alias(name) for name, c in aggs.items()]
    if rows.split:
        out = rows.own().groupBy(*keys).agg(*picked)
        out = out.join(exact_quantiles(rows.own(), keys, "x", names), keys)
        if not legacy_ratios:
            out = out.join(distinct_share(rows.own(), keys), keys)
            final.append("ratio_value_number_to_time_series_length")
        if n_fft_coeffs > 0:
            out = out.join(fourier_features(rows, n_fft_coeffs), keys)
    else:
        # The quantiles and the ordered values ride on the same aggregation.
        picked.append(F.percentile(x, F.lit(list(QUANTILES))).alias("__q"))
        if n_fft_coeffs > 0:
            out = rows.arrays(*picked)
            out = out.withColumn("__fft", fourier_sums(F.col("xs"), F.col("start"), F.col("n"), n_fft_coeffs))
        else:
            out = rows.df.groupBy(*keys).agg(*picked)
        out = out.withColumns({name: F.col("__q")[i] for i, name in enumerate(names)})
    r = F.col('`linear_trend__attr_"rvalue"`')
    out = out.withColumn('linear_trend__attr_"pvalue"', trend_p(r, F.col("__n")))
    columns = {name: F.col(f"`{name}`") for name in final}
    if n_fft_coeffs > 0:
        columns |= fft_columns("__fft", n_fft_coeffs)
    return out.select(*keys, *[c.alias(name) for name, c in columns.items()])


def distinct_share(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct values over rows, by a histogram that combines on the map side."""
    hist = df.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("__c"))
    return hist.groupBy(*keys).agg(
        (F.count(F.lit(1)) / F.sum("__c")).alias("ratio_value_number_to_time_series_length")
    )
