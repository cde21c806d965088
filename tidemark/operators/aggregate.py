"""Grouped summaries, distributions and growth fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import null_label, ratio
from tidemark.functions.special import student_quantile
from tidemark.operators.features.basic import with_quantiles
from tidemark.operators.position import prefix_sums


def summary_statistics(df: DataFrame, group_cols: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """mean, sample std, median, min and max of each metric; missing keys are a group `none`."""
    metrics = [m for m in metrics if m in df.columns]
    rows = df.select(
        *[null_label(f"`{c}`").alias(c) for c in group_cols], *[F.col(f"`{m}`").cast("double").alias(m) for m in metrics]
    )
    aggs = []
    for m in metrics:
        x = F.col(f"`{m}`")
        aggs += [
            F.avg(x).alias(f"{m}__mean"),
            F.stddev_samp(x).alias(f"{m}__std"),
            F.min(x).alias(f"{m}__min"),
            F.max(x).alias(f"{m}__max"),
        ]
    return with_quantiles(rows, list(group_cols), metrics, aggs, {"median": 0.5})


def mean_interval(df: DataFrame, group_cols: Sequence[str], value: str, confidence: float = 0.95) -> DataFrame:
    """Mean with a Student interval; a single row has an interval of no width."""
    sums = df.groupBy(*group_cols).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )
    half = student_quantile((1 + confidence) / 2, F.col("n") - 1) * F.col("sd") / F.sqrt("n")
    half = F.when(F.col("n") > 1, half).otherwise(0.0)
    return sums.select(
        *group_cols, "n", "mean", (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper")
    )


def quartiles(df: DataFrame, group_cols: Sequence[str], value: str) -> DataFrame:
    """q25, median, q75 and the interquartile range."""
    rows = df.select(*group_cols, F.col(value).cast("double").alias("v"))
    out = with_quantiles(rows, list(group_cols), ["v"], [F.count("v").alias("n")], {"q25": 0.25, "median": 0.5, "q75": 0.75})
    out = out.withColumnsRenamed({f"v__{n}": n for n in ("q25", "median", "q75")})
    return out.withColumn("iqr", F.col("q75") - F.col("q25"))


def box_statistics(df: DataFrame, group_cols: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 IQR of the box) and the rows outside them."""
    q = quartiles(df, group_cols, value)
    rows = df.select(*group_cols, F.col(value).cast("double").alias("v"))
    # One small row per group; adaptive execution splits a group that is too long for the join.
    joined = rows.join(q, list(group_cols))
    low, high = F.col("q25") - 1.5 * F.col("iqr"), F.col("q75") + 1.5 * F.col("iqr")
    inside = (F.col("v") >= low) & (F.col("v") <= high)
    ends = joined.groupBy(*group_cols).agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outside"),
    )
    return q.join(ends, list(group_cols))


def growth_slope(df: DataFrame, group_cols: Sequence[str], size: str, time: str) -> DataFrame:
    """Slope and R2 of log time against log size."""
    x, y = F.log(F.col(size).cast("double")), F.log(F.col(time).cast("double"))
    rows = df.filter((F.col(size) > 0) & (F.col(time) > 0))
    return rows.groupBy(*group_cols).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_r2(y, x).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness; null below three values."""
    n = F.count(x)
    factor = F.try_divide(F.sqrt((n * (n - 1)).cast("double")), n - 2)
    return F.when(n > 2, F.coalesce(F.skewness(x), F.lit(0.0)) * factor)


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis; null below four values."""
    n = F.count(x).cast("double")
    g2 = F.coalesce(F.kurtosis(x), F.lit(0.0))
    return F.when(n > 3, F.try_divide((n - 1) * ((n + 1) * g2 + 6), (n - 2) * (n - 3)))


def target_profile(df: DataFrame, target: str = "target", group_cols: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles, max and corrected skewness of a target."""
    rows = df.select(*group_cols, F.col(target).cast("double").alias("t"))
    x = F.col("t")
    keys = list(group_cols)
    if not keys:
        rows, keys = rows.withColumn("scope", F.lit("all")), ["scope"]
    aggs = [
        F.count(x).alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        sample_skewness(x).alias("skew"),
    ]
    out = with_quantiles(rows, keys, ["t"], aggs, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return out.withColumnsRenamed({f"t__{n}": n for n in ("q25", "median", "q75")})


def class_sizes(df: DataFrame, target: str = "target") -> DataFrame:
    """Rows and share of each class, and the size of the smallest class."""
    sizes = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    totals = prefix_sums(sizes.withColumn("__one", F.lit(1)), ["__one"], [target], {"s": F.col("n")})
    return totals.select(target, "n", ratio("n", "s_total").alias("share"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and two order-free hash sums of the rows, with a hash of the schema."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bit_xor(h).alias("hash_xor"),
        F.sum((h % 1_000_000_007).cast("bigint")).alias("hash_sum"),
    ).withColumn("schema_hash", F.xxhash64(F.lit(df.schema.json())))


def regression_diagnostics(df: DataFrame, truth: str, prediction: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """R2 (0 if the truth is constant), RMSE, MAE and N over the pairs where both are finite."""
    y, p = F.col(truth).cast("double"), F.col(prediction).cast("double")
    big = float("inf")
    finite = ~F.isnan(y) & ~F.isnan(p) & (F.abs(y) < big) & (F.abs(p) < big)
    rows = df.filter(finite)
    err = y - p
    total = F.var_pop(y) * F.count(y)
    r2 = F.when(total > 0, 1 - F.sum(err * err) / total).otherwise(0.0)
    return rows.groupBy(*group_cols).agg(
        r2.alias("r2"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"), F.count(F.lit(1)).alias("n")
    )
