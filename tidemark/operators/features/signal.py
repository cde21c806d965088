"""Signal-processing sets: 31 statistical and 14 temporal features per channel, and a short mixed set."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import ratio
from tidemark.functions.kernels import decay_lag, threshold_complexity
from tidemark.operators.features.compact import trend
from tidemark.operators.features.long_sequences import decay_lag_table
from tidemark.operators.features.phrases import threshold_phrase_table
from tidemark.operators.features.rows import SequenceRows, sequence_rows
from tidemark.operators.position import value_ranks

HIST_BINS = 10


def _bin_counts(x: Column, lo: Column, hi: Column) -> list[Column]:
    place = F.least(F.coalesce(F.floor(F.try_divide((x - lo) * HIST_BINS, hi - lo)), F.lit(0)), F.lit(HIST_BINS - 1))
    return [F.count_if(place == b) for b in range(HIST_BINS)]


def _ranks_upto(p: float, n: Column) -> Column:
    """How many of the ranks 1..n have rank / n <= p."""
    near = F.floor(n * p)
    return near + F.when((near + 1) / n <= p, 1).when(near / n <= p, 0).otherwise(-1)


ECDF_SHARES = (0.2, 0.8)


def _order_statistics(rows: SequenceRows) -> DataFrame:
    """(keys, q: quartiles, mad: median distance from `med`, at: the values up to which the shares lie)."""
    keys = list(rows.keys)
    if not rows.split:
        xs = F.sort_array(F.collect_list("x"))
        out = rows.df.groupBy(*keys).agg(
            F.first("n").alias("n"),
            xs.alias("xs"),
            F.percentile("x", F.lit([0.25, 0.5, 0.75])).alias("q"),
            F.percentile(F.abs(F.col("x") - F.col("med")), F.lit(0.5)).alias("mad"),
        )
        at = F.array(*[F.get("xs", _ranks_upto(p, F.col("n")).cast("int") - 1) for p in ECDF_SHARES])
        return out.withColumn("at", at).drop("n", "xs")
    ranks = value_ranks(rows.own(), keys, "x")
    upto = F.col("n_before") + F.col("n")
    hits = []
    for p in ECDF_SHARES:
        place = _ranks_upto(p, F.col("n_total"))
        hits.append(F.max(F.when((F.col("n_before") < place) & (place <= upto), F.col("x"))))
    at = ranks.groupBy(*keys).agg(F.array(*hits).alias("at"))
    away = rows.with_columns({"away": F.abs(F.col("x") - F.col("med"))})
    mad = away.quantile_table("mad", [0.5], "away").withColumn("mad", F.col("mad")[0])
    return rows.quantile_table("q", [0.25, 0.5, 0.75]).join(mad, keys).join(at, keys)


def statistical_domain(
    df: DataFrame, ids=None, step=None, channels: Sequence[str] | None = None, fs: float = 1.0, max_len: int | None = None
) -> DataFrame:
    rows = sequence_rows(df, ids, step, channels, max_len, halo=1)
    rows = rows.with_stats({"mu": F.avg("x"), "lo": F.min("x"), "hi": F.max("x")})
    rows = rows.with_quantiles("med", [0.5]).with_columns({"med": F.col("med")[0]})
    x, n = F.col("x"), F.count(F.lit(1))
    keys = list(rows.keys)
    main = rows.own().groupBy(*keys).agg(
        F.first("n").alias("n"),
        F.avg(F.abs(x - F.col("mu"))).alias("Mean absolute deviation"),
        F.sum(x * x).alias("Absolute energy"),
        F.try_divide(F.sum(x * x), (n - 1) / F.lit(fs)).alias("Average power"),
        F.coalesce(F.kurtosis(x), F.lit(0.0)).alias("Kurtosis"),
        F.coalesce(F.skewness(x), F.lit(0.0)).alias("Skewness"),
        F.max(x).alias("Max"),
        F.min(x).alias("Min"),
        F.avg(x).alias("Mean"),
        (F.max(x) - F.min(x)).alias("Peak to peak distance"),
        F.sqrt(F.avg(x * x)).alias("Root mean square"),
        F.stddev_pop(x).alias("Standard deviation"),
        F.var_pop(x).alias("Variance"),
        F.array(*_bin_counts(x, F.col("lo"), F.col("hi"))).alias("bins"),
    )
    main = main.join(_order_statistics(rows), keys).withColumnRenamed("mad", "Median absolute deviation")
    # Entropy of the value frequencies, in units of the largest possible.
    hist = rows.own().groupBy(*keys, "x").agg(F.count(F.lit(1)).cast("double").alias("c"))
    c, t = F.col("c"), F.sum("c")
    # -sum(c/t log(c/t)) = log(t) - sum(c log c) / t.
    bits = F.greatest(F.log2(t) - F.sum(c * F.log2(c)) / t, F.lit(0.0))
    entropy = hist.groupBy(*keys).agg(ratio(bits, F.log2(t)).alias("Entropy"))
    best = F.array_position("bins", F.array_max("bins")) - 1
    width = (F.col("Max") - F.col("Min")) / HIST_BINS
    # numpy widens a constant range by half a unit on each side.
    flat = F.col("Max") == F.col("Min")
    left = F.when(flat, F.col("Min") - 0.5).otherwise(F.col("Min"))
    step_ = F.when(flat, F.lit(1.0 / HIST_BINS)).otherwise(width)
    place = F.when(flat, F.lit(HIST_BINS // 2)).otherwise(best)
    out = {f"ECDF_{i}": F.when(F.col("n") > i, F.lit(i + 1.0) / F.col("n")) for i in range(10)}
    for i, p in enumerate(ECDF_SHARES):
        out[f"ECDF Percentile_{i}"] = F.col("at")[i]
        out[f"ECDF Percentile Count_{i}"] = _ranks_upto(p, F.col("n")).cast("double")
    out["Histogram mode"] = left + (place + 0.5) * step_
    out["Interquartile range"] = F.col("q")[2] - F.col("q")[0]
    out["Median"] = F.col("q")[1]
    plain = [c for c in main.columns if c not in (*keys, "n", "at", "q", "bins")]
    wide = main.select(*keys, *[F.col(f"`{c}`") for c in plain], *[c.alias(n_) for n_, c in out.items()])
    return wide.join(entropy, keys)


def temporal_domain(
    df: DataFrame, ids=None, step=None, channels: Sequence[str] | None = None, fs: float = 1.0, max_len: int | None = None
) -> DataFrame:
    rows = sequence_rows(df, ids, step, channels, max_len, halo=11).with_stats({"mu": F.avg("x")})
    w = rows.ordered
    x, position = F.col("x"), F.col("position")
    n = F.count(F.lit(1))
    before, after = F.max("x").over(w.rowsBetween(-10, -1)), F.max("x").over(w.rowsBetween(1, 10))
    rows = rows.with_columns(
        {
            "prev": F.lag("x").over(w),
            "next": F.lead("x").over(w),
            "peak": (position >= 10) & (position < F.col("n") - 10) & (x > before) & (x > after),
        }
    )
    rows = rows.with_columns({"d": x - F.col("prev"), "d2": F.col("next") - x})
    d, d2 = F.col("d"), F.col("d2")
    energy = F.sum(x * x)
    aggs = {
        "Area under the curve": F.sum(0.5 * F.abs(x + F.col("prev"))) / fs,
        "Centroid": ratio(F.sum(x * x * position / fs), energy),
        "Mean absolute diff": F.avg(F.abs(d)),
        "Mean diff": F.avg(d),
        "Negative turning points": F.count_if((d < 0) & (d2 > 0)).cast("double"),
        "Positive turning points": F.count_if((d > 0) & (d2 < 0)).cast("double"),
        "Neighbourhood peaks": F.count_if("peak").cast("double"),
        "Signal distance": F.sum(F.sqrt(1 + d * d)),
        "Slope": F.expr(trend("x", "double(position)")["slope"]),
        "Sum absolute diff": F.sum(F.abs(d)),
        "Zero crossing rate": F.count_if(F.signum(x) != F.signum("prev")).cast("double"),
    }
    keys = list(rows.keys)
    names = ["Autocorrelation", "Median absolute diff", "Median diff", *aggs]
    sums = [c.alias(k) for k, c in aggs.items()]
    if rows.split:
        steps = rows.with_columns({"away": F.abs(d)}).filter("d IS NOT NULL")
        main = rows.own().groupBy(*keys).agg(*sums)
        main = main.join(steps.quantile_table("Median diff", [0.5], "d"), keys, "left")
        main = main.join(steps.quantile_table("Median absolute diff", [0.5], "away"), keys, "left")
        main = main.withColumns({c: F.col(f"`{c}`")[0] for c in ("Median diff", "Median absolute diff")})
        main = main.join(decay_lag_table(rows).withColumnRenamed("lag", "Autocorrelation"), keys, "left")
    else:
        half = F.lit(0.5)
        main = rows.arrays(
            *sums, F.percentile(d, half).alias("Median diff"), F.percentile(F.abs(d), half).alias("Median absolute diff")
        )
        lag = F.get(decay_lag(F.col("xs")), F.lit(0))
        main = main.withColumn("Autocorrelation", F.nanvl(lag, F.lit(None)))
    return main.select(*keys, *[F.col(f"`{k}`") for k in names])


def mixed_set(
    df: DataFrame,
    ids=None,
    step=None,
    channels: Sequence[str] | None = None,
    max_len: int | None = None,
) -> DataFrame:
    """Energy, binned entropy, complexity, streaks, crossings, peaks, rms and variation."""
    rows = sequence_rows(df, ids, step, channels, max_len, halo=6)
    rows = rows.with_stats({"mu": F.avg("x"), "lo": F.min("x"), "hi": F.max("x")})
    x, position, n = F.col("x"), F.col("position"), F.count(F.lit(1))
    rows = rows.with_runs({"above": x > F.col("mu"), "below": x < F.col("mu")})
    w = rows.ordered
    before, after = F.max("x").over(w.rowsBetween(-5, -1)), F.max("x").over(w.rowsBetween(1, 5))
    inner = (position >= 5) & (position < F.col("n") - 5)
    rows = rows.with_columns({"prev": F.lag("x").over(w), "peak": inner & (x > before) & (x > after)})
    d = x - F.col("prev")
    shares = [c / n for c in _bin_counts(x, F.col("lo"), F.col("hi"))]
    entropy = reduce(lambda a, b: a + b, [F.when(p > 0, -p * F.log(p)).otherwise(0.0) for p in shares])
    sums = [
        F.sum(x * x).alias("absolute_energy"),
        entropy.alias("binned_entropy"),
        F.sqrt(F.coalesce(F.sum(d * d), F.lit(0.0))).alias("cid_ce"),
        F.max("above_run").cast("double").alias("streak_above"),
        F.max("below_run").cast("double").alias("streak_below"),
        F.count_if((x > 0) != (F.col("prev") > 0)).cast("double").alias("crossings"),
        F.count_if("peak").cast("double").alias("peaks"),
        F.sqrt(F.avg(x * x)).alias("rms"),
        F.try_divide(F.stddev_pop(x), F.avg(x)).alias("var_coeff"),
    ]
    if rows.split:
        main = rows.own().groupBy(*rows.keys).agg(*sums)
        scans = rows.short().whole_arrays()
        scans = scans.select(*rows.keys, F.get(threshold_complexity(F.col("xs"), 3.0), F.lit(0)).alias("lzc"))
        scans = scans.union(threshold_phrase_table(rows.long(), 3.0))
        return main.join(scans, list(rows.keys), "left")
    main = rows.arrays(*sums)
    main = main.withColumn("lzc", F.get(threshold_complexity(F.col("xs"), 3.0), F.lit(0)))
    return main.drop("n", "start", "xs")
