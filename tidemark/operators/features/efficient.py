"""The wide sets: 777 features per channel (477 with 25 Fourier terms), and 6 more in the full set.

Most features are window functions followed by one aggregation. Those that need
the ordered values as a whole take them from an array built in that same
aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.functions.fourier import fft_columns, fourier_sums
from tidemark.operators.aggregate import sample_kurtosis, sample_skewness
from tidemark.operators.features.compact import fourier_features, locations, trend, trend_p
from tidemark.operators.features.drift import drift_from_rows
from tidemark.operators.features.entropies import entropy_table
from tidemark.operators.features.long_sequences import (
    autocovariance_table,
    mean_density,
    order_entropy_table,
    regression_table,
)
from tidemark.operators.features.phrases import phrase_table
from tidemark.operators.features.ridges import ridge_table
from tidemark.operators.features.rows import SequenceRows, sequence_rows
from tidemark.operators.features.spectrum import spectrum_moment_table
from tidemark.operators.features.unit_root import unit_root_table
from tidemark.session import cut_lineage

# Parameters of the set (fixed values).
RATIOS = [round(0.05 * i, 2) for i in range(20)]
QUANTILES = (0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9)
SIGMAS = (0.5, 1, 1.5, 2, 2.5, 3, 5, 6, 7, 10)
RANGES = ((-1, 1), (1e12, 0), (0, 1e12))
PEAK_SUPPORT = (1, 3, 5, 10, 50)
CORRIDOR = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
DECILES = [i / 10 for i in range(11)]
CHUNK_LENGTHS = (5, 10, 50)
SYMBOL_BINS = (2, 3, 5, 10, 100)
ORDER_DIMENSIONS = (3, 4, 5, 6, 7)
WELCH = (2, 5, 8)
WIDTHS = (2, 5, 10, 20)
RIDGES = (1, 5)
MATCH_SHARES = (0.1, 0.3, 0.5, 0.7, 0.9)


def _fft_name(k: int, attr: str) -> str:
    return f'fft_coefficient__attr_"{attr}"__coeff_{k}'


def _row_columns(rows: SequenceRows) -> SequenceRows:
    """Everything a row has to know about its sequence and its neighbours."""
    x, position = F.col("x"), F.col("position")
    rows = rows.with_stats(
        {
            "mu": F.avg("x"),
            "sd": F.stddev_pop("x"),
            "lo": F.min("x"),
            "hi": F.max("x"),
            "mass": F.sum(F.abs("x")),
        }
    )
    rows = rows.with_quantiles("cuts", DECILES)
    rows = rows.with_runs({"above": x > F.col("mu"), "below": x < F.col("mu")})
    w = rows.ordered
    lags = {f"lag_{k}": F.lag("x", k).over(w) for k in range(1, 10)}
    peaks = {}
    # A window looks at its whole frame for each row: whole sequences count their peaks in their arrays.
    for n in PEAK_SUPPORT if rows.split else ():
        before, after = F.max("x").over(w.rowsBetween(-n, -1)), F.max("x").over(w.rowsBetween(1, n))
        full = (position >= n) & (position < F.col("n") - n)
        peaks[f"peak_{n}"] = full & (x > before) & (x > after)
    second = {"around": F.lead("x").over(w) - 2 * x + F.lag("x").over(w)}
    rows = rows.with_columns(lags | peaks | second).with_running_sum("cum", F.abs("x"))
    span = F.col("hi") - F.col("lo")
    return rows.with_columns(
        {
            "diff": x - F.col("lag_1"),
            "bin": F.least(F.coalesce(F.floor(F.try_divide((x - F.col("lo")) * 10, span)), F.lit(0)), F.lit(9)),
            "digit": _first_digit(x),
            "chunk": _segment(position, F.col("n"), 10),
        }
    )


def _first_digit(x: Column) -> Column:
    """First digit other than 0 of the shortest decimal form; 0 for zero."""
    return F.coalesce(F.regexp_extract(F.abs(x).cast("string"), "[1-9]", 0).try_cast("int"), F.lit(0))


def _segment(position: Column, n: Column, k: int) -> Column:
    """Segment of k nearly equal parts, the first n mod k of them one longer."""
    size, rest = F.floor(n / k), n % k
    big = rest * (size + 1)
    return F.when(position < big, F.floor(position / (size + 1))).otherwise(
        rest + F.floor(F.try_divide(position - big, size))
    )


def _plain() -> dict[str, str]:
    """SQL of the features that need no order."""
    span = "(max(x) - min(x))"
    gap = "abs(avg(x) - first(cuts)[5])"
    out = {
        "sum_values": "sum(x)",
        "abs_energy": "sum(x * x)",
        "mean": "avg(x)",
        "length": "double(count(1))",
        "standard_deviation": "stddev_pop(x)",
        "variance": "var_pop(x)",
        "variation_coefficient": "try_divide(stddev_pop(x), avg(x))",
        "root_mean_square": "sqrt(avg(x * x))",
        "maximum": "max(x)",
        "minimum": "min(x)",
        "absolute_maximum": "max(abs(x))",
        "variance_larger_than_standard_deviation": "double(var_pop(x) > stddev_pop(x))",
        "count_above__t_0": "count_if(x >= 0) / count(1)",
        "count_below__t_0": "count_if(x <= 0) / count(1)",
        "has_duplicate_max": "double(count_if(x = hi) >= 2)",
        "has_duplicate_min": "double(count_if(x = lo) >= 2)",
    }
    out |= {f"large_standard_deviation__r_{r}": f"double(stddev_pop(x) > {r}D * {span})" for r in RATIOS[1:]}
    out |= {f"symmetry_looking__r_{r}": f"double({gap} < {r}D * {span})" for r in RATIOS}
    out |= {f"value_count__value_{v}": f"double(count_if(x = {v}))" for v in (0, 1, -1)}
    out |= {
        f"range_count__max_{hi}__min_{lo}": f"double(count_if(x >= {float(lo)!r}D AND x < {float(hi)!r}D))"
        for lo, hi in RANGES
    }
    out |= {f"ratio_beyond_r_sigma__r_{r}": f"count_if(abs(x - mu) > {r} * sd) / count(1)" for r in SIGMAS}
    return out


def _ordered() -> dict[str, str]:
    """SQL of the features of neighbouring rows and of places in the sequence."""
    out = {
        "mean_change": "try_divide(max_by(x, position) - min_by(x, position), count(1) - 1)",
        "mean_abs_change": "avg(abs(diff))",
        "absolute_sum_of_changes": "coalesce(sum(abs(diff)), 0D)",
        "mean_second_derivative_central": "CASE WHEN count(1) > 2 THEN sum(around) / (2 * (count(1) - 2)) END",
        "count_above_mean": "double(count_if(above))",
        "count_below_mean": "double(count_if(below))",
        "longest_strike_above_mean": "double(max(above_run))",
        "longest_strike_below_mean": "double(max(below_run))",
        "cid_ce__normalize_False": "sqrt(coalesce(sum(diff * diff), 0D))",
        "cid_ce__normalize_True": "coalesce(try_divide(sqrt(sum(diff * diff)), stddev_pop(x)), 0D)",
    }
    out |= locations("x", "position", last_shift=1)
    for k in (1, 2, 3):
        a, b = f"lag_{k}", f"lag_{2 * k}"
        out[f"c3__lag_{k}"] = f"coalesce(avg(x * {a} * {b}), 0D)"
        out[f"time_reversal_asymmetry_statistic__lag_{k}"] = f"coalesce(avg(x * x * {a} - {a} * {b} * {b}), 0D)"
    for m in (0, -1, 1):
        out[f"number_crossing_m__m_{m}"] = f"double(count_if((x > {m}) != (lag_1 > {m})))"
    out |= {f"number_peaks__n_{k}": f"double(count_if(peak_{k}))" for k in PEAK_SUPPORT}
    out |= _corridor_changes()
    for s in range(10):
        out[f"energy_ratio_by_chunks__num_segments_10__segment_focus_{s}"] = (
            f"try_divide(sum(CASE WHEN chunk = {s} THEN x * x ELSE 0D END), sum(x * x))"
        )
    for q in QUANTILES:
        # Both sums round by the order of their rows; a mass that meets the share within that counts as reached.
        reached = f"min(CASE WHEN cum >= ({q}D - (n + 8) * 2.3e-16D) * mass THEN position END)"
        out[f"index_mass_quantile__q_{q}"] = f"CASE WHEN max(mass) > 0 THEN ({reached} + 1) / count(1) END"
    out["autocorrelation__lag_0"] = "CASE WHEN var_pop(x) > 0 THEN 1D END"
    for k in range(1, 10):
        out[f"autocorrelation__lag_{k}"] = (
            f"CASE WHEN count(1) > {k} AND var_pop(x) > 0 "
            f"THEN try_divide(sum((x - mu) * (lag_{k} - mu)), (count(1) - {k}) * var_pop(x)) END"
        )
    out |= {f'linear_trend__attr_"{a}"': c for a, c in trend("x", "double(position)").items()}
    return out


# Pairs of quantiles, by their places in the deciles.
CORRIDORS = [(2 * i, 2 * j) for i in range(len(CORRIDOR) - 1) for j in range(i + 1, len(CORRIDOR))]


def _corridor_changes() -> dict[str, str]:
    """Mean and variance of the changes between rows that both lie between two quantiles."""
    out = {}
    for i, low in enumerate(CORRIDOR[:-1]):
        for j in range(i + 1, len(CORRIDOR)):
            a, b = f"cuts[{2 * i}]", f"cuts[{2 * j}]"
            inside = f"{a} < {b} AND x BETWEEN {a} AND {b} AND lag_1 BETWEEN {a} AND {b}"
            for absolute, step in ((False, "diff"), (True, "abs(diff)")):
                for name, fn in (("mean", "avg"), ("var", "var_pop")):
                    key = f'change_quantiles__f_agg_"{name}"__isabs_{absolute}__qh_{CORRIDOR[j]}__ql_{low}'
                    out[key] = f"coalesce({fn}(CASE WHEN {inside} THEN {step} END), 0D)"
    return out


def _histograms() -> dict[str, str]:
    """Entropy over ten equal-width bins, and the fit of the first digits to Benford's law."""
    shares = [f"(count_if(bin = {b}) / count(1))" for b in range(10)]
    entropy = " + ".join(f"CASE WHEN {p} > 0 THEN -{p} * ln({p}) ELSE 0D END" for p in shares)
    law = [math.log10(1 + 1 / d) for d in range(1, 10)]
    middle = sum(law) / 9
    seen = [f"(count_if(digit = {d}) / count(1))" for d in range(1, 10)]
    mean = "(count_if(digit > 0) / count(1) / 9)"
    cov = " + ".join(f"({s} - {mean}) * ({w - middle!r}D)" for s, w in zip(seen, law))
    var = " + ".join(f"({s} - {mean}) * ({s} - {mean})" for s in seen)
    spread = math.sqrt(sum((w - middle) ** 2 for w in law))
    return {
        "binned_entropy__max_bins_10": entropy,
        "benford_correlation": f"try_divide({cov}, sqrt({var}) * {spread!r}D)",
    }


def _value_histogram(rows: SequenceRows) -> DataFrame:
    """Features of repeated values, from one row per distinct value."""
    hist = rows.own().groupBy(*rows.keys, "x").agg(F.count(F.lit(1)).alias("c"))
    again = F.col("c") > 1
    n, kinds = F.sum("c"), F.count(F.lit(1))
    return hist.groupBy(*rows.keys).agg(
        (F.max("c") > 1).cast("double").alias("has_duplicate"),
        (F.count_if(again) / kinds).alias("percentage_of_reoccurring_values_to_all_values"),
        (F.sum(F.when(again, F.col("c")).otherwise(0)) / n).alias("percentage_of_reoccurring_datapoints_to_all_datapoints"),
        F.sum(F.when(again, F.col("x")).otherwise(0.0)).alias("sum_of_reoccurring_values"),
        F.sum(F.when(again, F.col("x") * F.col("c")).otherwise(0.0)).alias("sum_of_reoccurring_data_points"),
        (kinds / n).alias("ratio_value_number_to_time_series_length"),
    )


def _chunk_trends(rows: SequenceRows) -> DataFrame:
    """Trend over the chunk number of the max, min, mean and variance of chunks of fixed length."""
    sizes = F.explode(F.array(*[F.lit(c) for c in CHUNK_LENGTHS]))
    cut = rows.own().select(*rows.keys, "position", "x", sizes.alias("size"))
    cut = cut.withColumn("chunk", F.floor(F.col("position") / F.col("size")))
    parts = cut.groupBy(*rows.keys, "size", "chunk").agg(
        F.max("x").alias("max"), F.min("x").alias("min"), F.avg("x").alias("mean"), F.var_pop("x").alias("var")
    )
    aggs = []
    for size in CHUNK_LENGTHS:
        for f in ("max", "min", "mean", "var"):
            mine = f"CASE WHEN size = {size} THEN `{f}` END"
            for attr, value in trend(mine, f"CASE WHEN size = {size} THEN double(chunk) END").items():
                name = f'agg_linear_trend__attr_"{attr}"__chunk_len_{size}__f_agg_"{f}"'
                aggs.append(F.expr(f"CASE WHEN count({mine}) > 1 THEN {value} END").alias(name))
    return parts.groupBy(*rows.keys).agg(*aggs)


def _largest(xs: Column) -> Column:
    """The seven largest absolute values."""
    return F.slice(F.sort_array(F.transform(xs, lambda v: F.abs(v)), asc=False), 1, 7)


def _array_features(
    xs: Column, query: Sequence[float] | None, threshold: float, comprehensive: bool
) -> dict[str, tuple]:
    """Array-valued columns with the names of their entries."""
    complexity = [f"lempel_ziv_complexity__bins_{b}" for b in SYMBOL_BINS]
    out = {
        "moments": (K.spectrum_moments(xs), [f'fft_aggregated__aggtype_"{a}"' for a in ("centroid", "variance", "skew", "kurtosis")]),
        "welch": (K.welch_coefficients(xs, WELCH), [f"spkt_welch_density__coeff_{c}" for c in WELCH]),
        "waves": (
            K.wavelet_coefficients(xs, WIDTHS, 15),
            [f"cwt_coefficients__coeff_{c}__w_{w}__widths_{WIDTHS}" for w in WIDTHS for c in range(15)],
        ),
        "ridges": (K.wavelet_peaks(xs, RIDGES), [f"number_cwt_peaks__n_{n}" for n in RIDGES]),
        "ar": (K.autoregression(xs, 10), [f"ar_coefficient__coeff_{c}__k_10" for c in range(11)]),
        "pacf": (K.partial_autocorrelations(xs, 9), [f"partial_autocorrelation__lag_{k}" for k in range(10)]),
        "acf": (
            K.autocorrelation_summary(xs, 40),
            [f'agg_autocorrelation__f_agg_"{a}"__maxlag_40' for a in ("mean", "median", "var")],
        ),
        "root": (
            K.unit_root(xs),
            [f'augmented_dickey_fuller__attr_"{a}"__autolag_"AIC"' for a in ("teststat", "pvalue", "usedlag")],
        ),
        "phrases": (K.phrase_complexity(xs, SYMBOL_BINS), complexity),
        "spectral": (K.spectrum_entropy(xs, SYMBOL_BINS), [f"fourier_entropy__bins_{b}" for b in SYMBOL_BINS]),
        "orders": (
            K.order_entropy(xs, ORDER_DIMENSIONS),
            [f"permutation_entropy__dimension_{d}__tau_1" for d in ORDER_DIMENSIONS],
        ),
        "query": (
            K.similar_windows(xs, query, threshold) if query else F.array(F.lit(None).cast("double")),
            [f"query_similarity_count__query_{list(query) if query else None}__threshold_{threshold}"],
        ),
    }
    if comprehensive:
        out["sample"] = (K.sample_entropy(xs), ["sample_entropy"])
        out["approximate"] = (
            K.approximate_entropy(xs, 2, MATCH_SHARES), [f"approximate_entropy__m_2__r_{r}" for r in MATCH_SHARES]
        )
    return out


def _long_array_features(
    long: SequenceRows, first: DataFrame, query: Sequence[float] | None, threshold: float, comprehensive: bool
) -> DataFrame:
    """The array features of sequences of several blocks; `first` has their first blocks. Rows carry `mu`, `sd`, `lo`, `hi`."""
    keys = list(long.keys)
    out = first.select(*keys, K.wavelet_coefficients(F.col("xs"), WIDTHS, 15).alias("__a_waves"))
    spectra = mean_density(long).select(
        *keys,
        F.array(*[F.get("density", F.lit(c)) for c in WELCH]).alias("__a_welch"),
        K.density_entropy(F.col("density"), SYMBOL_BINS).alias("__a_spectral"),
    )
    covariances = autocovariance_table(long, 40).select(
        *keys,
        K.covariance_summary(F.col("covariances")).alias("__a_acf"),
        K.covariance_partials(F.slice("covariances", 1, 10), 9).alias("__a_pacf"),
    )
    regression = regression_table(long, 10).withColumnRenamed("coefficients", "__a_ar")
    patterns = order_entropy_table(long, ORDER_DIMENSIONS).withColumnRenamed("entropies", "__a_orders")
    for part in (spectra, covariances, regression, patterns):
        out = out.join(part, keys)
    # Some of these leave out sequences with values that are not finite.
    parts = [
        spectrum_moment_table(long).withColumnRenamed("moments", "__a_moments"),
        ridge_table(long, RIDGES).withColumnRenamed("ridges", "__a_ridges"),
        unit_root_table(long).withColumnRenamed("root", "__a_root"),
        phrase_table(long, SYMBOL_BINS).withColumnRenamed("complexities", "__a_phrases"),
    ]
    if comprehensive:
        parts.append(entropy_table(long, MATCH_SHARES).withColumnsRenamed({"sample": "__a_sample", "approximate": "__a_approximate"}))
    for part in parts:
        out = out.join(part, keys, "left")
    if not query:
        return out.withColumn("__a_query", F.array(F.lit(None).cast("double")))
    span = long.ordered.rowsBetween(1 - len(query), 0)
    windows = long.with_columns({"w": F.collect_list("x").over(span)}).own()
    hits = F.get(K.similar_windows(F.col("w"), query, threshold), F.lit(0))
    counts = windows.groupBy(*keys).agg(F.array(F.sum(F.nanvl(hits, F.lit(0.0)))).alias("__a_query"))
    return out.join(counts, keys)


def efficient_features(
    df: DataFrame,
    ids=None,
    step=None,
    channels: Sequence[str] | None = None,
    fft_coefficients: int = 100,
    max_len: int | None = None,
    comprehensive: bool = False,
    query: Sequence[float] | None = None,
    threshold: float = 0.0,
) -> DataFrame:
    """One row per (sequence, channel); undefined features are null. Sequences of any length are taken: one that no single
    task may hold is worked on in blocks, for every feature."""
    rows = sequence_rows(df, ids, step, channels, max_len, halo=max(64, len(query or ())))
    base = rows
    rows = _row_columns(rows)
    keys = list(rows.keys)
    x = F.col("x")
    aggs = {n: F.expr(c) for n, c in (_plain() | _ordered() | _histograms()).items()}
    aggs |= {"skewness": sample_skewness(x), "kurtosis": sample_kurtosis(x)}
    plain, peaks, changes = list(aggs), [f"number_peaks__n_{k}" for k in PEAK_SUPPORT], list(_corridor_changes())
    if not rows.split:
        aggs = {n: c for n, c in aggs.items() if n not in {*peaks, *changes}}
    sums = [*[c.alias(n) for n, c in aggs.items()], F.first("cuts").alias("cuts")]
    terms = max(1, fft_coefficients)
    if rows.split:
        main = rows.own().groupBy(*keys).agg(F.first("n").alias("n"), *sums)
        blocks = base.arrays()
        tops = blocks.select(*keys, _largest(F.col("xs")).alias("__top"))
        tops = tops.groupBy(*keys).agg(_largest(F.flatten(F.collect_list("__top"))).alias("__top"))
        arrays = _array_features(F.col("xs"), query, threshold, comprehensive)
        short = base.short().whole_arrays()
        short = short.select(*keys, *[c.alias(f"__a_{n}") for n, (c, _names) in arrays.items()])
        long = base.long().with_stats({"mu": F.avg("x"), "sd": F.stddev_pop("x"), "lo": F.min("x"), "hi": F.max("x")})
        long = replace(long, df=cut_lineage(long.df))
        first = blocks.filter((F.col("start") == 0) & (F.col("n") > base.task_rows)).select(*keys, "xs")
        spread = _long_array_features(long, first, query, threshold, comprehensive)
        parts = [tops, short.unionByName(spread), fourier_features(base, terms)]
    else:
        main = rows.arrays(*sums)
        xs = F.col("xs")
        arrays = _array_features(xs, query, threshold, comprehensive) | {
            "peaks": (K.peak_counts(xs, PEAK_SUPPORT), peaks),
            "changes": (K.corridor_changes(xs, F.col("cuts"), CORRIDORS), changes),
        }
        sums = fourier_sums(xs, F.col("start"), F.col("n"), terms)
        made = {f"__a_{n}": c for n, (c, _names) in arrays.items()} | {"__fft": sums, "__top": _largest(xs)}
        parts = []
    # The narrow tables meet first; the hundreds of columns are spelt out once, at the end.
    named = [_value_histogram(base), _chunk_trends(base), drift_from_rows(base)]
    for part in [*parts, *named]:
        main = main.join(part, keys)
    if not rows.split:
        main = main.withColumns(made)
    # Terms above n / 2 do not exist.
    exist = F.slice("__fft", F.lit(1), 2 * (F.floor(F.col("n") / 2) + 1).cast("int"))
    main = main.withColumns({"__fft": exist, "__top": F.aggregate("__top", F.lit(0.0), lambda a, v: a + v) / 7})

    plain += [n for part in named for n in part.columns if n not in keys]
    out = {n: F.col(f"`{n}`") for n in plain}
    out["median"] = F.expr("cuts[5]")
    out |= {f"quantile__q_{q}": F.expr(f"cuts[{round(10 * q)}]") for q in QUANTILES}
    out["mean_n_absolute_max__number_of_maxima_7"] = F.when(F.col("n") > 7, F.col("__top"))
    out['linear_trend__attr_"pvalue"'] = trend_p(F.col('`linear_trend__attr_"rvalue"`'), F.col("n"))
    for n, (_c, names) in arrays.items():
        out |= {name: F.expr(f"get(__a_{n}, {i})") for i, name in enumerate(names)}
    if not rows.split:
        # Arrays come back with null for NaN; changes are never missing.
        out |= {n: F.coalesce(out[n], F.lit(float("nan"))) for n in changes}
    out |= fft_columns("__fft", fft_coefficients, _fft_name)
    return main.select(*keys, *[c.alias(n) for n, c in out.items()])
