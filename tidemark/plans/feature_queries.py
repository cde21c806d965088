"""Queries over the wide sets, the signal sets, the drift set, stored features and streams."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from tidemark.operators.features import drift, efficient, signal
from tidemark.operators.features.basic import statistical_features
from tidemark.operators.features.calculators import calculate, merge_domains
from tidemark.operators.features.extractors import extract
from tidemark.operators.features.rows import features_long
from tidemark.operators.selection import run_selector
from tidemark.plans.registry import digits, query, rounded, rounded_sql, table
from tidemark.plans.window_queries import CTE, POSITIONS, WINDOW, event_windows
from tidemark.session import MAX_GROUP_ROWS, cut_lineage, ensure_checkpoint_dir, limit
from tidemark.sources.store import FeatureStore
from tidemark.sources.tables import read_pair, validate_pair, write_pair
from tidemark.streaming.count_windows import stream_count_windows
from tidemark.streaming.features import latest_features, stream_sequence_features, windowed_statistics

ORDER = ["ts", "event_id"]


def user_series(spark, sf_dir):
    return table(spark, sf_dir, "events")


def wide_set(spark, sf_dir, terms=5):
    return efficient.efficient_features(user_series(spark, sf_dir), "user_id", ORDER, ["value"], terms)


# The rows of each user in order, with mean, deviation, extremes, lags and leads.
SERIES = f"""WITH {POSITIONS},
src AS (SELECT user_id AS id, p, n, value AS x FROM pos),
st AS (SELECT *, avg(x) OVER w AS mu, stddev_pop(x) OVER w AS sd, min(x) OVER w AS lo, max(x) OVER w AS hi,
  sum(abs(x)) OVER w AS mass, sum(x * x) OVER w AS energy, sum(abs(x)) OVER (PARTITION BY id ORDER BY p) AS cum
  FROM src WINDOW w AS (PARTITION BY id)),
base AS (SELECT *, {", ".join(f"lag(x, {k}) OVER o AS l{k}" for k in range(1, 10))}, lead(x) OVER o AS nx
  FROM st WINDOW o AS (PARTITION BY id ORDER BY p))"""


def _compare(names: dict[str, str], decimals: dict[str, int], spark, sf_dir):
    """The named features of the wide set under short names, rounded."""
    wide = wide_set(spark, sf_dir)
    short = wide.select("user_id", *[F.col(f"`{long}`").alias(s) for s, long in names.items()])
    return rounded(short, ["user_id"], decimals)


_PLAIN = {
    "total": ("sum_values", "sum(x)", 4),
    "variation": ("variation_coefficient", "max(sd) / avg(x)", 6),
    "skew": ("skewness", "skewness(x)", 6),
    "kurt": ("kurtosis", "kurtosis(x)", 5),
    "large_sd": ("large_standard_deviation__r_0.25", "(max(sd) > 0.25 * (max(x) - min(x)))::INTEGER", 0),
    "symmetry": ("symmetry_looking__r_0.05", "(abs(avg(x) - median(x)) < 0.05 * (max(x) - min(x)))::INTEGER", 0),
    "in_range": ("range_count__max_1__min_-1", "count(*) FILTER (x >= -1 AND x < 1)", 0),
    "above_zero": ("count_above__t_0", "avg((x >= 0)::INTEGER)", 6),
    "beyond": ("ratio_beyond_r_sigma__r_1.5", "avg((abs(x - mu) > 1.5 * sd)::INTEGER)", 6),
    "dup_max": ("has_duplicate_max", "(count(*) FILTER (x = hi) >= 2)::INTEGER", 0),
    "c3": ("c3__lag_2", "coalesce(avg(x * l2 * l4), 0)", 2),
    "asymmetry": ("time_reversal_asymmetry_statistic__lag_1", "coalesce(avg(x * x * l1 - l1 * l2 * l2), 0)", 2),
    "complexity": ("cid_ce__normalize_True", "sqrt(sum(pow(x - l1, 2))) / max(sd)", 6),
    "crossings": ("number_crossing_m__m_1", "count(*) FILTER ((x > 1) <> (l1 > 1))", 0),
    "second": ("mean_second_derivative_central", "sum(nx - 2 * x + l1) / (2 * (count(*) - 2))", 6),
    "chunk_energy": (
        "energy_ratio_by_chunks__num_segments_10__segment_focus_3",
        "sum(CASE WHEN seg = 3 THEN x * x ELSE 0 END) / max(energy)",
        6,
    ),
    "mass": ("index_mass_quantile__q_0.6", "(min(p) FILTER (cum >= 0.6 * mass) + 1) / count(*)", 6),
    "ac3": (
        "autocorrelation__lag_3",
        "sum((x - mu) * (l3 - mu)) / ((count(*) - 3) * var_pop(x))",
        6,
    ),
    "last_max": ("last_location_of_maximum", "(max(p) FILTER (x = hi) + 1) / count(*)", 6),
}


@query(
    "wide_set_window_features",
    rounded_sql(
        f"{SERIES}, cut AS (SELECT *, ntile(10) OVER (PARTITION BY id ORDER BY p) - 1 AS seg FROM base) SELECT id AS user_id, "
        + ", ".join(f"{sql} AS {s}" for s, (_n, sql, _d) in _PLAIN.items())
        + " FROM cut GROUP BY 1",
        ["user_id"],
        {s: d for s, (_n, _s, d) in _PLAIN.items()},
    ),
)
def _(spark, sf_dir):
    return _compare({s: n for s, (n, _s, _d) in _PLAIN.items()}, {s: d for s, (_n, _s, d) in _PLAIN.items()}, spark, sf_dir)


_HIST = {
    "dup": "has_duplicate",
    "again_values": "percentage_of_reoccurring_values_to_all_values",
    "again_points": "percentage_of_reoccurring_datapoints_to_all_datapoints",
    "sum_values": "sum_of_reoccurring_values",
    "sum_points": "sum_of_reoccurring_data_points",
    "distinct_share": "ratio_value_number_to_time_series_length",
}


@query(
    "wide_set_value_histogram",
    rounded_sql(
        """WITH h AS (SELECT user_id, value AS x, count(*) AS c FROM events GROUP BY 1, 2)
SELECT user_id, (max(c) > 1)::INTEGER AS dup, count(*) FILTER (c > 1) / count(*) AS again_values,
coalesce(sum(c) FILTER (c > 1), 0) / sum(c) AS again_points, coalesce(sum(x) FILTER (c > 1), 0) AS sum_values,
coalesce(sum(x * c) FILTER (c > 1), 0) AS sum_points, count(*) / sum(c) AS distinct_share FROM h GROUP BY 1""",
        ["user_id"],
        digits(list(_HIST)),
    ),
)
def _(spark, sf_dir):
    return _compare(_HIST, digits(list(_HIST)), spark, sf_dir)


_CHUNKS = {
    f"{f}_{attr}": f'agg_linear_trend__attr_"{attr}"__chunk_len_5__f_agg_"{f}"'
    for f in ("max", "mean")
    for attr in ("slope", "intercept", "rvalue")
}


@query(
    "wide_set_chunk_trends",
    rounded_sql(
        f"""WITH {POSITIONS}, c AS (SELECT user_id, (p // 5)::DOUBLE AS t, max(value) AS hi, avg(value) AS m FROM pos GROUP BY 1, 2)
SELECT user_id, regr_slope(hi, t) AS max_slope, regr_intercept(hi, t) AS max_intercept, corr(hi, t) AS max_rvalue,
regr_slope(m, t) AS mean_slope, regr_intercept(m, t) AS mean_intercept, corr(m, t) AS mean_rvalue FROM c GROUP BY 1""",
        ["user_id"],
        digits(list(_CHUNKS), 3),
    ),
)
def _(spark, sf_dir):
    return _compare(_CHUNKS, digits(list(_CHUNKS), 3), spark, sf_dir)


_CHANGES = {
    "mean_mid": 'change_quantiles__f_agg_"mean"__isabs_True__qh_0.8__ql_0.2',
    "var_mid": 'change_quantiles__f_agg_"var"__isabs_False__qh_0.8__ql_0.2',
    "mean_all": 'change_quantiles__f_agg_"mean"__isabs_False__qh_1.0__ql_0.0',
}


@query(
    "wide_set_corridor_changes",
    rounded_sql(
        f"""{SERIES}, q AS (SELECT id, quantile_cont(x, 0.2) AS a, quantile_cont(x, 0.8) AS b FROM src GROUP BY 1)
SELECT id AS user_id, coalesce(avg(abs(x - l1)) FILTER (x BETWEEN a AND b AND l1 BETWEEN a AND b), 0) AS mean_mid,
coalesce(var_pop(x - l1) FILTER (x BETWEEN a AND b AND l1 BETWEEN a AND b), 0) AS var_mid, avg(x - l1) AS mean_all
FROM base JOIN q USING (id) GROUP BY 1""",
        ["user_id"],
        {"mean_mid": 5, "var_mid": 2, "mean_all": 6},
    ),
)
def _(spark, sf_dir):
    return _compare(_CHANGES, {"mean_mid": 5, "var_mid": 2, "mean_all": 6}, spark, sf_dir)


_PEAKS = {f"peaks_{n}": f"number_peaks__n_{n}" for n in (1, 3, 5)}


def _peak_sql(n: int) -> str:
    sides = " AND ".join(
        f"x > lag(x, {k}) OVER o AND x > lead(x, {k}) OVER o" for k in range(1, n + 1)
    )
    return f"({sides}) AS k{n}"


@query(
    "wide_set_peaks",
    rounded_sql(
        f"""{SERIES}, k AS (SELECT id, {", ".join(_peak_sql(n) for n in (1, 3, 5))} FROM src WINDOW o AS (PARTITION BY id ORDER BY p))
SELECT id AS user_id, count(*) FILTER (k1) AS peaks_1, count(*) FILTER (k3) AS peaks_3, count(*) FILTER (k5) AS peaks_5 FROM k GROUP BY 1""",
        ["user_id"],
        digits(list(_PEAKS), 0),
    ),
)
def _(spark, sf_dir):
    return _compare(_PEAKS, digits(list(_PEAKS), 0), spark, sf_dir)


_SHARES = {"entropy": "binned_entropy__max_bins_10", "benford": "benford_correlation"}


@query(
    "wide_set_histograms",
    rounded_sql(
        f"""{SERIES}, b AS (SELECT id, least(floor((x - lo) * 10 / (hi - lo)), 9) AS bin, left(printf('%.12e', abs(x)), 1)::INTEGER AS digit FROM st),
e AS (SELECT id, -sum(c / t * ln(c / t)) AS entropy FROM (SELECT id, bin, count(*) AS c, sum(count(*)) OVER (PARTITION BY id) AS t FROM b GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT unnest(range(1, 10)) AS digit), ids AS (SELECT DISTINCT id FROM src),
f AS (SELECT ids.id, d.digit, log10(1 + 1.0::DOUBLE / d.digit) AS law, count(b.digit) AS seen FROM ids CROSS JOIN d LEFT JOIN b ON b.id = ids.id AND b.digit = d.digit GROUP BY 1, 2)
SELECT id AS user_id, max(entropy) AS entropy, corr(law, seen) AS benford FROM f JOIN e USING (id) GROUP BY 1""",
        ["user_id"],
        digits(list(_SHARES)),
    ),
)
def _(spark, sf_dir):
    return _compare(_SHARES, digits(list(_SHARES)), spark, sf_dir)


_SPECTRUM = {f"spec_{a}": f'fft_aggregated__aggtype_"{a}"' for a in ("centroid", "variance", "skew", "kurtosis")}
_SPECTRUM_DIGITS = {"spec_centroid": 5, "spec_variance": 4, "spec_skew": 4, "spec_kurtosis": 3}


@query(
    "wide_set_spectrum",
    rounded_sql(
        f"""{SERIES}, k AS (SELECT id, n, unnest(range(0, n // 2 + 1)) AS k FROM (SELECT DISTINCT id, n FROM src)),
amp AS (SELECT id, k, sqrt(pow(sum(x * cos(2 * pi() * k * p / k.n)), 2) + pow(sum(x * sin(2 * pi() * k * p / k.n)), 2)) AS a
  FROM src JOIN k USING (id) GROUP BY 1, 2),
m AS (SELECT id, sum(a * k) / sum(a) AS m1, sum(a * k * k) / sum(a) AS m2, sum(a * pow(k, 3)) / sum(a) AS m3, sum(a * pow(k, 4)) / sum(a) AS m4
  FROM amp GROUP BY 1), v AS (SELECT *, m2 - m1 * m1 AS var FROM m)
SELECT id AS user_id, m1 AS spec_centroid, var AS spec_variance, (m3 - 3 * m1 * var - pow(m1, 3)) / pow(var, 1.5) AS spec_skew,
(m4 - 4 * m1 * m3 + 6 * m2 * m1 * m1 - 3 * m1) / (var * var) AS spec_kurtosis FROM v""",
        ["user_id"],
        _SPECTRUM_DIGITS,
    ),
)
def _(spark, sf_dir):
    return _compare(_SPECTRUM, _SPECTRUM_DIGITS, spark, sf_dir)


_LAGS = {f"acf_{a}": f'agg_autocorrelation__f_agg_"{a}"__maxlag_40' for a in ("mean", "median", "var")} | {
    "partial_1": "partial_autocorrelation__lag_1",
    "partial_2": "partial_autocorrelation__lag_2",
}


@query(
    "wide_set_autocorrelation_summary",
    rounded_sql(
        f"""{SERIES}, c AS (SELECT a.id, b.p - a.p AS k, sum((a.x - a.mu) * (b.x - b.mu)) / count(*) / max(a.sd * a.sd) AS r
  FROM st a JOIN st b ON a.id = b.id AND b.p > a.p AND b.p <= a.p + 40 GROUP BY 1, 2)
SELECT id AS user_id, avg(r) AS acf_mean, median(r) AS acf_median, var_pop(r) AS acf_var, max(r) FILTER (k = 1) AS partial_1,
max((r2 - r1 * r1) / (1 - r1 * r1)) AS partial_2
FROM c JOIN (SELECT id, max(r) FILTER (k = 1) AS r1, max(r) FILTER (k = 2) AS r2 FROM c GROUP BY 1) USING (id) GROUP BY 1""",
        ["user_id"],
        digits(list(_LAGS)),
    ),
)
def _(spark, sf_dir):
    return _compare(_LAGS, digits(list(_LAGS)), spark, sf_dir)


_PATTERNS = {f"order_{d}": f"permutation_entropy__dimension_{d}__tau_1" for d in (3, 5)}


def _pattern_sql(d: int) -> str:
    """Rank of each of the d latest values among them, ties by place, as text."""
    names = [f"l{k}" for k in range(d - 1, 0, -1)] + ["x"]
    ranks = []
    for i, a in enumerate(names):
        terms = [f"({b} {'<=' if j < i else '<'} {a})::INTEGER" for j, b in enumerate(names) if j != i]
        ranks.append(f"({' + '.join(terms)})::VARCHAR")
    return " || ".join(ranks)


def _pattern_entropy(d: int) -> str:
    return f"""(SELECT id, -sum(c / t * ln(c / t)) AS order_{d} FROM (SELECT id, w, count(*) AS c, sum(count(*)) OVER (PARTITION BY id) AS t
FROM (SELECT id, {_pattern_sql(d)} AS w FROM base WHERE p >= {d - 1}) GROUP BY 1, 2) GROUP BY 1)"""


@query(
    "wide_set_order_patterns",
    rounded_sql(
        f"{SERIES} SELECT id AS user_id, order_3, order_5 FROM {_pattern_entropy(3)} JOIN {_pattern_entropy(5)} USING (id)",
        ["user_id"],
        digits(list(_PATTERNS)),
    ),
)
def _(spark, sf_dir):
    return _compare(_PATTERNS, digits(list(_PATTERNS)), spark, sf_dir)


_WAVES = {f"wave_{w}_{c}": f"cwt_coefficients__coeff_{c}__w_{w}__widths_{efficient.WIDTHS}" for w, c in ((2, 0), (2, 5), (5, 3), (20, 14))}


def _wave_sql(w: int, c: int) -> str:
    """Sum of the values times the Ricker wave of width w centred near place c."""
    points = f"least({10 * w}, n)"
    place = f"({c} + ({points} - 1) // 2 - p)"
    t = f"({place} - ({points} - 1) / 2.0::DOUBLE)"
    wave = f"2 / (sqrt(3 * {w}) * pow(pi(), 0.25)) * (1 - pow({t}, 2) / {w * w}) * exp(-pow({t}, 2) / {2 * w * w})"
    inside = f"{place} >= 0 AND {place} < {points}"
    return f"CASE WHEN max(n) > {c} THEN coalesce(sum(x * {wave}) FILTER ({inside}), 0) END AS wave_{w}_{c}"


@query(
    "wide_set_wavelets",
    rounded_sql(
        f"{SERIES} SELECT id AS user_id, {', '.join(_wave_sql(w, c) for w, c in ((2, 0), (2, 5), (5, 3), (20, 14)))} FROM src GROUP BY 1",
        ["user_id"],
        digits(list(_WAVES), 5),
    ),
)
def _(spark, sf_dir):
    return _compare(_WAVES, digits(list(_WAVES), 5), spark, sf_dir)


_DENSITY = {f"density_{c}": f"spkt_welch_density__coeff_{c}" for c in (2, 5, 8)} | {"spectral_entropy": "fourier_entropy__bins_10"}
_DENSITY_DIGITS = {"density_2": 3, "density_5": 3, "density_8": 3, "spectral_entropy": 6}


@query(
    "wide_set_periodogram",
    rounded_sql(
        f"""{SERIES}, shape AS (SELECT id, n, least(n, 256) AS size, greatest(1, least(n, 256) - least(n, 256) // 2) AS hop FROM (SELECT DISTINCT id, n FROM src)),
seg AS (SELECT *, unnest(range(0, (n - size) // hop + 1)) AS s FROM shape),
part AS (SELECT id, s, size, p - s * hop AS j, x - avg(x) OVER (PARTITION BY id, s) AS v, 0.5 - 0.5 * cos(2 * pi() * (p - s * hop) / size) AS hann
  FROM src JOIN seg USING (id) WHERE p >= s * hop AND p < s * hop + size),
freq AS (SELECT id, s, size, unnest(range(0, size // 2 + 1)) AS k FROM seg),
power AS (SELECT id, s, k, (pow(sum(v * hann * cos(2 * pi() * k * j / size)), 2) + pow(sum(v * hann * sin(2 * pi() * k * j / size)), 2)) / sum(hann * hann)
  * CASE WHEN k > 0 AND 2 * k < max(size) THEN 2 ELSE 1 END AS pw FROM part JOIN freq USING (id, s, size) GROUP BY 1, 2, 3),
dens AS (SELECT id, k, avg(pw) AS d FROM power GROUP BY 1, 2),
scaled AS (SELECT id, k, d, d / max(d) OVER w AS u, min(d) OVER w / max(d) OVER w AS lo FROM dens WINDOW w AS (PARTITION BY id)),
bins AS (SELECT id, least(floor((u - lo) * 10 / (1 - lo)), 9) AS b, count(*) AS c, sum(count(*)) OVER (PARTITION BY id) AS t FROM scaled GROUP BY 1, 2),
ent AS (SELECT id, -sum(c / t * ln(c / t)) AS spectral_entropy FROM bins GROUP BY 1)
SELECT id AS user_id, max(d) FILTER (k = 2) AS density_2, max(d) FILTER (k = 5) AS density_5, max(d) FILTER (k = 8) AS density_8,
max(spectral_entropy) AS spectral_entropy FROM dens JOIN ent USING (id) GROUP BY 1""",
        ["user_id"],
        _DENSITY_DIGITS,
    ),
)
def _(spark, sf_dir):
    return _compare(_DENSITY, _DENSITY_DIGITS, spark, sf_dir)


_PER_WINDOW = {
    "c3": ("c3__lag_1", "coalesce(avg(x * l1 * l2), 0)", 3),
    "change": ("mean_abs_change", "avg(abs(x - l1))", 5),
    "middle": ("median", "median(x)", 6),
    "first_max": ("first_location_of_maximum", "min(step) FILTER (x = hi) / 16", 6),
}


@query(
    "wide_set_per_window",
    rounded_sql(
        f"""{CTE}, s AS (SELECT sequence_id, step, value AS x, max(value) OVER (PARTITION BY sequence_id) AS hi, lag(value) OVER w AS l1, lag(value, 2) OVER w AS l2
  FROM win WINDOW w AS (PARTITION BY sequence_id ORDER BY step))
SELECT sequence_id, {", ".join(f"{sql} AS {n}" for n, (_f, sql, _d) in _PER_WINDOW.items())} FROM s GROUP BY 1""",
        ["sequence_id"],
        {n: d for n, (_f, _s, d) in _PER_WINDOW.items()},
    ),
)
def _(spark, sf_dir):
    windows = event_windows(spark, sf_dir)[0]
    wide = efficient.efficient_features(windows, channels=["value"], fft_coefficients=5, max_len=WINDOW)
    short = wide.select("sequence_id", *[F.col(f"`{f}`").alias(n) for n, (f, _s, _d) in _PER_WINDOW.items()])
    return rounded(short, ["sequence_id"], {n: d for n, (_f, _s, d) in _PER_WINDOW.items()})


@query("wide_set_full")
def _(spark, sf_dir):
    return wide_set(spark, sf_dir, 100)


@query("wide_set_comprehensive")
def _(spark, sf_dir):
    return efficient.efficient_features(user_series(spark, sf_dir), "user_id", ORDER, ["value"], 5, comprehensive=True)


_STAT = {
    "Absolute energy": ("sum(x * x)", 4),
    "Average power": ("sum(x * x) / (count(*) - 1)", 1),
    "Entropy": ("max(entropy)", 6),
    "Interquartile range": ("quantile_cont(x, 0.75) - quantile_cont(x, 0.25)", 6),
    "Mean absolute deviation": ("avg(abs(x - mu))", 6),
    "Median absolute deviation": ("median(abs(x - med))", 6),
    "Peak to peak distance": ("max(x) - min(x)", 6),
    "Root mean square": ("sqrt(avg(x * x))", 6),
    "Standard deviation": ("stddev_pop(x)", 6),
    "ECDF_0": ("1 / count(*)", 6),
    "ECDF_9": ("10 / count(*)", 6),
    "ECDF Percentile_0": ("max(x) FILTER (r / n <= 0.2)", 6),
    "ECDF Percentile_1": ("max(x) FILTER (r / n <= 0.8)", 6),
    "ECDF Percentile Count_0": ("count(*) FILTER (r / n <= 0.2)", 0),
}


@query(
    "signal_statistical_domain",
    rounded_sql(
        f"""WITH {POSITIONS}, src AS (SELECT user_id AS id, value AS x, n, avg(value) OVER w AS mu, median(value) OVER w AS med,
  row_number() OVER (PARTITION BY user_id ORDER BY value) AS r FROM pos WINDOW w AS (PARTITION BY user_id)),
e AS (SELECT id, -sum(c / t * log2(c / t)) / log2(max(t)) AS entropy FROM (SELECT id, x, count(*) AS c, sum(count(*)) OVER (PARTITION BY id) AS t FROM src GROUP BY 1, 2) GROUP BY 1)
SELECT id AS user_id, {", ".join(f'{sql} AS "{n}"' for n, (sql, _d) in _STAT.items())} FROM src JOIN e USING (id) GROUP BY 1""",
        ["user_id"],
        {n: d for n, (_s, d) in _STAT.items()},
    ),
)
def _(spark, sf_dir):
    out = signal.statistical_domain(user_series(spark, sf_dir), "user_id", ORDER, ["value"])
    return rounded(out, ["user_id"], {n: d for n, (_s, d) in _STAT.items()})


_TEMP = {
    "Area under the curve": ("sum(0.5 * abs(x + l1))", 4),
    "Centroid": ("sum(x * x * p) / sum(x * x)", 6),
    "Mean absolute diff": ("avg(abs(x - l1))", 6),
    "Median absolute diff": ("median(abs(x - l1))", 6),
    "Median diff": ("median(x - l1)", 6),
    "Negative turning points": ("count(*) FILTER (x < l1 AND nx > x)", 0),
    "Positive turning points": ("count(*) FILTER (x > l1 AND nx < x)", 0),
    "Signal distance": ("sum(sqrt(1 + pow(x - l1, 2)))", 5),
    "Slope": ("regr_slope(x, p)", 6),
    "Sum absolute diff": ("sum(abs(x - l1))", 5),
    "Zero crossing rate": ("count(*) FILTER (sign(x) <> sign(l1))", 0),
}


@query(
    "signal_temporal_domain",
    rounded_sql(
        f"""{SERIES} SELECT id AS user_id, {", ".join(f'{sql} AS "{n}"' for n, (sql, _d) in _TEMP.items())} FROM base GROUP BY 1""",
        ["user_id"],
        {n: d for n, (_s, d) in _TEMP.items()},
    ),
)
def _(spark, sf_dir):
    out = signal.temporal_domain(user_series(spark, sf_dir), "user_id", ORDER, ["value"])
    return rounded(out, ["user_id"], {n: d for n, (_s, d) in _TEMP.items()})


_MIXED = {
    "absolute_energy": ("sum(x * x)", 4),
    "cid_ce": ("sqrt(sum(pow(x - l1, 2)))", 6),
    "crossings": ("count(*) FILTER ((x > 0) <> (l1 > 0))", 0),
    "rms": ("sqrt(avg(x * x))", 6),
    "var_coeff": ("stddev_pop(x) / avg(x)", 6),
}


@query(
    "mixed_feature_set",
    rounded_sql(
        f"""{SERIES} SELECT id AS user_id, {", ".join(f'{sql} AS "{n}"' for n, (sql, _d) in _MIXED.items())} FROM base GROUP BY 1""",
        ["user_id"],
        {n: d for n, (_s, d) in _MIXED.items()},
    ),
)
def _(spark, sf_dir):
    out = signal.mixed_set(user_series(spark, sf_dir), "user_id", ORDER, ["value"])
    return rounded(out, ["user_id"], {n: d for n, (_s, d) in _MIXED.items()})


@query("drift_polynomial")
def _(spark, sf_dir):
    return drift.drift_features(user_series(spark, sf_dir), "user_id", ORDER, ["value"])


@query("long_feature_table", rounded_sql(
    """WITH s AS (SELECT l_suppkey AS sequence_id, avg(l_tax) AS a, max(l_quantity) AS b FROM lineitem GROUP BY 1)
SELECT sequence_id, 'l_tax__mean' AS feature, a AS value FROM s UNION ALL SELECT sequence_id, 'l_quantity__max', b FROM s""",
    ["sequence_id", "feature"], {"value": 6},
))
def _(spark, sf_dir):
    wide = statistical_features(table(spark, sf_dir, "lineitem"), "l_suppkey", ["l_tax", "l_quantity"])
    long = features_long(wide, ["l_suppkey"]).withColumnRenamed("l_suppkey", "sequence_id")
    return rounded(long.filter(F.col("feature").isin("l_tax__mean", "l_quantity__max")), ["sequence_id", "feature"], {"value": 6})


# --- stored features and streams -----------------------------------------------------------------------


def scratch_folder(spark) -> str:
    """A fresh folder beside the checkpoints, which the cluster shares."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tidemark-{uuid.uuid4().hex}"


_STORED = """SELECT l_suppkey AS sequence_id, 'l_tax__max' AS feature, max(l_tax) AS value FROM lineitem
WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1"""


@query("feature_store_slices", _STORED)
def _(spark, sf_dir):
    store = FeatureStore(spark, scratch_folder(spark))
    wide = statistical_features(table(spark, sf_dir, "lineitem"), "l_suppkey", ["l_tax"])
    long = features_long(wide.withColumnRenamed("l_suppkey", "sequence_id"), ["sequence_id"])
    store.save(long, "lines", "statistics_sample", {"p": 1})
    ids = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("sequence_id"))
    return store.load("lines", "statistics_sample", {"p": 1}, features=["l_tax__max", "absent"], ids=ids)


@query("stored_pair_is_valid", "SELECT true AS valid, count(DISTINCT user_id) > 0 AS has_rows FROM events")
def _(spark, sf_dir):
    folder = scratch_folder(spark)
    write_pair(*event_windows(spark, sf_dir), folder)
    valid = validate_pair(spark, folder)
    return read_pair(spark, folder)[1].agg(F.lit(valid).alias("valid"), (F.count("*") > 0).alias("has_rows"))


@query(
    "time_window_statistics",
    rounded_sql(
        """SELECT user_id, count(*) AS n_rows, (epoch_us(time_bucket(INTERVAL 1 DAY, ts)) // 1000000)::BIGINT AS start,
avg(value) AS value__mean, stddev_samp(value) AS value__std, min(value) AS value__min, max(value) AS value__max,
sum(value * value) AS value__energy, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS target
FROM events GROUP BY user_id, time_bucket(INTERVAL 1 DAY, ts)""",
        ["user_id", "n_rows", "start"],
        digits(["value__mean", "value__min", "value__max", "target"]) | {"value__energy": 4},
    ),
)
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("err", (F.col("event_type") == "error").cast("int"))
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = windowed_statistics(events, "ts", ["user_id"], ["value"], "1 day", label="err")
    out = out.withColumn("start", F.unix_seconds("window_start"))
    keep = digits(["value__mean", "value__min", "value__max", "target"]) | {"value__energy": 4}
    return rounded(out, ["user_id", "n_rows", "start"], keep)


@query(
    "streamed_sequence_features",
    rounded_sql(
        """WITH s AS (SELECT l_suppkey AS sequence_id, avg(l_tax) AS m, max(l_tax) AS hi FROM lineitem GROUP BY 1)
SELECT sequence_id, 'l_tax__mean' AS feature, m AS value FROM s UNION ALL SELECT sequence_id, 'l_tax__max', hi FROM s""",
        ["sequence_id", "feature"],
        {"value": 6},
    ),
)
def _(spark, sf_dir):
    folder = scratch_folder(spark)
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("sequence_id"), F.col("l_orderkey").alias("step"), "l_tax"
    )
    # Each file holds whole sequences, as a batch of finished sequences would; a task writes no more rows of a longer table.
    half = max(1, -(-lines.count() // (2 * limit(spark, MAX_GROUP_ROWS))))
    lines.repartition(2 * half, "sequence_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", half).parquet(f"{folder}/in")
    run = stream_sequence_features(stream, f"{folder}/out", f"{folder}/log", channels=["l_tax"])
    run.awaitTermination()
    features = latest_features(spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out"))
    picked = features.filter(F.col("feature").isin("l_tax__mean", "l_tax__max"))
    return rounded(picked, ["sequence_id", "feature"], {"value": 6})


@query(
    "streamed_count_windows",
    rounded_sql(
        f"""WITH {POSITIONS}, w AS (SELECT user_id, p, n, value, unnest(range(greatest(0, (p - 12 + 5) // 5), p // 5 + 1)) AS "window" FROM pos)
SELECT user_id, "window"::BIGINT AS "window", count(*) AS n_rows, min(p - "window" * 5)::INTEGER AS first_step, avg(value) AS value_mean,
  max(CASE WHEN p - "window" * 5 = 11 THEN value END) AS value_last FROM w WHERE "window" * 5 + 12 <= n AND p >= "window" * 5 AND p < "window" * 5 + 12 GROUP BY 1, 2""",
        ["user_id", '"window"', "n_rows", "first_step"],
        {"value_mean": 6, "value_last": 6},
    ),
)
def _(spark, sf_dir):
    """Windows of 12 rows, 5 apart, of each user's events as they arrive: in four files, every third row one file late, the
    stream stopped and started again in between."""
    folder = scratch_folder(spark)
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    quarter = (last - first).total_seconds() / 4
    turn = F.least(F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(first))) / (quarter * 1e6)), F.lit(3)) + (F.col("event_id") % 3 == 0).cast("int")
    pieces = events.withColumn("turn", F.least(turn, F.lit(3)).cast("int")).withColumn("closing", F.lit(False))
    end = spark.range(1).select(
        F.lit(None).cast(events.schema["user_id"].dataType).alias("user_id"), F.lit(last + timedelta(seconds=4 * quarter + 86_400)).cast("timestamp").alias("ts"),
        F.lit(None).cast(events.schema["event_id"].dataType).alias("event_id"), F.lit(None).cast("double").alias("value"), F.lit(True).alias("closing"),
    )

    def run() -> None:
        stream = spark.readStream.schema(arriving.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        windows = stream_count_windows(stream, ["user_id"], "ts", 12, 5, ["value"], ["event_id"], f"{int(2 * quarter) + 1} seconds", "closing")
        sink = windows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/log").option("path", f"{folder}/out")
        sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()

    arriving = pieces.drop("turn")
    for i in range(4):
        pieces.where(F.col("turn") == i).drop("turn").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if i == 1:
            run()
    end.select(arriving.columns).write.mode("append").parquet(f"{folder}/in")
    run()
    found = spark.read.parquet(f"{folder}/out").groupBy("user_id", "window").agg(
        F.count("*").alias("n_rows"), F.min("step").alias("first_step"), F.avg("value").alias("value_mean"), F.max(F.when(F.col("step") == 11, F.col("value"))).alias("value_last")
    )
    return rounded(found, ["user_id", "window", "n_rows", "first_step"], {"value_mean": 6, "value_last": 6})


@query("pipeline_end_to_end")
def _(spark, sf_dir):
    """Windows, compact features, selection by rate of false discoveries; the kept features."""
    windows, targets = event_windows(spark, sf_dir)
    # The tests read the features and the targets several times.
    features = cut_lineage(extract(windows, "compact", n_fft_coeffs=5, max_len=16))
    return run_selector("fdr", features, cut_lineage(targets))




_ASKED = merge_domains({
    "statistical": {"mean": None, "quantile": [{"q": 0.25}, {"q": 0.9}], "extremes": None, "range_count": [{"min": 0, "max": 20}, {"min": 20, "max": 60}]},
    "temporal": {"autocorrelation": [{"lag": 1}, {"lag": 3}], "c3": [2], "mean": ["not used: the first definition of a name stays"]},
})
_ASKED_NAMES = [
    "mean", "quantile__q_0.25", "quantile__q_0.9", "extremes__0", "extremes__1", "range_count__max_20__min_0",
    "range_count__max_60__min_20", "autocorrelation__lag_1", "autocorrelation__lag_3", "c3__param_2",
]


@query(
    "named_calculators",
    rounded_sql(
        """WITH s AS (SELECT user_id, value AS x, avg(value) OVER (PARTITION BY user_id) AS mu,
lag(value, 1) OVER w AS x1, lag(value, 2) OVER w AS x2, lag(value, 3) OVER w AS x3, lag(value, 4) OVER w AS x4
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, 'value' AS channel, avg(x) AS "mean", quantile_cont(x, 0.25) AS "quantile__q_0.25", quantile_cont(x, 0.9) AS "quantile__q_0.9",
min(x) AS "extremes__0", max(x) AS "extremes__1", count(*) FILTER (x >= 0 AND x < 20) AS "range_count__max_20__min_0",
count(*) FILTER (x >= 20 AND x < 60) AS "range_count__max_60__min_20",
coalesce(avg((x - mu) * (x1 - mu)) / nullif(var_pop(x), 0), 0) AS "autocorrelation__lag_1",
coalesce(avg((x - mu) * (x3 - mu)) / nullif(var_pop(x), 0), 0) AS "autocorrelation__lag_3",
coalesce(avg(x * x2 * x4), 0) AS "c3__param_2" FROM s GROUP BY 1""",
        ["user_id", "channel"],
        digits(_ASKED_NAMES, 5),
    ),
)
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    found = calculate(events, _ASKED, "user_id", ["ts", "event_id"], ["value"])
    return rounded(found, ["user_id", "channel"], digits(_ASKED_NAMES, 5))
