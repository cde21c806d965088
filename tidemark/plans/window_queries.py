"""Queries over windowed series and their features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expr import recode
from tidemark.functions.fourier import fft_name
from tidemark.operators.features.basic import (
    base_features,
    lag_correlations,
    minimal_features,
    statistical_features,
)
from tidemark.operators.features.compact import LAGS, QUANTILES, compact_features
from tidemark.operators.position import with_position
from tidemark.operators.windowing import (
    chunk_key,
    roll_time_series,
    segment_forecasting_series,
    segment_time_series,
    window_overlap,
)
from tidemark.plans.registry import digits, query, rounded, rounded_sql, table

WINDOW, STRIDE = 16, 8
ORDER = ["ts", "event_id"]
# Fixed codes of the event types, as integer class labels.
TYPE_CODES = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}


def labelled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        "user_id",
        "ts",
        "event_id",
        "value",
        recode("event_type", TYPE_CODES).cast("int").alias("code"),
        (F.col("event_type") == "error").cast("int").alias("err"),
    )


def event_windows(spark: SparkSession, sf_dir: str, label="err", strategy="any_positive"):
    return segment_time_series(
        labelled_events(spark, sf_dir), WINDOW, STRIDE, ORDER, ["value"], label, strategy, "user_id"
    )


_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TYPE_CODES.items()) + " END"

POSITIONS = f"""
pos AS (SELECT user_id, value, {_CASE} AS code, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS err,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p,
  count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


def windows_cte(window: int = WINDOW, stride: int = STRIDE, horizon: int = 0) -> str:
    need = window + horizon
    return f"""WITH {POSITIONS},
counts AS (SELECT user_id, CASE WHEN max(n) >= {need} THEN (max(n) - {need}) // {stride} + 1 ELSE 0 END AS w
  FROM pos GROUP BY user_id),
offsets AS (SELECT user_id, w, coalesce(sum(w) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0)::BIGINT AS o FROM counts),
spans AS (SELECT user_id, o + k AS sequence_id, k FROM
  (SELECT user_id, o, unnest(range(0, w::BIGINT)) AS k FROM offsets)),
win AS (SELECT s.sequence_id::BIGINT AS sequence_id, (p - k * {stride})::INTEGER AS step, pos.* FROM pos JOIN spans s
  ON pos.user_id = s.user_id AND p >= k * {stride} AND p < k * {stride} + {window}),
fut AS (SELECT s.sequence_id::BIGINT AS sequence_id, p - k * {stride} - {window} AS h, pos.* FROM pos JOIN spans s
  ON pos.user_id = s.user_id AND p >= k * {stride} + {window} AND p < k * {stride} + {need})
"""


CTE = windows_cte()


# --- window construction -------------------------------------------------------------------


@query("sliding_windows", f"{CTE} SELECT sequence_id, step, value FROM win")
def _(spark, sf_dir):
    return event_windows(spark, sf_dir)[0]


@query(
    "window_label_any_positive",
    f'{CTE} SELECT sequence_id, max(err)::INTEGER AS target, max(user_id) AS "group", max(user_id) AS user_id '
    "FROM win GROUP BY sequence_id",
)
def _(spark, sf_dir):
    return event_windows(spark, sf_dir)[1]


@query("window_label_last", f"{CTE} SELECT sequence_id, code::INTEGER AS target FROM win WHERE step = {WINDOW - 1}")
def _(spark, sf_dir):
    return event_windows(spark, sf_dir, "code", "last")[1].select("sequence_id", "target")


@query(
    "window_label_majority",
    f"""{CTE}, votes AS (SELECT sequence_id, code, count(*) AS c FROM win GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY c DESC, code) AS r FROM votes)
SELECT sequence_id, code::INTEGER AS target FROM ranked WHERE r = 1""",
)
def _(spark, sf_dir):
    return event_windows(spark, sf_dir, "code", "majority_vote")[1].select("sequence_id", "target")


@query(
    "window_label_mean",
    rounded_sql(f"{CTE} SELECT sequence_id, avg(value) AS target FROM win GROUP BY 1", ["sequence_id"], {"target": 6}),
)
def _(spark, sf_dir):
    return rounded(event_windows(spark, sf_dir, "value", "mean")[1], ["sequence_id"], {"target": 6})


@query(
    "windows_across_groups",
    f"""WITH pos AS (SELECT user_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS p FROM events),
win AS (SELECT p // 50 AS sequence_id, * FROM pos WHERE p // 50 < (SELECT count(*) // 50 FROM events)),
agg AS (SELECT sequence_id, avg(value) AS target, max_by(user_id, p) AS "group" FROM win GROUP BY 1)
SELECT sequence_id::BIGINT AS sequence_id, round(target, 6) AS target, "group" FROM agg""",
)
def _(spark, sf_dir):
    out = segment_time_series(
        labelled_events(spark, sf_dir), 50, None, ORDER, ["value"], "value", "mean", "user_id", cross_group=True
    )[1]
    return out.select("sequence_id", F.round("target", 6).alias("target"), "group")


_HORIZON = 4


@query(
    "horizon_windows",
    f"""{windows_cte(WINDOW, STRIDE, _HORIZON)} SELECT sequence_id,
{", ".join(f"max(CASE WHEN h = {h} THEN value END) AS target_{h}" for h in range(_HORIZON))}
FROM fut GROUP BY sequence_id""",
)
def _(spark, sf_dir):
    targets = segment_time_series(
        labelled_events(spark, sf_dir), WINDOW, STRIDE, ORDER, ["value"], "value", group_col="user_id",
        forecast_horizon=_HORIZON,
    )[1]
    return targets.select("sequence_id", *[f"target_{h}" for h in range(_HORIZON)])


def forecasting_windows(spark: SparkSession, sf_dir: str):
    return segment_forecasting_series(
        labelled_events(spark, sf_dir), 12, 3, 2, ORDER, ["value"], "value", "user_id", test_size=0.25
    )


# History 12, horizon 3, stride 2, test share 0.25.
FORECAST_CTE = f"""WITH {POSITIONS},
cuts AS (SELECT user_id, max(n) AS n, floor(max(n) * 0.75::DOUBLE)::BIGINT AS cut FROM pos GROUP BY 1 HAVING max(n) >= 15),
counts AS (SELECT *, (cut - 15) // 2 + 1 AS w_train, greatest(0, cut - 12) AS first_test,
  (n - 15 - greatest(0, cut - 12)) // 2 + 1 AS w_test FROM cuts),
offsets AS (SELECT *, coalesce(sum(w_train + w_test) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0)::BIGINT AS o FROM counts),
spans AS (SELECT user_id, o + k AS sequence_id, 'train' AS split, k * 2 AS start FROM
    (SELECT *, unnest(range(0, w_train::BIGINT)) AS k FROM offsets)
  UNION ALL SELECT user_id, o + w_train + k, 'test', first_test + k * 2 FROM
    (SELECT *, unnest(range(0, w_test::BIGINT)) AS k FROM offsets))"""


@query(
    "forecasting_targets",
    f"""{FORECAST_CTE} SELECT s.sequence_id::BIGINT AS sequence_id, s.split, s.user_id AS series_id,
max(CASE WHEN p = start + 12 THEN value END) AS target_0, max(CASE WHEN p = start + 13 THEN value END) AS target_1,
max(CASE WHEN p = start + 14 THEN value END) AS target_2
FROM spans s JOIN pos ON pos.user_id = s.user_id AND p >= start + 12 AND p < start + 15 GROUP BY 1, 2, 3""",
)
def _(spark, sf_dir):
    targets = forecasting_windows(spark, sf_dir)[1]
    return targets.select("sequence_id", "split", "series_id", "target_0", "target_1", "target_2")


@query(
    "forecasting_histories",
    f"""{FORECAST_CTE} SELECT s.sequence_id::BIGINT AS sequence_id, (p - start)::INTEGER AS step, value
FROM spans s JOIN pos ON pos.user_id = s.user_id AND p >= start AND p < start + 12""",
)
def _(spark, sf_dir):
    return forecasting_windows(spark, sf_dir)[0]


def _rolled(direction: int) -> str:
    ends = "w.p - 4 AND w.p" if direction > 0 else "w.p AND w.p + 4"
    return f"""WITH {POSITIONS} SELECT w.user_id, w.p AS shift, count(*) AS n_rows, round(avg(r.value), 6) AS mean,
max(r.value) AS maximum FROM pos w JOIN pos r ON r.user_id = w.user_id AND r.p BETWEEN {ends}
GROUP BY 1, 2 HAVING count(*) > 2"""


def _rolling(spark, sf_dir, direction):
    rolled = roll_time_series(labelled_events(spark, sf_dir), "user_id", ORDER, 4, 2, direction)
    return rolled.groupBy("user_id", "shift").agg(
        F.count("*").alias("n_rows"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("maximum")
    )


@query("rolling_windows_forward", _rolled(1))
def _(spark, sf_dir):
    return _rolling(spark, sf_dir, 1)


@query("rolling_windows_backward", _rolled(-1))
def _(spark, sf_dir):
    return _rolling(spark, sf_dir, -1)


@query(
    "fixed_chunks",
    f"""WITH {POSITIONS} SELECT user_id, 'chunk_' || (p // 20) AS chunk, count(*) AS n_rows,
round(sum(value), 4) AS total FROM pos GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    rows = with_position(table(spark, sf_dir, "events"), ["user_id"], ORDER, "p")
    return rows.groupBy("user_id", chunk_key(F.col("p"), 20, "chunk_").alias("chunk")).agg(
        F.count("*").alias("n_rows"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "window_overlap",
    """WITH sizes AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, round(greatest(0.0, 1.0 - 10.0 / n), 6)::DOUBLE AS overlap,
greatest(0, ceil(n / 10.0) - 1)::INTEGER AS purge FROM sizes""",
)
def _(spark, sf_dir):
    sizes = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    parts = window_overlap(F.col("n"), 10)
    return sizes.select("user_id", F.round(parts["overlap"], 6).alias("overlap"), parts["purge"].alias("purge"))


# --- features of windows --------------------------------------------------------------------

_FIVE = digits(["value__mean", "value__std", "value__min", "value__max"]) | {"value__energy": 4}


def _five_sql(std: str) -> str:
    return rounded_sql(
        f"""{CTE} SELECT sequence_id, avg(value) AS value__mean, {std}(value) AS value__std, min(value) AS value__min,
max(value) AS value__max, sum(value * value) AS value__energy FROM win GROUP BY 1""",
        ["sequence_id"],
        _FIVE,
    )


@query("statistics_sample", _five_sql("stddev_samp"))
def _(spark, sf_dir):
    return rounded(statistical_features(event_windows(spark, sf_dir)[0]), ["sequence_id"], _FIVE)


@query("statistics_population", _five_sql("stddev_pop"))
def _(spark, sf_dir):
    features = statistical_features(event_windows(spark, sf_dir)[0], sample_std=False)
    return rounded(features, ["sequence_id"], _FIVE)


@query(
    "features_with_targets",
    rounded_sql(
        f"""{CTE} SELECT sequence_id, max(err)::INTEGER AS target, avg(value) AS value__mean,
stddev_samp(value) AS value__std, min(value) AS value__min, max(value) AS value__max,
sum(value * value) AS value__energy FROM win GROUP BY 1""",
        ["sequence_id", "target"],
        _FIVE,
    ),
)
def _(spark, sf_dir):
    windows, targets = event_windows(spark, sf_dir)
    joined = statistical_features(windows).join(targets, "sequence_id")
    return rounded(joined, ["sequence_id", "target"], _FIVE)


_MINIMAL = {
    "l_extendedprice__sum_values": 2,
    "l_extendedprice__median": 4,
    "l_extendedprice__mean": 4,
    "l_extendedprice__length": 0,
    "l_extendedprice__standard_deviation": 4,
    "l_extendedprice__variance": 0,
    "l_extendedprice__root_mean_square": 4,
    "l_extendedprice__maximum": 4,
    "l_extendedprice__absolute_maximum": 4,
    "l_extendedprice__minimum": 4,
}


@query(
    "minimal_set",
    rounded_sql(
        """SELECT l_suppkey, sum(v) AS l_extendedprice__sum_values, median(v) AS l_extendedprice__median,
avg(v) AS l_extendedprice__mean, count(*) AS l_extendedprice__length,
stddev_pop(v) AS l_extendedprice__standard_deviation, var_pop(v) AS l_extendedprice__variance,
sqrt(avg(v * v)) AS l_extendedprice__root_mean_square, max(v) AS l_extendedprice__maximum,
max(abs(v)) AS l_extendedprice__absolute_maximum, min(v) AS l_extendedprice__minimum
FROM (SELECT l_suppkey, l_extendedprice AS v FROM lineitem) GROUP BY 1""",
        ["l_suppkey"],
        _MINIMAL,
    ),
)
def _(spark, sf_dir):
    features = minimal_features(table(spark, sf_dir, "lineitem"), "l_suppkey", ["l_extendedprice"])
    return rounded(features, ["l_suppkey"], _MINIMAL)


_BASE = {
    "value__mean": 6, "value__std": 6, "value__min": 6, "value__max": 6, "value__energy": 4,
    "value__skew": 6, "value__kurtosis": 6, "value__mean_abs": 6, "value__median": 6,
}

MOMENTS = """base AS (SELECT *, avg(x) OVER (PARTITION BY id) AS mu FROM src),
mom AS (SELECT id, avg(pow(x - mu, 2)) AS m2, avg(pow(x - mu, 3)) AS m3, avg(pow(x - mu, 4)) AS m4 FROM base GROUP BY id)"""


@query(
    "base_statistics",
    rounded_sql(
        f"""WITH src AS (SELECT user_id AS id, value AS x FROM events), {MOMENTS}
SELECT id AS user_id, avg(x) AS value__mean, stddev_samp(x) AS value__std, min(x) AS value__min, max(x) AS value__max,
sum(x * x) AS value__energy, max(m3 / nullif(pow(m2, 1.5), 0)) AS value__skew,
max(m4 / nullif(m2 * m2, 0) - 3) AS value__kurtosis, avg(abs(x)) AS value__mean_abs, median(x) AS value__median
FROM base JOIN mom USING (id) GROUP BY 1""",
        ["user_id"],
        _BASE,
    ),
)
def _(spark, sf_dir):
    return rounded(base_features(table(spark, sf_dir, "events"), "user_id", ["value"]), ["user_id"], _BASE)


_LAGS = (1, 2, 5, 10, 20)
_LAG_CTE = f"""WITH {POSITIONS}, lagged AS (SELECT user_id, value AS x,
{", ".join(f"lag(value, {k}) OVER (PARTITION BY user_id ORDER BY p) AS lag_{k}" for k in _LAGS)} FROM pos)"""


@query(
    "lag_correlations",
    rounded_sql(
        f"{_LAG_CTE} SELECT user_id, "
        + ", ".join(f"coalesce(corr(x, lag_{k}), 0) AS autocorr_{k}" for k in _LAGS)
        + " FROM lagged GROUP BY 1",
        ["user_id"],
        digits([f"autocorr_{k}" for k in _LAGS]),
    ),
)
def _(spark, sf_dir):
    out = lag_correlations(table(spark, sf_dir, "events"), "user_id", ORDER, ["value"], _LAGS)
    return rounded(out, ["user_id"], digits([f"autocorr_{k}" for k in _LAGS]))


_COMPACT_STATS = {
    "mean": 6, "standard_deviation": 6, "variance": 1, "minimum": 6, "maximum": 6, "abs_energy": 4,
    "absolute_maximum": 6, "root_mean_square": 6, "skewness": 6, "kurtosis": 6, "mean_change": 6,
    "mean_abs_change": 6, "absolute_sum_of_changes": 6, "first_location_of_minimum": 6,
    "first_location_of_maximum": 6, "last_location_of_minimum": 6, "last_location_of_maximum": 6,
    "count_above_mean": 0, "count_below_mean": 0, "longest_strike_above_mean": 0,
    "longest_strike_below_mean": 0, "variance_larger_than_standard_deviation": 0,
    "ratio_value_number_to_time_series_length": 6, "ratio_beyond_r_sigma__r_1": 6,
}

_COMPACT_CTE = f"""{CTE}, src AS (SELECT sequence_id AS id, step::BIGINT AS p, value AS x FROM win), {MOMENTS},
sd AS (SELECT base.*, sqrt(m2) AS sd, m2, m3, m4, lag(x) OVER (PARTITION BY id ORDER BY p) AS prev,
  count(*) OVER (PARTITION BY id) AS n,
  row_number() OVER (PARTITION BY id ORDER BY p) - row_number() OVER (PARTITION BY id, x > mu ORDER BY p) AS ga,
  row_number() OVER (PARTITION BY id ORDER BY p) - row_number() OVER (PARTITION BY id, x < mu ORDER BY p) AS gb
  FROM base JOIN mom USING (id)),
ra AS (SELECT id, max(c) AS above FROM (SELECT id, ga, count(*) AS c FROM sd WHERE x > mu GROUP BY 1, 2) GROUP BY 1),
rb AS (SELECT id, max(c) AS below FROM (SELECT id, gb, count(*) AS c FROM sd WHERE x < mu GROUP BY 1, 2) GROUP BY 1),
lo AS (SELECT id, min(x) AS lo, max(x) AS hi FROM src GROUP BY 1),
loc AS (SELECT src.id, min(CASE WHEN x = lo THEN p END) AS f_lo, max(CASE WHEN x = lo THEN p END) AS l_lo,
  min(CASE WHEN x = hi THEN p END) AS f_hi, max(CASE WHEN x = hi THEN p END) AS l_hi
  FROM src JOIN lo USING (id) GROUP BY 1)"""

_COMPACT_AGG = """avg(x) AS mean, max(sd) AS standard_deviation, max(m2) AS variance, min(x) AS minimum,
max(x) AS maximum, sum(x * x) AS abs_energy, max(abs(x)) AS absolute_maximum, sqrt(avg(x * x)) AS root_mean_square,
max(CASE WHEN sd > 1e-12 THEN m3 / (m2 * sd) ELSE 0 END) AS skewness,
max(CASE WHEN sd > 1e-12 THEN m4 / (m2 * m2) - 3 ELSE 0 END) AS kurtosis,
(max_by(x, p) - min_by(x, p)) / (count(*) - 1) AS mean_change, avg(abs(x - prev)) AS mean_abs_change,
sum(abs(x - prev)) AS absolute_sum_of_changes, max(f_lo) / max(n) AS first_location_of_minimum,
max(f_hi) / max(n) AS first_location_of_maximum, max(l_lo) / max(n) AS last_location_of_minimum,
max(l_hi) / max(n) AS last_location_of_maximum, count(*) FILTER (x > mu) AS count_above_mean,
count(*) FILTER (x < mu) AS count_below_mean, coalesce(max(above), 0) AS longest_strike_above_mean,
coalesce(max(below), 0) AS longest_strike_below_mean,
max(CASE WHEN m2 > sd THEN 1 ELSE 0 END) AS variance_larger_than_standard_deviation,
{value_ratio} AS ratio_value_number_to_time_series_length, {sigma_ratio} AS ratio_beyond_r_sigma__r_1"""


def _compact_sql(value_ratio: str, sigma_ratio: str) -> str:
    return rounded_sql(
        f"""{_COMPACT_CTE} SELECT id AS sequence_id, {_COMPACT_AGG.format(value_ratio=value_ratio, sigma_ratio=sigma_ratio)}
FROM sd LEFT JOIN ra USING (id) LEFT JOIN rb USING (id) JOIN loc USING (id) GROUP BY 1""",
        ["sequence_id"],
        _COMPACT_STATS,
    )


def event_compact(spark: SparkSession, sf_dir: str, terms: int = 0, legacy: bool = False) -> DataFrame:
    windows = event_windows(spark, sf_dir)[0]
    return compact_features(
        windows, channels=["value"], n_fft_coeffs=terms, max_len=WINDOW, legacy_ratios=legacy
    )


@query("compact_statistics", _compact_sql("count(DISTINCT x) / count(*)", "count(*) FILTER (abs(x - mu) > sd) / count(*)"))
def _(spark, sf_dir):
    return rounded(event_compact(spark, sf_dir), ["sequence_id"], _COMPACT_STATS)


@query(
    "compact_statistics_legacy_ratios",
    _compact_sql("count(*) FILTER (x > mu) / count(*)", "count(*) FILTER (x < mu) / count(*)"),
)
def _(spark, sf_dir):
    return rounded(event_compact(spark, sf_dir, legacy=True), ["sequence_id"], _COMPACT_STATS)


_AC = digits([f"autocorrelation__lag_{k}" for k in LAGS])


def _autocorrelation_sql(lags, prefix: str = "autocorrelation__lag_") -> str:
    cells = []
    for k in lags:
        lagged = f"sum((x - mu) * (lag_{k} - mu))"
        cells.append(
            f"CASE WHEN sum(pow(x - mu, 2)) >= 1e-12 AND count(*) > {k} THEN "
            f"{lagged} / sum(pow(x - mu, 2)) * count(*) / (count(*) - {k}) ELSE 0 END AS {prefix}{k}"
        )
    windows = ", ".join(f"lag(x, {k}) OVER (PARTITION BY id ORDER BY p) AS lag_{k}" for k in lags)
    return f"""{CTE}, src AS (SELECT sequence_id AS id, step AS p, value AS x FROM win),
base AS (SELECT *, avg(x) OVER (PARTITION BY id) AS mu, {windows} FROM src)
SELECT id AS sequence_id, {", ".join(cells)} FROM base GROUP BY 1"""


@query("compact_autocorrelation", rounded_sql(_autocorrelation_sql(LAGS), ["sequence_id"], _AC))
def _(spark, sf_dir):
    return rounded(event_compact(spark, sf_dir), ["sequence_id"], _AC)


_Q = digits([f"quantile__q_{q}" for q in QUANTILES])


@query(
    "compact_quantiles",
    rounded_sql(
        f"{CTE} SELECT sequence_id, "
        + ", ".join(f'quantile_cont(value, {q}) AS "quantile__q_{q}"' for q in QUANTILES)
        + " FROM win GROUP BY 1",
        ["sequence_id"],
        _Q,
    ),
)
def _(spark, sf_dir):
    return rounded(event_compact(spark, sf_dir), ["sequence_id"], _Q)


_TREND = {f'linear_trend__attr_"{a}"': a for a in ("slope", "intercept", "rvalue", "stderr")}


@query(
    "compact_trend",
    rounded_sql(
        f"""{CTE}, src AS (SELECT sequence_id, step::DOUBLE AS t, value AS y FROM win)
SELECT sequence_id, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept, corr(y, t) AS rvalue,
sqrt((var_pop(y) - pow(covar_pop(y, t), 2) / var_pop(t)) / (var_pop(t) * (count(*) - 2))) AS stderr
FROM src GROUP BY 1""",
        ["sequence_id"],
        digits(list(_TREND.values())),
    ),
)
def _(spark, sf_dir):
    out = event_compact(spark, sf_dir)
    out = out.select("sequence_id", *[F.col(f"`{n}`").alias(a) for n, a in _TREND.items()])
    return rounded(out, ["sequence_id"], digits(list(_TREND.values())))


_FFT_TERMS = 5
_FFT = {f"fft_{a}_{k}": fft_name(k, a) for a in ("real", "imag", "abs") for k in range(_FFT_TERMS)}


def _wave(fn: str, k: int) -> str:
    return f"sum(value * {fn}(2 * pi() * {k} * step / {WINDOW}))"


_FFT_SQL = f"{CTE} SELECT sequence_id, " + ", ".join(
    [f"{_wave('cos', k)} AS fft_real_{k}" for k in range(_FFT_TERMS)]
    + [f"-{_wave('sin', k)} AS fft_imag_{k}" for k in range(_FFT_TERMS)]
    + [f"sqrt(pow({_wave('cos', k)}, 2) + pow({_wave('sin', k)}, 2)) AS fft_abs_{k}" for k in range(_FFT_TERMS)]
) + " FROM win GROUP BY 1"


@query("compact_fourier", rounded_sql(_FFT_SQL, ["sequence_id"], digits(list(_FFT))))
def _(spark, sf_dir):
    out = event_compact(spark, sf_dir, _FFT_TERMS)
    out = out.select("sequence_id", *[F.col(f"`{n}`").alias(a) for a, n in _FFT.items()])
    return rounded(out, ["sequence_id"], digits(list(_FFT)))


@query("compact_set_full")
def _(spark, sf_dir):
    return event_compact(spark, sf_dir, 25)
