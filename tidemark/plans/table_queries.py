"""Queries over projections, reshapes, joins, grouped summaries, windows, sorts and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.operators import aggregate as agg
from tidemark.operators import compare as cmp
from tidemark.operators import reshape
from tidemark.operators.features.basic import base_features, lag_correlations, statistical_features
from tidemark.operators.features.rows import features_long, features_wide
from tidemark.operators.position import running_last, with_position
from tidemark.operators.splits import sample_rows
from tidemark.operators.windowing import segment_time_series
from tidemark.plans.registry import digits, query, rounded, rounded_sql, table
from tidemark.plans.window_queries import CTE, POSITIONS, event_windows, forecasting_windows, FORECAST_CTE
from tidemark.sources.tables import null_counts

# --- projections and scalar expressions ------------------------------------------------------------


@query("drop_and_select", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def _(spark, sf_dir):
    return X.select_except(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus", "o_orderdate", "absent"])


@query(
    "recode_dictionary",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END::INTEGER AS code,
CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 2.0 ELSE 0.0 END::DOUBLE AS urgency FROM orders""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        X.recode("o_orderstatus", {"F": 0, "O": 1}).alias("code"),
        X.recode("o_orderpriority", {"1-URGENT": 1.0, "2-HIGH": 2.0}, 0.0).alias("urgency"),
    )


_MESSY = """CASE event_type WHEN 'error' THEN 'nan'::DOUBLE WHEN 'view' THEN 'inf'::DOUBLE WHEN 'click' THEN NULL
ELSE value END"""


def messy_events(spark, sf_dir):
    """Events whose value is NaN, infinite or missing for some types."""
    value = (
        F.when(F.col("event_type") == "error", F.lit(float("nan")))
        .when(F.col("event_type") == "view", F.lit(float("inf")))
        .when(F.col("event_type") != "click", F.col("value"))
    )
    return table(spark, sf_dir, "events").withColumn("v", value)


@query(
    "sanitise_values",
    f"""SELECT event_id, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0.0 ELSE v END::DOUBLE AS clean,
CASE WHEN v IS NULL OR isnan(v) THEN 0.0 WHEN isinf(v) THEN 1e300 ELSE v END::DOUBLE AS filled
FROM (SELECT event_id, {_MESSY} AS v FROM events)""",
)
def _(spark, sf_dir):
    filled = X.fill_missing("v")
    return messy_events(spark, sf_dir).select(
        "event_id",
        X.sanitise("v").alias("clean"),
        F.when(filled == float("inf"), 1e300).otherwise(filled).alias("filled"),
    )


@query(
    "forgiving_number_parse",
    """SELECT p_partkey, coalesce(try_cast(trim(p_brand) AS DOUBLE), 0.0) AS brand,
coalesce(try_cast(trim(substr(p_brand, 7)) AS DOUBLE), 0.0) AS brand_number FROM part""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        X.parse_number("p_brand").alias("brand"),
        X.parse_number(F.substring("p_brand", 7, 100)).alias("brand_number"),
    )


@query(
    "fill_forward_backward",
    """WITH g AS (SELECT event_id, user_id, ts, CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE value END AS v FROM events)
SELECT event_id, coalesce(
  last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
  0.0) AS filled FROM g""",
)
def _(spark, sf_dir):
    known = F.when(~F.col("event_type").isin("error", "view"), F.col("value"))
    rows = table(spark, sf_dir, "events").withColumn("v", known)
    filled = running_last(rows, ["user_id"], ["ts", "event_id"], {"f": "v"})
    return filled.select("event_id", F.coalesce("f", F.lit(0.0)).alias("filled"))


@query(
    "one_hot",
    """SELECT o_orderkey, (o_orderstatus = 'F')::INTEGER::DOUBLE AS status_F, (o_orderstatus = 'O')::INTEGER::DOUBLE AS status_O
FROM orders""",
)
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return X.one_hot(orders, "o_orderstatus", ["F", "O"], "status")


@query(
    "row_index_as_time",
    "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS time FROM events",
)
def _(spark, sf_dir):
    return with_position(table(spark, sf_dir, "events").select("ts", "event_id"), [], ["ts", "event_id"], "time").drop("ts")


@query(
    "range_and_membership_filter",
    """SELECT event_id, user_id, value FROM events WHERE value BETWEEN 5 AND 50 AND event_type IN ('click', 'error')""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.filter(F.col("value").between(5, 50) & F.col("event_type").isin("click", "error")).select(
        "event_id", "user_id", "value"
    )


@query(
    "vector_magnitude",
    """SELECT l_orderkey, l_partkey, l_linenumber, round(sqrt(l_quantity * l_quantity + l_tax * l_tax), 6) AS size FROM lineitem""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", F.round(X.magnitude("l_quantity", "l_tax"), 6).alias("size")
    )


@query(
    "concatenated_keys",
    """SELECT doc_id, lang || ' + ' || source AS combination, coalesce(quality::VARCHAR, 'none') AS quality
FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select("doc_id", X.concat_key("lang", "source").alias("combination"), X.null_label("quality").alias("quality"))


@query(
    "array_json_round_trip",
    """SELECT vec_id, len(embedding)::INTEGER AS length, round(list_sum([x::DOUBLE FOR x IN embedding]), 3) AS total
FROM embeddings""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    decoded = X.decode_array(X.encode_array(F.col("embedding").cast("array<double>")))
    return rows.select(
        "vec_id", F.size(decoded).alias("length"), F.round(F.aggregate(decoded, F.lit(0.0), lambda a, v: a + v), 3).alias("total")
    )


@query(
    "lenient_array_parse",
    "SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b, 3 AS length FROM part",
)
def _(spark, sf_dir):
    text = F.concat(F.lit("["), F.col("p_size"), F.lit("  "), F.col("p_retailprice"), F.lit(", 7]"))
    values = X.decode_array(text)
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.get(values, F.lit(0)).alias("a"), F.get(values, F.lit(1)).alias("b"), F.size(values).alias("length")
    )


_MATH = {
    "p_size_log": 6, "p_size_log1p": 6, "p_size_square": 6, "p_retailprice_log": 6, "p_retailprice_log1p": 6,
    "p_retailprice_square": 4, "p_size_plus_p_retailprice": 6, "p_size_times_p_retailprice": 4,
    "p_size_per_p_retailprice": 6,
}


@query(
    "math_features",
    rounded_sql(
        """SELECT p_partkey, ln(s) AS p_size_log, ln(1 + s) AS p_size_log1p, s * s AS p_size_square,
ln(r) AS p_retailprice_log, ln(1 + r) AS p_retailprice_log1p, r * r AS p_retailprice_square,
s + r AS p_size_plus_p_retailprice, s * r AS p_size_times_p_retailprice, s / r AS p_size_per_p_retailprice
FROM (SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice AS r FROM part)""",
        ["p_partkey"],
        _MATH,
    ),
)
def _(spark, sf_dir):
    out = X.math_features(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"])
    return rounded(out, ["p_partkey"], _MATH)


@query(
    "align_columns",
    "SELECT c_custkey, 0.0::DOUBLE AS absent, coalesce(c_acctbal, 0) AS c_acctbal, c_nationkey::DOUBLE AS c_nationkey FROM customer",
)
def _(spark, sf_dir):
    return X.align_columns(table(spark, sf_dir, "customer"), ["absent", "c_acctbal", "c_nationkey"], ["c_custkey"])


# Feature names by line number, for the name operators.
_NAMES = ["quantile", "fft_coefficient", "autocorrelation", "linear_trend", "mean_abs_change", "kurtosis", "longest_strike"]
_NAMED = (
    """WITH named AS (SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag || '__' || """
    + f"""(list_value({", ".join(f"'{n}'" for n in _NAMES)}))[l_linenumber] || '__coeff_' || l_linenumber || '__attr_"abs"' AS name FROM lineitem)"""
)


def named_lines(spark, sf_dir):
    place = F.get(F.array(*[F.lit(n) for n in _NAMES]), F.col("l_linenumber") - 1)
    name = F.concat(
        "l_returnflag", F.lit("__"), place, F.lit("__coeff_"), F.col("l_linenumber"), F.lit('__attr_"abs"')
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", name.alias("name"))


@query(
    "feature_name_parts",
    f"""{_NAMED} SELECT l_orderkey, l_partkey, l_linenumber, split_part(name, '__', 1) AS channel, split_part(name, '__', 2) AS feature,
split_part(name, '__', 3) || '__' || split_part(name, '__', 4) AS parameter,
regexp_replace(name, '__coeff_([0-9]+)__attr_("abs")', '__attr_\\2__coeff_\\1') AS swapped FROM named""",
)
def _(spark, sf_dir):
    parts = X.feature_parts("name")
    return named_lines(spark, sf_dir).select(
        "l_orderkey", "l_partkey", "l_linenumber", *[c.alias(n) for n, c in parts.items()],
        X.swap_fft_parameters("name").alias("swapped"),
    )


@query(
    "feature_families",
    f"""{_NAMED} SELECT family, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(name), 'quantile|median') THEN 'Quantiles'
WHEN regexp_matches(lower(name), 'autocorrelation') THEN 'Autocorrelation' WHEN regexp_matches(lower(name), 'trend') THEN 'Linear Trend'
WHEN regexp_matches(lower(name), 'fft|fourier') THEN 'FFT Coefficients'
WHEN regexp_matches(lower(name), 'skewness|kurtosis') THEN 'Higher Order Moments'
WHEN regexp_matches(lower(name), 'variance|standard_deviation') THEN 'Dispersion (Var/Std)'
WHEN regexp_matches(lower(name), 'mean|minimum|maximum|root_mean_square|abs_energy') THEN 'Location & Energy'
WHEN regexp_matches(lower(name), 'change|strike|count_above|count_below|ratio') THEN 'Dynamics & Extremes'
ELSE 'Other' END AS family FROM named) GROUP BY 1""",
)
def _(spark, sf_dir):
    named = named_lines(spark, sf_dir).withColumn("family", X.feature_family("name"))
    return named.groupBy("family").agg(F.count("*").alias("n"))


@query(
    "preset_labels",
    """SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag AS library, 'Efficient' AS level, l_linenumber AS fft_terms FROM lineitem""",
)
def _(spark, sf_dir):
    label = F.concat("l_returnflag", F.lit("-Efficient-"), F.col("l_linenumber"), F.lit("FFT"))
    parts = X.preset_parts(label)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", *[c.alias(n) for n, c in parts.items()]
    )


@query(
    "null_audit",
    f"""WITH m AS (SELECT user_id, event_type, {_MESSY} AS v FROM events)
SELECT 'user_id' AS "column", count(*) FILTER (user_id IS NULL) AS n_null, 0::BIGINT AS n_nan FROM m
UNION ALL SELECT 'event_type', count(*) FILTER (event_type IS NULL), 0 FROM m
UNION ALL SELECT 'v', count(*) FILTER (v IS NULL), count(*) FILTER (isnan(v)) FROM m""",
)
def _(spark, sf_dir):
    return null_counts(messy_events(spark, sf_dir).select("user_id", "event_type", "v"))


# --- reshape ---------------------------------------------------------------------------------------


@query(
    "sequence_arrays",
    f"""{CTE}, a AS (SELECT sequence_id, list(value ORDER BY step) AS x FROM win GROUP BY 1)
SELECT sequence_id, len(x)::INTEGER AS length, x[1] AS first, x[8] AS eighth, x[16] AS last FROM a""",
)
def _(spark, sf_dir):
    arrays = reshape.sequence_arrays(event_windows(spark, sf_dir)[0])
    return arrays.select(
        "sequence_id", "length", F.get("value", F.lit(0)).alias("first"), F.get("value", F.lit(7)).alias("eighth"),
        F.element_at("value", -1).alias("last"),
    )


@query(
    "history_and_horizon",
    f"""{FORECAST_CTE}, h AS (SELECT s.sequence_id, list(value ORDER BY p) AS x FROM spans s JOIN pos
  ON pos.user_id = s.user_id AND p >= start AND p < start + 12 GROUP BY 1),
t AS (SELECT s.sequence_id, list(value ORDER BY p) AS y FROM spans s JOIN pos
  ON pos.user_id = s.user_id AND p >= start + 12 AND p < start + 15 GROUP BY 1)
SELECT sequence_id::BIGINT AS sequence_id, x[1] AS oldest, x[12] AS newest, y[1] AS next, y[3] AS last FROM h JOIN t USING (sequence_id)""",
)
def _(spark, sf_dir):
    both = reshape.history_and_horizon(*forecasting_windows(spark, sf_dir))
    return both.select(
        "sequence_id", F.get("value", F.lit(0)).alias("oldest"), F.element_at("value", -1).alias("newest"),
        F.get("target", F.lit(0)).alias("next"), F.element_at("target", -1).alias("last"),
    )


@query(
    "wide_to_long",
    """SELECT l_orderkey, l_partkey, l_linenumber, 'l_tax' AS variable, l_tax AS value FROM lineitem
UNION ALL SELECT l_orderkey, l_partkey, l_linenumber, 'l_quantity', l_quantity FROM lineitem""",
)
def _(spark, sf_dir):
    keys = ["l_orderkey", "l_partkey", "l_linenumber"]
    return reshape.wide_to_long(table(spark, sf_dir, "lineitem").select(*keys, "l_tax", "l_quantity"), keys)


@query(
    "pivot_matrix",
    rounded_sql(
        """SELECT l_suppkey, avg(l_quantity) FILTER (l_returnflag = 'A') AS "A", avg(l_quantity) FILTER (l_returnflag = 'N') AS "N",
avg(l_quantity) FILTER (l_returnflag = 'R') AS "R" FROM lineitem GROUP BY 1""",
        ["l_suppkey"],
        digits(["A", "N", "R"]),
    ),
)
def _(spark, sf_dir):
    out = reshape.pivot_matrix(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag", "l_quantity", ["A", "N", "R"])
    return rounded(out, ["l_suppkey"], digits(["A", "N", "R"]))


@query(
    "arrays_to_long",
    """SELECT vec_id, (i - 1)::INTEGER AS step, embedding[i]::DOUBLE AS value
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return reshape.arrays_to_long(rows, "vec_id", "embedding")


@query(
    "feature_matrix_columns",
    rounded_sql(
        """SELECT l_suppkey, avg(l_tax) AS l_tax__mean, max(l_tax) AS l_tax__max, avg(l_quantity) AS l_quantity__mean,
max(l_quantity) AS l_quantity__max FROM lineitem GROUP BY 1""",
        ["l_suppkey"],
        digits(["l_tax__mean", "l_tax__max", "l_quantity__mean", "l_quantity__max"]),
    ),
)
def _(spark, sf_dir):
    wide = statistical_features(table(spark, sf_dir, "lineitem"), "l_suppkey", ["l_tax", "l_quantity"])
    long = features_long(wide, ["l_suppkey"])
    parts = X.feature_parts("feature")
    long = long.select("l_suppkey", parts["channel"].alias("channel"), parts["feature"].alias("feature"), "value")
    names = [(c, f) for c in ("l_tax", "l_quantity") for f in ("mean", "max")]
    out = features_wide(long, ["l_suppkey"], names)
    return rounded(out, ["l_suppkey"], digits([f"{c}__{f}" for c, f in names]))


@query(
    "test_histories",
    f"""{FORECAST_CTE} SELECT s.sequence_id::BIGINT AS sequence_id, list_sum(list(value ORDER BY p)).round(4) AS total,
count(*)::INTEGER AS length FROM spans s JOIN pos ON pos.user_id = s.user_id AND p >= start AND p < start + 12
WHERE split = 'test' GROUP BY 1""",
)
def _(spark, sf_dir):
    sequences, targets = forecasting_windows(spark, sf_dir)
    test = sequences.join(targets.filter("split = 'test'").select("sequence_id"), "sequence_id", "left_semi")
    arrays = reshape.sequence_arrays(test)
    total = F.aggregate("value", F.lit(0.0), lambda a, v: a + v)
    return arrays.select("sequence_id", F.round(total, 4).alias("total"), "length")


# --- joins -----------------------------------------------------------------------------------------


@query(
    "paired_self_join",
    """WITH m AS (SELECT l_suppkey, l_linestatus, l_returnflag AS g, max_by(l_quantity, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber) AS v
FROM lineitem GROUP BY 1, 2, 3)
SELECT a.l_suppkey::VARCHAR AS supplier, a.l_linestatus AS status, a.g AS group_1, b.g AS group_2, a.v AS x, b.v AS y
FROM m a JOIN m b ON a.l_suppkey = b.l_suppkey AND a.l_linestatus = b.l_linestatus AND a.g < b.g""",
)
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn(
        "o", F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")
    )
    pairs = cmp.paired_rows(lines, "l_returnflag", "l_quantity", ["l_suppkey", "l_linestatus"], ["o"])
    return pairs.withColumnsRenamed({"__k0": "supplier", "__k1": "status"})


_LAGGED = f"""WITH {POSITIONS}, lagged AS (SELECT user_id, value AS x, lag(value, 1) OVER (PARTITION BY user_id ORDER BY p) AS l1 FROM pos)"""


@query(
    "multi_way_feature_join",
    rounded_sql(
        f"""{_LAGGED}, base AS (SELECT user_id, avg(value) AS value__mean, median(value) AS value__median FROM events GROUP BY 1),
lags AS (SELECT user_id, corr(x, l1) AS autocorr_1 FROM lagged GROUP BY 1),
spread AS (SELECT user_id, stddev_samp(value) AS value__std FROM events GROUP BY 1)
SELECT user_id, value__mean, value__median, value__std, autocorr_1 FROM base JOIN lags USING (user_id) JOIN spread USING (user_id)""",
        ["user_id"],
        digits(["value__mean", "value__median", "value__std", "autocorr_1"]),
    ),
)
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    base = base_features(events, "user_id", ["value"]).select("user_id", "value__mean", "value__median")
    spread = statistical_features(events, "user_id", ["value"]).select("user_id", "value__std")
    lags = lag_correlations(events, "user_id", ["ts", "event_id"], ["value"], (1,)).drop("channel")
    return rounded(
        base.join(spread, "user_id").join(lags, "user_id"),
        ["user_id"],
        digits(["value__mean", "value__median", "value__std", "autocorr_1"]),
    )


@query(
    "semi_join_rows",
    "SELECT event_id, value FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 70)",
)
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    busy = events.groupBy("user_id").count().filter("count >= 70")
    return events.join(busy, "user_id", "left_semi").select("event_id", "value")


@query(
    "anti_join_completed",
    """SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
AND o_orderpriority = '1-URGENT')""",
)
def _(spark, sf_dir):
    done = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(done, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query(
    "tolerance_join",
    """WITH c AS (SELECT DISTINCT l_discount + CASE WHEN l_discount > 0.05 THEN 0.003 ELSE 0.0 END AS d FROM lineitem)
SELECT round(c.d, 6) AS d, round(avg(l.l_quantity), 6) AS mean_value FROM c LEFT JOIN (SELECT l_discount, l_quantity FROM lineitem) l
ON abs(l.l_discount - c.d) <= 1e-4 GROUP BY 1""",
)
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("d"), "l_quantity")
    conditions = lines.select((F.col("d") + F.when(F.col("d") > 0.05, 0.003).otherwise(0.0)).alias("d"))
    out = cmp.tolerance_join(conditions, lines, "d", "l_quantity", 1e-4)
    return out.select(F.round("d", 6).alias("d"), F.round("mean_value", 6).alias("mean_value"))


@query(
    "index_merge",
    """SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def _(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", "n_name", "r_name")


@query(
    "positional_pairing",
    """WITH r AS (SELECT o_orderstatus AS s, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders)
SELECT a.position, a.o_totalprice AS x, b.o_totalprice AS y FROM r a JOIN r b USING (position) WHERE a.s = 'F' AND b.s = 'O'""",
)
def _(spark, sf_dir):
    return cmp.positional_pairs(
        table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice", ["o_orderdate", "o_orderkey"], "F", "O"
    )


@query(
    "configuration_product",
    """SELECT n_name AS dataset, unnest([42, 101])::INTEGER AS seed, extractor, model FROM nation,
(SELECT unnest(['compact', 'minimal']) AS extractor) e, (SELECT unnest(['random_forest', 'ridge']) AS model) m""",
)
def _(spark, sf_dir):
    from tidemark.plans.matrix import configuration_table

    return configuration_table(
        table(spark, sf_dir, "nation").select(F.col("n_name").alias("dataset")),
        {"seed": [42, 101], "extractor": ["compact", "minimal"], "model": ["random_forest", "ridge"]},
    )


@query(
    "truth_set_match",
    """WITH offered AS (SELECT DISTINCT l_partkey AS feature FROM lineitem), planted AS (SELECT p_partkey AS feature FROM part WHERE p_size <= 10),
sel AS (SELECT DISTINCT l_suppkey AS run, l_partkey AS feature FROM lineitem WHERE l_quantity > 25),
np AS (SELECT count(*) AS k FROM offered JOIN planted USING (feature)),
hits AS (SELECT run, count(planted.feature) AS tp, count(*) - count(planted.feature) AS fp FROM sel LEFT JOIN planted USING (feature) GROUP BY 1)
SELECT run, tp, fp, k - tp AS fn, round(fp / (fp + tp), 6) AS fdp, round(tp / k, 6) AS power FROM hits, np""",
)
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    chosen = lines.filter("l_quantity > 25").select(F.col("l_suppkey").alias("run"), F.col("l_partkey").alias("feature"))
    truth = table(spark, sf_dir, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("feature"))
    universe = lines.select(F.col("l_partkey").alias("feature"))
    out = cmp.truth_match(chosen.distinct(), truth, universe, ["run"])
    return out.select("run", "tp", "fp", "fn", F.round("fdp", 6).alias("fdp"), F.round("power", 6).alias("power"))


# --- grouped summaries -----------------------------------------------------------------------------

_SUMMARY = digits([f"n_chars__{s}" for s in ("mean", "std", "median", "min", "max")], 5)


@query(
    "summary_statistics",
    rounded_sql(
        """SELECT lang, coalesce(quality::VARCHAR, 'none') AS quality, avg(n_chars) AS n_chars__mean,
stddev_samp(n_chars) AS n_chars__std, median(n_chars) AS n_chars__median, min(n_chars) AS n_chars__min, max(n_chars) AS n_chars__max
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""",
        ["lang", "quality"],
        _SUMMARY,
    ),
)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rounded(agg.summary_statistics(docs, ["lang", "quality"], ["n_chars"]), ["lang", "quality"], _SUMMARY)


@query(
    "mean_intervals",
    rounded_sql(
        # The Student quantile by its expansion around the normal one; a supplier has hundreds of lines.
        """WITH s AS (SELECT l_suppkey, count(*) AS n, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS sd, count(*) - 1.0::DOUBLE AS v
FROM lineitem GROUP BY 1), z AS (SELECT 1.959963984540054::DOUBLE AS z),
t AS (SELECT *, (z + (pow(z, 3) + z) / (4 * v) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * v * v)
+ (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / (384 * pow(v, 3))) * sd / sqrt(n) AS half FROM s, z)
SELECT l_suppkey, n, m AS mean, m - half AS lower, m + half AS upper FROM t""",
        ["l_suppkey", "n"],
        digits(["mean", "lower", "upper"], 2),
    ),
)
def _(spark, sf_dir):
    found = agg.mean_interval(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice")
    return rounded(found, ["l_suppkey", "n"], digits(["mean", "lower", "upper"], 2))


@query(
    "quartiles",
    rounded_sql(
        """SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q25, median(l_extendedprice) AS median,
quantile_cont(l_extendedprice, 0.75) AS q75, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS iqr
FROM lineitem GROUP BY 1""",
        ["l_returnflag"],
        digits(["q25", "median", "q75", "iqr"], 3),
    ),
)
def _(spark, sf_dir):
    out = agg.quartiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return rounded(out, ["l_returnflag"], digits(["q25", "median", "q75", "iqr"], 3))


_BOX = digits(["q25", "median", "q75", "whisker_low", "whisker_high"], 4)


@query(
    "box_statistics",
    rounded_sql(
        """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q25, median(value) AS median, quantile_cont(value, 0.75) AS q75
FROM events GROUP BY 1), j AS (SELECT *, value >= q25 - 1.5 * (q75 - q25) AND value <= q75 + 1.5 * (q75 - q25) AS inside FROM events JOIN q USING (event_type))
SELECT event_type, count(*) FILTER (NOT inside) AS n_outside, max(q25) AS q25, max(median) AS median, max(q75) AS q75,
min(value) FILTER (inside) AS whisker_low, max(value) FILTER (inside) AS whisker_high FROM j GROUP BY 1""",
        ["event_type", "n_outside"],
        _BOX,
    ),
)
def _(spark, sf_dir):
    out = agg.box_statistics(table(spark, sf_dir, "events"), ["event_type"], "value")
    return rounded(out, ["event_type", "n_outside"], _BOX)


@query(
    "growth_slopes",
    rounded_sql(
        """SELECT l_returnflag, count(*) AS n, regr_slope(ln(l_extendedprice), ln(l_quantity)) AS slope,
regr_r2(ln(l_extendedprice), ln(l_quantity)) AS r2 FROM lineitem GROUP BY 1""",
        ["l_returnflag", "n"],
        digits(["slope", "r2"]),
    ),
)
def _(spark, sf_dir):
    out = agg.growth_slope(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return rounded(out, ["l_returnflag", "n"], digits(["slope", "r2"]))


_PROFILE = digits(["mean", "std", "min", "q25", "median", "q75", "max", "skew"], 4)


@query(
    "target_profile",
    rounded_sql(
        """SELECT event_type, count(*) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
quantile_cont(value, 0.25) AS q25, median(value) AS median, quantile_cont(value, 0.75) AS q75, max(value) AS max,
skewness(value) AS skew FROM events GROUP BY 1""",
        ["event_type", "count"],
        _PROFILE,
    ),
)
def _(spark, sf_dir):
    out = agg.target_profile(table(spark, sf_dir, "events"), "value", ["event_type"])
    return rounded(out, ["event_type", "count"], _PROFILE)


@query(
    "class_sizes",
    """SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM embeddings), 6) AS share FROM embeddings GROUP BY 1""",
)
def _(spark, sf_dir):
    out = agg.class_sizes(table(spark, sf_dir, "embeddings"), "label")
    return out.select("label", "n", F.round("share", 6).alias("share"))


@query(
    "distinct_counts",
    """SELECT l_returnflag, count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT l_quantity) AS n_quantities FROM lineitem GROUP BY 1""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.countDistinct("l_suppkey").alias("n_suppliers"), F.countDistinct("l_quantity").alias("n_quantities")
    )


@query("table_fingerprint")
def _(spark, sf_dir):
    return agg.table_fingerprint(table(spark, sf_dir, "orders"))


@query(
    "regression_diagnostics",
    rounded_sql(
        """SELECT l_returnflag, count(*) AS n, 1 - sum(pow(l_extendedprice - p, 2)) / sum(pow(l_extendedprice - m, 2)) AS r2,
sqrt(avg(pow(l_extendedprice - p, 2))) AS rmse, avg(abs(l_extendedprice - p)) AS mae FROM
(SELECT *, l_quantity * 2000 AS p, avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) GROUP BY 1""",
        ["l_returnflag", "n"],
        {"r2": 6, "rmse": 4, "mae": 4},
    ),
)
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_quantity") * 2000)
    out = agg.regression_diagnostics(lines, "l_extendedprice", "p", ["l_returnflag"])
    return rounded(out, ["l_returnflag", "n"], {"r2": 6, "rmse": 4, "mae": 4})


@query(
    "selected_per_channel",
    """SELECT l_returnflag AS channel, count(*) AS n_selected FROM (SELECT l_returnflag, l_linenumber FROM lineitem
GROUP BY 1, 2 HAVING avg(l_quantity) > 25) GROUP BY 1""",
)
def _(spark, sf_dir):
    mask = table(spark, sf_dir, "lineitem").groupBy(
        F.concat("l_returnflag", F.lit("__line_"), F.col("l_linenumber")).alias("feature")
    ).agg((F.avg("l_quantity") > 25).alias("selected"))
    return cmp.channel_counts(mask)


# --- window functions, sorts, sets -------------------------------------------------------------------


@query(
    "keep_last_row",
    """SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id, max_by(value, (ts, event_id)) AS value
FROM events GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return cmp.keep_last(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query(
    "persistence_baseline",
    rounded_sql(
        """SELECT event_id, coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), (SELECT avg(value) FROM events)) AS prediction FROM events""",
        ["event_id"],
        {"prediction": 6},
    ),
)
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    mean = events.agg(F.avg("value").alias("m")).scalar()
    out = cmp.persistence_baseline(events, ["user_id"], ["ts", "event_id"], "value", mean)
    return rounded(out, ["event_id"], {"prediction": 6})


@query("largest_rows", "SELECT l_orderkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(20).select("l_orderkey", "l_extendedprice")


@query(
    "top_rows_per_group",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 3""",
)
def _(spark, sf_dir):
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    out = cmp.top_per_group(table(spark, sf_dir, "lineitem"), ["l_suppkey"], order, 3)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    "rows_of_first_ids",
    "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY 1 LIMIT 25)",
)
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    first = events.select("user_id").distinct().orderBy("user_id").limit(25)
    return events.join(first, "user_id", "left_semi").select("event_id", "user_id")


@query("sampled_rows")
def _(spark, sf_dir):
    return sample_rows(table(spark, sf_dir, "events"), 500, "event_id")


@query(
    "union_of_differing_columns",
    """SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment, NULL::VARCHAR AS name FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier""",
)
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name")
    )
    return c.unionByName(s, allowMissingColumns=True)


@query(
    "set_difference_and_intersection",
    """SELECT 'both' AS part, count(*) AS n FROM (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_tax = 0)
UNION ALL SELECT 'only', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 25 EXCEPT SELECT l_partkey FROM lineitem WHERE l_tax = 0)""",
)
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    both = lines.filter("l_quantity > 49").select("l_suppkey").intersect(lines.filter("l_tax = 0").select("l_suppkey"))
    only = lines.filter("l_quantity > 25").select("l_partkey").subtract(lines.filter("l_tax = 0").select("l_partkey"))
    return both.agg(F.lit("both").alias("part"), F.count("*").alias("n")).unionByName(
        only.agg(F.lit("only").alias("part"), F.count("*").alias("n"))
    )


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query(
    "sequence_series_by_supplier",
    """WITH pos AS (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_partkey, l_linenumber) - 1 AS p,
count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem), off AS (SELECT l_suppkey, n // 50 AS w,
coalesce(sum(n // 50) OVER (ORDER BY l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1))
SELECT (o + p // 50)::BIGINT AS sequence_id, round(avg(l_quantity), 6) AS target FROM pos JOIN off USING (l_suppkey) WHERE p // 50 < w GROUP BY 1""",
)
def _(spark, sf_dir):
    targets = segment_time_series(
        table(spark, sf_dir, "lineitem"), 50, None, ["l_shipdate", "l_orderkey", "l_partkey", "l_linenumber"],
        ["l_quantity"], "l_quantity", "mean", "l_suppkey",
    )[1]
    return targets.select("sequence_id", F.round("target", 6).alias("target"))
