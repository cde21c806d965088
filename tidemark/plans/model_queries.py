"""Queries that fit models or score predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import models, splits
from tidemark.operators.compare import forecast_summary
from tidemark.operators.features.extractors import extract
from tidemark.operators.reshape import horizon_vector
from tidemark.plans.registry import digits, query, rounded, rounded_sql, table
from tidemark.plans.selection_queries import embedding_features, line_features, order_features
from tidemark.plans.window_queries import FORECAST_CTE, event_windows, forecasting_windows
from tidemark.session import cut_lineage

ID = "sequence_id"

# --- metrics on given predictions ---------------------------------------------------------------------

_DOCS = """WITH pred AS (SELECT doc_id, quality::DOUBLE AS label, CASE WHEN n_chars > 800 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction,
n_chars / (n_chars + 800.0) AS score, (doc_id % 5)::INTEGER AS fold FROM documents JOIN labels USING (doc_id))"""


def quality_predictions(spark, sf_dir):
    """Document quality guessed from its length."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select(
        "doc_id",
        F.col("quality").cast("double").alias("label"),
        (F.col("n_chars") > 800).cast("double").alias("prediction"),
        (F.col("n_chars") / (F.col("n_chars") + 800.0)).alias("score"),
        (F.col("doc_id") % 5).cast("int").alias("fold"),
    )


@query(
    "accuracy_by_fold",
    rounded_sql(
        f"{_DOCS} SELECT fold, count(*) AS n, avg((label = prediction)::INTEGER) AS accuracy FROM pred GROUP BY 1",
        ["fold", "n"],
        {"accuracy": 6},
    ),
)
def _(spark, sf_dir):
    return rounded(models.accuracy(quality_predictions(spark, sf_dir), ["fold"]), ["fold", "n"], {"accuracy": 6})


_REPORT = f"""{_DOCS}, c AS (SELECT unnest([0.0, 1.0]::DOUBLE[]) AS class),
m AS (SELECT class, count(*) FILTER (label = class AND prediction = class) AS tp, count(*) FILTER (label = class) AS support,
  count(*) FILTER (prediction = class) AS predicted FROM pred, c GROUP BY 1),
r AS (SELECT class, support, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall FROM m),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r)"""


@query(
    "class_report",
    rounded_sql(f"{_REPORT} SELECT * FROM f", ["class", "support"], digits(["precision", "recall", "f1"])),
)
def _(spark, sf_dir):
    report = models.class_report(quality_predictions(spark, sf_dir))
    return rounded(report, ["class", "support"], digits(["precision", "recall", "f1"]))


@query("macro_scores", f"{_REPORT} SELECT round(avg(recall), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1 FROM f")
def _(spark, sf_dir):
    return rounded(models.macro_scores(quality_predictions(spark, sf_dir)), [], digits(["balanced_accuracy", "macro_f1"]))


@query(
    "balanced_accuracy_pooled_and_by_fold",
    f"""{_DOCS}, r AS (SELECT fold, label, avg((label = prediction)::INTEGER) AS recall FROM pred GROUP BY 1, 2),
p AS (SELECT label, avg((label = prediction)::INTEGER) AS recall FROM pred GROUP BY 1)
SELECT round((SELECT avg(recall) FROM p), 6) AS pooled, round((SELECT avg(b) FROM (SELECT avg(recall) AS b FROM r GROUP BY fold)), 6) AS fold_mean""",
)
def _(spark, sf_dir):
    return rounded(models.balanced_accuracy(quality_predictions(spark, sf_dir)), [], digits(["pooled", "fold_mean"]))


@query("brier_score", f"{_DOCS} SELECT fold, round(avg(pow(score - label, 2)), 6) AS brier FROM pred GROUP BY 1")
def _(spark, sf_dir):
    scores = models.brier_score(quality_predictions(spark, sf_dir), F.col("score"), F.col("label"), ["fold"])
    return rounded(scores, ["fold"], {"brier": 6})


@query(
    "area_under_curve",
    f"""{_DOCS}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM pred),
s AS (SELECT sum(label) AS n1, sum(1 - label) AS n0, sum(label * rk) AS rs FROM r)
SELECT round((rs - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc FROM s""",
)
def _(spark, sf_dir):
    out = models.rank_auc(quality_predictions(spark, sf_dir), "score", F.col("label") == 1)
    return rounded(out, [], {"auc": 6})


@query(
    "error_metrics",
    rounded_sql(
        """WITH t AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 2000 AS p FROM lineitem)
SELECT l_returnflag, count(*) AS n, sqrt(avg(pow(y - p, 2))) AS rmse, avg(abs(y - p)) AS mae, 1 - avg(pow(y - p, 2)) / var_pop(y) AS r2 FROM t GROUP BY 1""",
        ["l_returnflag", "n"],
        {"rmse": 3, "mae": 3, "r2": 6},
    ),
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 2000).alias("prediction")
    )
    return rounded(models.error_metrics(rows, ["l_returnflag"]), ["l_returnflag", "n"], {"rmse": 3, "mae": 3, "r2": 6})


@query(
    "mean_baseline",
    rounded_sql(
        """SELECT o_orderkey, (SELECT avg(o_totalprice) FROM orders WHERE o_orderkey % 4 <> 0) AS prediction FROM orders WHERE o_orderkey % 4 = 0""",
        ["o_orderkey"],
        {"prediction": 3},
    ),
)
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("label", F.col("o_totalprice"))
    train, test = orders.filter("o_orderkey % 4 <> 0"), orders.filter("o_orderkey % 4 = 0")
    return rounded(models.mean_baseline(train, test), ["o_orderkey"], {"prediction": 3})


# The forecast is the last value of the history, with an interval of 60 either side.
_NAIVE = f"""{FORECAST_CTE}, naive AS (SELECT s.sequence_id, s.split, (f.p - s.start - 11)::INTEGER AS horizon, f.value AS truth, h.value AS prediction
FROM spans s JOIN pos h ON h.user_id = s.user_id AND h.p = s.start + 11 JOIN pos f ON f.user_id = s.user_id AND f.p >= s.start + 12 AND f.p < s.start + 15)"""


def naive_forecasts(spark, sf_dir):
    sequences, targets = forecasting_windows(spark, sf_dir)
    last = sequences.groupBy(ID).agg(F.max_by("value", "step").alias("prediction"))
    rows = models.horizon_rows(horizon_vector(targets)).join(last, ID).join(targets.select(ID, "split"), ID)
    return rows.select(
        ID, "split", "horizon", F.col("label").alias("truth"), "prediction",
        (F.col("prediction") - 60).alias("lower"), (F.col("prediction") + 60).alias("upper"),
    )


_FORECAST = digits(["rmse", "mae", "coverage", "width"], 5)
_FORECAST_AGG = """sqrt(avg(pow(prediction - truth, 2))) AS rmse, avg(abs(prediction - truth)) AS mae,
avg((truth BETWEEN prediction - 60 AND prediction + 60)::INTEGER) AS coverage, avg((prediction + 60) - (prediction - 60)) AS width"""


@query(
    "forecast_metrics",
    rounded_sql(f"{_NAIVE} SELECT split, {_FORECAST_AGG} FROM naive GROUP BY 1", ["split"], _FORECAST),
)
def _(spark, sf_dir):
    return rounded(models.forecast_metrics(naive_forecasts(spark, sf_dir), keys=["split"]), ["split"], _FORECAST)


@query(
    "forecast_metrics_by_horizon",
    rounded_sql(f"{_NAIVE} SELECT split, horizon, {_FORECAST_AGG} FROM naive GROUP BY 1, 2", ["split", "horizon"], _FORECAST),
)
def _(spark, sf_dir):
    out = models.forecast_metrics(naive_forecasts(spark, sf_dir), True, ["split"])
    return rounded(out, ["split", "horizon"], _FORECAST)


@query(
    "forecast_summary",
    rounded_sql(
        f"""{_NAIVE} SELECT split, horizon, avg(truth) AS mean_truth, avg(prediction) AS mean_prediction,
avg(prediction - 60) AS mean_lower, avg(prediction + 60) AS mean_upper FROM naive GROUP BY 1, 2""",
        ["split", "horizon"],
        digits([f"mean_{c}" for c in ("truth", "prediction", "lower", "upper")], 5),
    ),
)
def _(spark, sf_dir):
    out = forecast_summary(naive_forecasts(spark, sf_dir), ["split"])
    return rounded(out, ["split", "horizon"], digits([f"mean_{c}" for c in ("truth", "prediction", "lower", "upper")], 5))


@query(
    "impute_median",
    """WITH d AS (SELECT doc_id, CASE WHEN quality = 1 THEN n_chars::DOUBLE END AS size FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, coalesce(size, (SELECT quantile_cont(size, 0.5) FROM d)) AS size, 0.0::DOUBLE AS unknown FROM d""",
)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    size = F.when(F.col("quality") == 1, F.col("n_chars").cast("double"))
    docs = docs.select("doc_id", size.alias("size"), F.lit(None).cast("double").alias("unknown"))
    return models.impute(docs, docs, ["size", "unknown"]).select("doc_id", "size", "unknown")


@query(
    "ordinal_and_standard_scale",
    rounded_sql(
        """SELECT o_orderkey, (substr(o_orderpriority, 1, 1)::INTEGER - 1)::INTEGER AS level,
(o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER () AS o_totalprice FROM orders""",
        ["o_orderkey", "level"],
        {"o_totalprice": 6},
    ),
)
def _(spark, sf_dir):
    order = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    orders = table(spark, sf_dir, "orders").withColumn("level", models.ordinal_encode(F.col("o_orderpriority"), order))
    return rounded(models.standardise(orders, ["o_totalprice"]), ["o_orderkey", "level"], {"o_totalprice": 6})


# --- fitted models ------------------------------------------------------------------------------------


def _ordinal_roles(targets, k=3):
    """Folds by id modulo k, so the SQL can name them."""
    folds = targets.select(ID, (F.col(ID) % k).cast("int").alias("fold"))
    return splits.fold_roles(folds, k)


def _ridge_sql(alpha: float) -> str:
    return f"""WITH src AS (SELECT o_orderkey AS id, o_totalprice AS y, (o_custkey % 97)::DOUBLE AS raw, (o_orderkey % 3)::INTEGER AS fold FROM orders),
f AS (SELECT unnest(range(0, 3))::INTEGER AS k),
st AS (SELECT k, stddev_samp(raw) AS s FROM src JOIN f ON fold <> k GROUP BY 1),
fit AS (SELECT k, any_value(s) AS s, avg(raw / s) AS mx, avg(y) AS my,
  covar_pop(y, raw / s) * count(*) / (var_pop(raw / s) * count(*) + {alpha}) AS b FROM src JOIN f ON fold <> k JOIN st USING (k) GROUP BY 1)
SELECT id AS sequence_id, fold, my + b * (raw / s - mx) AS prediction, y FROM src JOIN fit ON fold = k"""


@query("ridge_out_of_fold", rounded_sql(_ridge_sql(1.0), ["sequence_id", "fold"], {"prediction": 2}))
def _(spark, sf_dir):
    features, targets = order_features(spark, sf_dir)
    pooled = models.cross_validate(
        features.filter("feature = 'cust_mod'"), targets, _ordinal_roles(targets), "ridge", "regression"
    )
    return rounded(pooled, [ID, "fold"], {"prediction": 2})


@query(
    "ridge_settings",
    " UNION ALL ".join(
        f"SELECT {alpha}::DOUBLE AS alpha, fold, round(sqrt(avg((prediction - y) * (prediction - y))), 2) AS rmse FROM ({_ridge_sql(alpha)}) GROUP BY fold"
        for alpha in (1.0, 5000.0, 1e6)
    ),
)
def _(spark, sf_dir):
    """One model with several settings: the errors of each."""
    features, targets = order_features(spark, sf_dir)
    features, out = features.filter("feature = 'cust_mod'"), None
    for alpha in (1.0, 5000.0, 1e6):
        pooled = models.cross_validate(features, targets, _ordinal_roles(targets), {"name": "ridge", "alpha": alpha}, "regression")
        part = pooled.groupBy("fold").agg(F.round(F.sqrt(F.avg((F.col("prediction") - F.col("label")) ** 2)), 2).alias("rmse"))
        part = part.select(F.lit(alpha).alias("alpha"), "fold", "rmse")
        out = part if out is None else out.union(part)
    return out


@query("random_forest_out_of_fold")
def _(spark, sf_dir):
    features, targets = embedding_features(spark, sf_dir)
    pooled = models.cross_validate(features, targets, _ordinal_roles(targets), "random_forest", trees=20)
    return models.accuracy(pooled, ["fold"])


@query("logistic_regression_out_of_fold")
def _(spark, sf_dir):
    features, targets = line_features(spark, sf_dir)
    pooled = models.cross_validate(features, targets, _ordinal_roles(targets), "logistic_regression")
    return models.macro_scores(pooled)


@query("gradient_boosting_out_of_fold")
def _(spark, sf_dir):
    windows, targets = event_windows(spark, sf_dir)
    # Names, vectors and roles are read from them.
    features, targets = cut_lineage(extract(windows, "statistics_sample")), cut_lineage(targets)
    pooled = models.cross_validate(features, targets, _ordinal_roles(targets), "gradient_boosting")
    return models.accuracy(pooled, ["fold"])


def _forecast(spark, sf_dir, model):
    sequences, targets = forecasting_windows(spark, sf_dir)
    features = extract(sequences, "statistics_sample")
    roles = splits.holdout(targets, 0.25)
    return models.direct_forecast(features, horizon_vector(targets), roles, model, trees=10)


@query("forest_forecast_intervals")
def _(spark, sf_dir):
    return models.forecast_metrics(_forecast(spark, sf_dir, "random_forest"), per_horizon=True)


@query("ridge_forecast_intervals")
def _(spark, sf_dir):
    return models.forecast_metrics(_forecast(spark, sf_dir, "ridge"), per_horizon=True)


@query("grid_search")
def _(spark, sf_dir):
    features, targets = embedding_features(spark, sf_dir)
    grid = [{"trees": 5, "depth": 3}, {"trees": 10, "depth": 5}]
    return models.grid_search(features, targets, _ordinal_roles(targets, 2), grid)


@query("polynomial_comparison")
def _(spark, sf_dir):
    features, targets = order_features(spark, sf_dir)
    part = features.filter("feature IN ('cust_mod', 'priority')")
    return models.polynomial_comparison(part, targets, _ordinal_roles(targets, 2))
