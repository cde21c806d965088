"""Fitting and scoring with Spark ML and own forests: classification, regression and direct multi-horizon forecasts."""

from __future__ import annotations

import time
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, PolynomialExpansion, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.special import normal_quantile
from tidemark.operators.forests import RandomForest, RandomForestModel
from tidemark.operators.model_selection import assemble, feature_names, indexed_target
from tidemark.operators.position import exact_quantiles
from tidemark.session import cut_lineage

ID = "sequence_id"


@contextmanager
def stage(timings: dict | None, name: str):
    """Add the seconds spent inside to an entry of `timings`."""
    start = time.perf_counter()
    yield
    if timings is not None:
        timings[name] = timings.get(name, 0.0) + time.perf_counter() - start


# What each model can be told, with its defaults; a depth of None grows trees as far as Spark does.
FULL_DEPTH = 30
MODEL_SETTINGS = {
    "random_forest": {"trees": 100, "depth": None, "min_rows": 1, "features": "auto"},
    "logistic_regression": {"C": 1.0, "max_iter": 200},
    "ridge": {"alpha": 1.0},
    "ridge_centred": {"alpha": 10.0},
    "gradient_boosting": {"rounds": 20, "depth": 5, "rate": 0.1},
}


def model_settings(model: str | Mapping, trees: int | None = None) -> tuple[str, dict]:
    """(kind, settings) of a model given by name or as a dict with `name` and settings, defaults filled in. An unknown name
    is a random forest; a setting that the model does not have is an error."""
    given = {} if isinstance(model, str) else dict(model)
    name = model if isinstance(model, str) else given.pop("name", "random_forest")
    given |= given.pop("kwargs", {})
    kind = name if name in MODEL_SETTINGS else "random_forest"
    known = MODEL_SETTINGS[kind]
    if unknown := sorted(set(given) - set(known)):
        raise ValueError(f"{name} has no setting {', '.join(unknown)}; it has {', '.join(known)}")
    return kind, known | ({"trees": trees} if trees is not None and "trees" in known else {}) | given


def build_model(model: str | Mapping, task_type: str, train: DataFrame, seed: int = 42, trees: int | None = None) -> Pipeline | RandomForest:
    """A pipeline (or a forest) from `features` to `prediction`, for a model as `model_settings` takes it."""
    kind, own = model_settings(model, trees)
    classes = task_type == "classification"
    if (kind == "logistic_regression") > classes or (kind in ("ridge", "ridge_centred")) and classes:
        # Of the other task: a forest, as for an unknown name.
        kind, own = model_settings("random_forest", trees)
    if kind in ("logistic_regression", "ridge", "ridge_centred"):
        n_rows, spread = train.agg(F.count(F.lit(1)), F.stddev_pop("label")).first()
    if kind == "logistic_regression":
        # A penalty of 1 / C on the sum of losses is 1 / (C n) on their mean.
        fit = LogisticRegression(featuresCol="scaled", regParam=1.0 / (own["C"] * n_rows), maxIter=own["max_iter"], standardization=False)
        return Pipeline(stages=[_scaler(False), fit])
    if kind in ("ridge", "ridge_centred"):
        # Spark divides the penalty by the deviation of the label.
        penalty = own["alpha"] * (spread or 1.0) / n_rows
        fit = LinearRegression(
            featuresCol="scaled", regParam=penalty, elasticNetParam=0.0, standardization=False, solver="auto"
        )
        return Pipeline(stages=[_scaler(kind == "ridge_centred"), fit])
    depth = FULL_DEPTH if own["depth"] is None else own["depth"]
    if kind == "gradient_boosting":
        boosted = GBTClassifier if classes else GBTRegressor
        fit = boosted(seed=seed, maxIter=own["rounds"], maxDepth=depth, stepSize=own["rate"])
        if classes and train.select("label").distinct().limit(3).count() > 2:
            # Spark boosts two classes; of several each is told from the rest.
            fit = OneVsRest(classifier=fit)
        return Pipeline(stages=[fit])
    return RandomForest(classes, own["trees"], seed, depth, own["min_rows"], str(own["features"]))


def _scaler(centred: bool) -> StandardScaler:
    return StandardScaler(inputCol="features", outputCol="scaled", withMean=centred, withStd=True)


def fold_sets(rows: DataFrame, roles: DataFrame) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """(fold, train, test) for each fold of an (id, fold, role) table; the list of folds is small."""
    folds = sorted(r[0] for r in roles.select("fold").distinct().collect())
    for fold in folds:
        part = roles.filter(F.col("fold") == fold)
        train = rows.join(part.filter("role = 'train'").select(ID), ID, "left_semi")
        test = rows.join(part.filter("role = 'test'").select(ID), ID, "left_semi")
        yield fold, train, test


def cross_validate(
    features: DataFrame,
    targets: DataFrame,
    roles: DataFrame,
    model: str | Mapping = "random_forest",
    task_type: str = "classification",
    seed: int = 42,
    trees: int | None = None,
    timings: dict | None = None,
) -> DataFrame:
    """Pooled out-of-fold predictions: (id, fold, label, prediction[, probabilities]), written once per
    fold; `timings` collects `fit_s` and `predict_s`."""
    rows = assemble(features, feature_names(features)).join(indexed_target(targets, task_type), ID).persist()
    # Every fold reads the roles, and a fit passes over its train rows many times.
    roles, pooled = cut_lineage(roles), None
    for fold, train, test in fold_sets(rows, roles):
        train = cut_lineage(train)
        with stage(timings, "fit_s"):
            fitted = build_model(model, task_type, train, seed, trees).fit(train)
        with stage(timings, "predict_s"):
            scored = cut_lineage(predict(fitted, test, task_type).withColumn("fold", F.lit(fold)))
        pooled = scored if pooled is None else pooled.unionByName(scored)
    rows.unpersist()
    return pooled


def predict(fitted: PipelineModel | RandomForestModel, rows: DataFrame, task_type: str) -> DataFrame:
    out = fitted.transform(rows)
    columns = [ID, "label", "prediction"]
    if task_type == "classification":
        if isinstance(fitted, RandomForestModel):
            pass  # class shares of its own
        elif "probability" in out.columns:
            out = out.withColumn("probabilities", vector_to_array("probability"))
        else:
            # One margin for each class: half the log-odds against the rest.
            odds = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
            out = out.withColumn("__odds", odds)
            total = F.aggregate("__odds", F.lit(0.0), lambda a, v: a + v)
            out = out.withColumn("probabilities", F.transform("__odds", lambda v: v / total))
        columns.append("probabilities")
    return out.select(*columns)


def mean_baseline(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """The train mean as prediction of every test row (one value, as a scalar subquery)."""
    mean = train.agg(F.avg(label).alias("m")).scalar()
    return test.withColumn("prediction", mean)


# --- metrics -------------------------------------------------------------------------------------


def accuracy(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    hit = (F.col("label") == F.col("prediction")).cast("double")
    return predictions.groupBy(*keys).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def error_metrics(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and R2 (0 for a constant truth)."""
    y = F.col("label").cast("double")
    e = y - F.col("prediction")
    spread = F.var_pop(y)
    r2 = F.when(spread > 0, 1 - F.avg(e * e) / spread).otherwise(0.0)
    return predictions.groupBy(*keys).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), r2.alias("r2"), F.count(F.lit(1)).alias("n")
    )


def class_report(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each class, from the confusion counts."""
    counts = predictions.groupBy(*keys, "label", "prediction").agg(F.count(F.lit(1)).alias("c"))
    by_truth = counts.groupBy(*keys, F.col("label").alias("class")).agg(
        F.sum("c").alias("support"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("c")).otherwise(0)).alias("tp")
    )
    by_guess = counts.groupBy(*keys, F.col("prediction").alias("class")).agg(F.sum("c").alias("predicted"))
    out = by_truth.join(by_guess, [*keys, "class"], "full").fillna(0, ["support", "tp", "predicted"])
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    out = out.withColumns({"precision": precision, "recall": recall})
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.select(*keys, "class", "precision", "recall", F.coalesce(f1, F.lit(0.0)).alias("f1"), "support")


def macro_scores(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Balanced accuracy (mean recall of the classes present) and macro F1."""
    report = class_report(predictions, keys)
    recall = F.avg(F.when(F.col("support") > 0, F.col("recall")))
    return report.groupBy(*keys).agg(recall.alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"))


def balanced_accuracy(predictions: DataFrame) -> DataFrame:
    """Pooled over all folds, and the mean of the per-fold values."""
    pooled = macro_scores(predictions).select(F.col("balanced_accuracy").alias("pooled"))
    per_fold = macro_scores(predictions, ["fold"]).agg(F.avg("balanced_accuracy").alias("m")).scalar()
    return pooled.withColumn("fold_mean", per_fold)


def brier_score(predictions: DataFrame, probability: Column, truth: Column, keys: Sequence[str] = ()) -> DataFrame:
    gap = probability - truth
    return predictions.groupBy(*keys).agg(F.avg(gap * gap).alias("brier"))


def roc_auc(predictions: DataFrame, score_col: str, label_col: str = "label") -> float:
    return BinaryClassificationEvaluator(rawPredictionCol=score_col, labelCol=label_col).evaluate(predictions)


def rank_auc(predictions: DataFrame, score: str, positive: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the curve from average ranks: exact with ties, and distributed for any group size."""
    from tidemark.operators.position import value_ranks

    ranks = value_ranks(predictions, keys, score, positive)
    n1, n = F.max("n1_total").cast("double"), F.max("n_total").cast("double")
    rank_sum = F.sum(F.col("n1") * F.col("avg_rank"))
    auc = F.try_divide(rank_sum - n1 * (n1 + 1) / 2, n1 * (n - n1))
    return ranks.groupBy(*keys).agg(auc.alias("auc"))


# --- forecasts -----------------------------------------------------------------------------------


def horizon_rows(targets: DataFrame) -> DataFrame:
    """(id, horizon, label) from an array target; horizons count from 1."""
    rows = targets.select(ID, F.posexplode("target").alias("h", "label"))
    return rows.select(ID, (F.col("h") + 1).alias("horizon"), "label")


def array_quantile(values: Column, q: float) -> Column:
    """Linearly interpolated quantile of an array of doubles."""
    ordered = F.array_sort(values)
    h = F.lit(q) * (F.size(values) - 1)
    lo = F.floor(h).cast("int")
    low = F.get(ordered, lo)
    high = F.get(ordered, F.ceil(h).cast("int"))
    return low + (high - low) * (h - lo)


def direct_forecast(
    features: DataFrame,
    targets: DataFrame,
    roles: DataFrame,
    model: str | Mapping = "random_forest",
    lower: float = 0.05,
    upper: float = 0.95,
    seed: int = 42,
    trees: int | None = None,
    timings: dict | None = None,
) -> DataFrame:
    """One regressor per horizon: (id, horizon, truth, prediction, lower, upper) of the test rows.

    Forests take the interval from their trees, other models from the spread of the train residuals.
    """
    vectors = assemble(features, feature_names(features))
    # Every horizon fits and scores these rows.
    every = vectors.join(horizon_rows(targets), ID).join(roles.select(ID, "role"), ID).persist()
    n_horizons = every.agg(F.max("horizon")).first()[0]
    out = None
    for h in range(1, n_horizons + 1):
        rows = every.filter(F.col("horizon") == h)
        train, test = rows.filter("role = 'train'"), rows.filter("role = 'test'")
        with stage(timings, "fit_s"):
            fitted = build_model(model, "regression", train, seed, trees).fit(train)
        scored = fitted.transform(test)
        if isinstance(fitted, RandomForestModel):
            # Quantiles of the predictions of the single trees.
            scored = scored.withColumns({"lower": array_quantile(F.col("each"), lower), "upper": array_quantile(F.col("each"), upper)})
        else:
            spread = fitted.transform(train).agg(
                F.coalesce(F.stddev_samp(F.col("label") - F.col("prediction")), F.lit(0.0)).alias("s")
            ).scalar()
            z = normal_quantile(upper)
            scored = scored.withColumn("__s", spread).withColumns(
                {"lower": F.col("prediction") - z * F.col("__s"), "upper": F.col("prediction") + z * F.col("__s")}
            )
        with stage(timings, "predict_s"):
            part = cut_lineage(scored.select(ID, "horizon", F.col("label").alias("truth"), "prediction", "lower", "upper"))
        out = part if out is None else out.unionByName(part)
    every.unpersist()
    return out


def forecast_metrics(predictions: DataFrame, per_horizon: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE, interval coverage (bounds included) and interval width, overall or per horizon."""
    e = F.col("prediction") - F.col("truth")
    inside = F.col("truth").between(F.col("lower"), F.col("upper")).cast("double")
    by = [*keys, *(["horizon"] if per_horizon else [])]
    return predictions.groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(inside).alias("coverage"),
        F.avg(F.col("upper") - F.col("lower")).alias("width"),
    )


# --- preparation and search ----------------------------------------------------------------------


def impute(train: DataFrame, rows: DataFrame, columns: Sequence[str], strategy: str = "median") -> DataFrame:
    """Fill by the train median, mean or mode; columns without any known value become 0."""
    known = train.agg(*[F.count(F.when(~F.isnan(c), F.col(c))).alias(c) for c in columns]).first()
    usable = [c for c in columns if known[c] > 0]
    casted = rows.withColumns({c: F.col(c).cast("double") for c in columns})
    exact = train.withColumns({c: F.col(c).cast("double") for c in usable})
    if usable and strategy == "median":
        # Spark's own imputer approximates the median.
        for c in usable:
            seen = exact.select(F.when(~F.isnan(c), F.col(c)).alias("x"))
            middle = exact_quantiles(seen, [], "x", {"x": 0.5}).first()["x"]
            casted = casted.withColumn(c, F.when(F.col(c).isNull() | F.isnan(c), F.lit(middle)).otherwise(F.col(c)))
    elif usable:
        casted = Imputer(inputCols=usable, outputCols=usable, strategy=strategy).fit(exact).transform(casted)
    return casted.fillna(0.0, [c for c in columns if c not in usable])


def ordinal_encode(column: Column, order: Sequence) -> Column:
    """Place of each value in a fixed order; unknown values are -1."""
    out = F.lit(-1)
    for i, value in enumerate(order):
        out = F.when(column == F.lit(value), i).otherwise(out)
    return out.cast("int")


def standardise(df: DataFrame, columns: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """Centre and scale by the train mean and population deviation (0 -> 1)."""
    stats = (train if train is not None else df).agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()
    return df.withColumns(
        {c: (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0) for c in columns}
    )


def grid_search(
    features: DataFrame,
    targets: DataFrame,
    roles: DataFrame,
    grid: Sequence[Mapping],
    task_type: str = "classification",
    seed: int = 42,
) -> DataFrame:
    """Mean score of each setting over the given folds, best first. A setting is a dict with `model` (a random forest unless
    named) and what that model can be told; anything else is an error."""
    rows = assemble(features, feature_names(features)).join(indexed_target(targets, task_type), ID).persist()
    table = []
    for setting in grid:
        chosen = {"name": setting.get("model", "random_forest")} | {k: v for k, v in setting.items() if k != "model"}
        model_settings(chosen)
        scores = []
        for _fold, train, test in fold_sets(rows, roles):
            model = build_model(chosen, task_type, train, seed, 20)
            scored = predict(model.fit(train), test, task_type)
            if task_type == "classification":
                scores.append(accuracy(scored).first()["accuracy"])
            else:
                scores.append(-error_metrics(scored).first()["rmse"])
        table.append({"setting": str(sorted(setting.items())), "score": float(sum(scores) / len(scores))})
    rows.unpersist()
    return features.sparkSession.createDataFrame(table).orderBy(F.desc("score"), "setting")


def polynomial_comparison(
    features: DataFrame, targets: DataFrame, roles: DataFrame, degrees: Sequence[int] = (1, 2)
) -> DataFrame:
    """Cross-validated mean squared error of linear models of several polynomial degrees."""
    rows = assemble(features, feature_names(features)).join(indexed_target(targets, "regression"), ID).persist()
    table = []
    for degree in degrees:
        errors = []
        for _fold, train, test in fold_sets(rows, roles):
            stages = [
                PolynomialExpansion(degree=degree, inputCol="features", outputCol="expanded"),
                LinearRegression(featuresCol="expanded"),
            ]
            scored = Pipeline(stages=stages).fit(train).transform(test)
            errors.append(scored.agg(F.avg((F.col("label") - F.col("prediction")) ** 2)).first()[0])
        table.append({"degree": degree, "mse": float(sum(errors) / len(errors))})
    rows.unpersist()
    return features.sparkSession.createDataFrame(table, "degree int, mse double")
