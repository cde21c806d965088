"""Fitted models, intervals and preparation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models, splits

ID = "sequence_id"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(120, 3))
    y = 2 * x[:, 0] - x[:, 1] + 5
    rows = [(i, f"f{j}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row)]
    features = spark.createDataFrame(rows, "sequence_id long, feature string, value double").cache()
    real = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "sequence_id long, target double").cache()
    classes = real.withColumn("target", F.when(F.col("target") > 5, "high").otherwise("low"))
    return x, y, features, real, classes


def roles(targets, k=3):
    return splits.fold_roles(targets.select(ID, (F.col(ID) % k).cast("int").alias("fold")), k)


@pytest.mark.parametrize("name", ["random_forest", "logistic_regression", "gradient_boosting", "absent"])
def test_class_models_on_text_labels(data, name):
    _x, _y, features, _real, classes = data
    pooled = models.cross_validate(features, classes, roles(classes), name, trees=10)
    assert pooled.count() == 120
    assert models.accuracy(pooled).first().accuracy > 0.8
    assert pooled.filter(F.abs(F.aggregate("probabilities", F.lit(0.0), lambda a, v: a + v) - 1) > 1e-9).isEmpty()


def test_ridge_is_the_closed_form(data):
    x, y, features, real, _classes = data
    pooled = {r[ID]: r.prediction for r in models.cross_validate(features, real, roles(real), "ridge", "regression").collect()}
    train = np.arange(120) % 3 != 1
    scale = x[train].std(axis=0, ddof=1)
    z = x / scale
    zc, yc = z[train] - z[train].mean(axis=0), y[train] - y[train].mean()
    w = np.linalg.solve(zc.T @ zc + np.eye(3), zc.T @ yc)
    want = (z - z[train].mean(axis=0)) @ w + y[train].mean()
    assert all(math.isclose(pooled[i], want[i], rel_tol=1e-6) for i in range(1, 120, 3))


def test_forest_interval_is_a_quantile_of_its_trees(data):
    _x, _y, features, real, _classes = data
    targets = real.select(ID, F.array("target", F.col("target") + 1).alias("target"))
    out = models.direct_forecast(features, targets, splits.holdout(targets, 0.25), trees=10)
    rows = out.collect()
    assert {r.horizon for r in rows} == {1, 2} and len(rows) == 60
    assert all(r.lower <= r.upper for r in rows)
    assert np.mean([r.lower <= r.prediction <= r.upper for r in rows]) > 0.9


def test_residual_interval_is_symmetric(data):
    _x, _y, features, real, _classes = data
    noisy = real.withColumn("target", F.array(F.col("target") + (F.col(ID) % 7) * 0.1))
    rows = models.direct_forecast(features, noisy, splits.holdout(noisy, 0.25), "ridge").collect()
    assert len({round(r.upper - r.lower, 9) for r in rows}) == 1
    assert all(math.isclose(r.upper - r.prediction, r.prediction - r.lower, rel_tol=1e-9) for r in rows)


def test_array_quantile(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0, 10.0],)], "v array<double>")
    got = df.select(*[models.array_quantile(F.col("v"), q).alias(str(q)) for q in (0.0, 0.4, 1.0)]).first()
    assert list(got) == [1.0, 2.2, 10.0]


def test_error_metrics_of_a_constant_truth(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "label double, prediction double")
    row = models.error_metrics(df).first()
    assert (row.rmse, row.mae, row.r2) == (1.0, 1.0, 0.0)


def test_area_with_ties_by_pairs(spark):
    rng = np.random.default_rng(2)
    s, y = rng.integers(0, 6, 60).astype(float), rng.integers(0, 2, 60)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, label int")
    got = models.rank_auc(df, "score", F.col("label") == 1).first().auc
    want = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert math.isclose(got, want)


def test_impute_and_scale(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (4.0, None), (7.0, None)], "a double, b double")
    filled = models.impute(df, df, ["a", "b"])
    assert sorted(r.a for r in filled.collect()) == [1.0, 4.0, 4.0, 7.0] and {r.b for r in filled.collect()} == {0.0}
    scaled = models.standardise(filled, ["a", "b"])
    row = scaled.agg(F.avg("a").alias("m"), F.stddev_pop("a").alias("s"), F.max("b").alias("b")).first()
    assert abs(row.m) < 1e-12 and math.isclose(row.s, 1.0) and row.b == 0


def test_grid_search_prefers_the_deeper_forest(data):
    _x, _y, features, _real, classes = data
    grid = [{"trees": 5, "depth": 1}, {"trees": 20, "depth": 5}]
    best = models.grid_search(features, classes, roles(classes, 2), grid).first()
    assert "('depth', 5)" in best.setting


def test_settings_reach_the_model_and_unknown_ones_are_refused(data):
    _x, _y, features, real, classes = data
    loose = models.cross_validate(features, real, roles(real), {"name": "ridge", "alpha": 1e6}, "regression")
    spread = loose.groupBy("fold").agg(F.stddev_pop("prediction").alias("s")).agg(F.max("s")).first()[0]
    assert spread < 0.1  # such a penalty leaves the mean
    for model in ({"name": "ridge", "C": 2.0}, {"name": "random_forest", "alpha": 1.0}):
        with pytest.raises(ValueError):
            models.cross_validate(features, real, roles(real), model, "regression")
    with pytest.raises(ValueError):
        models.grid_search(features, classes, roles(classes, 2), [{"colour": 3}])
    grid = [{"model": "logistic_regression", "C": c} for c in (1e-6, 1.0)]
    best = models.grid_search(features, classes, roles(classes, 2), grid).first()
    assert "('C', 1.0)" in best.setting


def test_boosting_of_three_classes(data):
    _x, _y, features, real, _classes = data
    three = real.withColumn("target", F.when(F.col("target") > 6, "high").when(F.col("target") > 4, "middle").otherwise("low"))
    pooled = models.cross_validate(features, three, roles(three), {"name": "gradient_boosting", "rounds": 5}).cache()
    assert models.accuracy(pooled).first().accuracy > 0.6
    assert pooled.filter(F.abs(F.aggregate("probabilities", F.lit(0.0), lambda a, v: a + v) - 1) > 1e-9).isEmpty()
