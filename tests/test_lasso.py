"""L1 models: the conditions of the optimum hold on the rows themselves."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from tidemark.operators import lasso


def frame(spark, x, y):
    rows = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)], "x array<double>, label double").repartition(4)
    return rows.select(array_to_vector("x").alias("features"), "label")


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)) * np.array([1, 5, 0.1, 2, 1, 1, 100, 0]) + 3
    x[:, 4] = x[:, 0] + 0.05 * rng.normal(size=300)  # nearly the same
    signal = 2 * x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=300)
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    return x, signal, z


@pytest.mark.parametrize("alpha", [0.01, 0.5, 100.0])
def test_real_target(spark, values, alpha):
    x, y, z = values
    found = lasso.fit_l1(frame(spark, x, y), "regression", alpha=alpha)
    b = found.coefficients[0]
    gradient = z.T @ (z @ b - (y - y.mean())) / len(y)
    assert np.allclose(gradient[b != 0], -alpha * np.sign(b[b != 0]), atol=1e-8)
    assert (np.abs(gradient[b == 0]) <= alpha + 1e-8).all() and found.missed < 1e-6
    assert b[7] == 0 and (alpha < 100 or not b.any())


@pytest.mark.parametrize("C, cuts", [(0.05, [0]), (1.0, [0]), (0.2, [-2, 1])])
def test_classes(spark, values, C, cuts):
    x, y, z = values
    label = np.searchsorted(np.array(cuts) + np.median(y), y)
    found = lasso.fit_l1(frame(spark, x, label), "classification", C=C)
    b = found.coefficients
    assert b.shape[0] == (1 if len(cuts) == 1 else 3) and found.missed <= (lasso.MISS if len(b) == 1 else lasso.MISS_SEVERAL)
    # The free intercepts are those at which the classes' mean chances are their shares.
    margin, intercept = z @ b.T, np.zeros(len(b))
    for _ in range(500):
        m = margin + intercept
        m = np.column_stack((np.zeros(len(z)), m)) if len(b) == 1 else m
        share = np.exp(m - m.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        share = share[:, 1:] if len(b) == 1 else share
        hit = (label[:, None] == (1 if len(b) == 1 else np.arange(3))).astype(float)
        intercept -= (share - hit).mean(0) * 4
    gradient = C * (share - hit).T @ z
    assert np.allclose(gradient[b != 0], -np.sign(b[b != 0]), atol=2e-3)
    assert (np.abs(gradient[b == 0]) <= 1 + 2e-3).all() and 0 < np.count_nonzero(b) < b.size
