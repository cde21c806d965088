"""Extremely randomised trees: every node's sums and cut are those of its rows."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from tidemark.operators import random_trees as rt


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(160, 6)), 2)
    x[:, 5] = 1.0
    return x, (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int) + (x[:, 2] > 1), x[:, 0] * 3 + np.abs(x[:, 3])


def frame(spark, x, y, kind):
    rows = spark.createDataFrame([(v.tolist(), t) for v, t in zip(x, y)], f"x array<double>, label {kind}").repartition(3)
    return rows.select(array_to_vector("x").alias("features"), "label")


def check(tree, x, sums, min_rows):
    """Walk the tree with all rows."""
    places = {0: np.arange(len(x))}
    for node in range(len(tree.feature)):
        own = places[node]
        assert np.allclose(tree.sums[node], sums[own].sum(0)) and len(own) >= min_rows
        if tree.feature[node] >= 0:
            value = x[own, tree.feature[node]]
            assert value.min() <= tree.cut[node] < value.max()
            places[tree.child[node]], places[tree.child[node] + 1] = own[value <= tree.cut[node]], own[value > tree.cut[node]]


@pytest.mark.parametrize("cells", [1 << 20, 200])
def test_classes(spark, values, cells):
    x, y, _ = values
    forest = rt.fit_extra_trees(frame(spark, x, [float(v) for v in y], "double"), 3, trees=3, depth=None if cells > 200 else 2, cells=cells)
    for tree in forest.trees:
        check(tree, x, np.eye(3)[y], 1)
    assert forest.importances[5] == 0 and np.isclose(forest.importances.sum(), 1)
    if cells > 200:
        assert forest.importances.argmax() == 0
        assert (forest.predict(x).argmax(1) == y).all()  # grown until the rows of a leaf are alike
        again = rt.fit_extra_trees(frame(spark, x, [float(v) for v in y], "double").repartition(5), 3, trees=3)
        assert [t.feature for t in again.trees] == [t.feature for t in forest.trees]


def test_several_horizons_in_one_tree(spark, values):
    x, _, z = values
    y = np.column_stack((z, -2 * z, x[:, 1]))
    forest = rt.fit_extra_trees(frame(spark, x, y.tolist(), "array<double>"), trees=3, min_rows=4, depth=6)
    for tree in forest.trees:
        check(tree, x, np.concatenate((np.ones((len(x), 1)), y, y * y), axis=1), 4)
    error = ((forest.predict(x) - y) ** 2).mean(0)
    assert forest.predict(x).shape == y.shape and (error < 0.5 * y.var(0)).all()


def test_one_class_and_one_row(spark, values):
    x, _, z = values
    assert not rt.fit_extra_trees(frame(spark, x, [0.0] * len(x), "double"), 2, trees=2).importances.any()
    single = rt.fit_extra_trees(frame(spark, x[:1], [3.5], "double"), trees=2)
    assert single.predict(x[:2]).tolist() == [[3.5], [3.5]]
