import numpy as np
import pytest

from tidemark.operators import inversions
from tidemark.operators import selection as sel


def by_pairs(x, y, c):
    return float((np.outer(c, c) * ((x[:, None] < x) & (y[:, None] > y))).sum())


def test_weighted_inversions():
    rng = np.random.default_rng(2)
    for n in (1, 2, 65, 300):
        y, c = rng.integers(0, 40, n), rng.integers(1, 9, n)
        assert inversions.weighted_inversions(y, c) == by_pairs(np.arange(n), y, c)


@pytest.mark.parametrize("limited", [False, True])
def test_pairs_of_two_groups(spark, request, limited):
    if limited:
        request.getfixturevalue("small_tasks")
        spark.conf.set("spark.tidemark.blockRows", "16")
    rng = np.random.default_rng(3)
    rows, expected = [], {}
    for g, wide in (("a", 1000), ("b", 6)):
        x, y = (rng.integers(0, wide, 300) for _ in range(2))
        pairs, c = np.unique(np.stack((x, y), 1), axis=0, return_counts=True)
        rows += [(g, float(v), float(w), int(k)) for (v, w), k in zip(pairs, c)]
        expected[g] = by_pairs(pairs[:, 0], pairs[:, 1], c)
    table = spark.createDataFrame(rows, "g string, x double, y double, c long")
    got = inversions.inverted_pairs(table, ["g"], "x", "y", "c")
    assert {r["g"]: r["pairs"] for r in got.collect()} == expected


def test_kendall_unfolds_no_levels(spark, small_tasks, monkeypatch):
    monkeypatch.setattr(sel, "_merge_levels", lambda _: pytest.fail("a row for each level of a merge sort"))
    x = np.random.default_rng(4).normal(size=(2, 200))
    features = spark.createDataFrame([(i, "a", float(v)) for i, v in enumerate(x[0])], "sequence_id long, feature string, value double")
    targets = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x[1])], "sequence_id long, target double")
    signs = np.sign(x[0][:, None] - x[0]) * np.sign(x[1][:, None] - x[1])
    assert np.isclose(sel.kendall(features, targets).first()["tau"], signs.sum() / (200 * 199))
