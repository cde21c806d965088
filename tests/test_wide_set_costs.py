"""What the wide sets do for a sequence stays bounded by its different templates and its rows, with the same results."""

import numpy as np
import pytest

from tidemark.functions import matches
from tidemark.operators.features import efficient, rows


def test_repeated_templates_are_compared_once(monkeypatch):
    asked = []
    within = matches._Stretches.within
    monkeypatch.setattr(matches._Stretches, "within", lambda s, own, radius: asked.append(len(own)) or within(s, own, radius))
    x = np.tile(np.random.default_rng(2).integers(0, 500, 60) / 10, 100)
    two, three = matches.template_counts(x, [3.0])[0]
    assert sum(asked) <= 3 * 62
    for m, got in ((2, two), (3, three)):
        parts = np.lib.stride_tricks.sliding_window_view(x, 3)[:, :m]
        assert got.tolist() == [(np.abs(parts - p).max(axis=1) <= 3.0).sum() for p in parts]


def test_tiles_far_apart_are_left_out(monkeypatch):
    monkeypatch.setattr(matches, "TILE", 16)
    x = np.random.default_rng(3).normal(size=300)
    found = matches.template_counts(x, [0.05, 0.4, 9.0])
    parts = np.lib.stride_tricks.sliding_window_view(x, 3)
    for radius, (two, three) in zip((0.05, 0.4, 9.0), found):
        for m, got in ((2, two), (3, three)):
            assert got.tolist() == [(np.abs(parts[:, :m] - p[:m]).max(axis=1) <= radius).sum() for p in parts]


@pytest.mark.parametrize("task_rows", [rows.TASK_ROWS, 10])
def test_tasks_follow_the_rows(spark, monkeypatch, task_rows):
    monkeypatch.setattr(rows, "TASK_ROWS", task_rows)
    data = [(s, t, float((7 * s + t * t) % 11)) for s in range(12) for t in range(20)]
    df = spark.createDataFrame(data, "sequence_id long, step int, v double")
    made = rows.sequence_rows(df, "sequence_id", ["step"], ["v"])
    assert made.df.rdd.getNumPartitions() == max(8, len(data) // task_rows + (len(data) % task_rows > 0))
    got = {r["sequence_id"]: r for r in efficient.efficient_features(df, "sequence_id", ["step"], ["v"], 1).collect()}
    assert len(got) == 12
    for s, row in got.items():
        x = np.array([v for i, _t, v in data if i == s])
        assert row["number_peaks__n_1"] == ((x[1:-1] > x[:-2]) & (x[1:-1] > x[2:])).sum()
        a, b = np.quantile(x, [0.2, 0.8])
        both = (x >= a) & (x <= b)
        steps = np.abs(np.diff(x))[both[1:] & both[:-1]]
        assert np.isclose(row['change_quantiles__f_agg_"mean"__isabs_True__qh_0.8__ql_0.2'], steps.mean() if len(steps) else 0)
        assert np.isclose(row['change_quantiles__f_agg_"var"__isabs_True__qh_0.8__ql_0.2'], steps.var() if len(steps) else 0)
