"""Count windows, forecasting windows and roll-outs."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import windowing as W
from tidemark.operators.features.extractors import extract
from tidemark.operators.reshape import history_and_horizon, require_equal_lengths, sequence_arrays

MODEST = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def series(spark, n, groups=1, label=lambda i: i % 3):
    rows = [(g, i, float(i), float(-i), label(i)) for g in range(1, groups + 1) for i in range(n)]
    return spark.createDataFrame(rows, "subject_id int, time int, sensor1 double, sensor2 double, label int").repartition(4)


def test_sliding_window_counts(spark):
    seq, tgt = W.segment_time_series(series(spark, 1000), 200, 50, "time", ["sensor1", "sensor2"], "label")
    assert tgt.count() == (1000 - 200) // 50 + 1 == 17
    assert seq.count() == 17 * 200
    assert seq.columns == ["sequence_id", "step", "sensor1", "sensor2"]
    assert {r.target for r in tgt.collect()} <= {0, 1, 2}


def test_default_stride_is_the_window(spark):
    assert W.segment_time_series(series(spark, 1000), 200, label_col="label", feature_cols=["sensor1"])[1].count() == 5


def test_mean_label_keeps_fractions(spark):
    df = series(spark, 500).withColumn("energy", F.col("time") * 0.25)
    tgt = W.segment_time_series(df, 100, 100, "time", ["sensor1"], "energy", "mean")[1]
    assert sorted(r.target for r in tgt.collect()) == [12.375 + 25 * k for k in range(5)]


def test_majority_tie_takes_the_smallest(spark):
    df = series(spark, 40, label=lambda i: 5 if i % 2 else 2)
    tgt = W.segment_time_series(df, 20, None, "time", ["sensor1"], "label", "majority_vote")[1]
    assert {r.target for r in tgt.collect()} == {2}


def test_windows_stay_inside_their_group(spark):
    seq, tgt = W.segment_time_series(series(spark, 150, 3), 100, 25, "time", ["sensor1"], "label", "last", "subject_id")
    assert [(r.sequence_id, r.group) for r in tgt.orderBy("sequence_id").collect()] == [
        (g * 3 + k, g + 1) for g in range(3) for k in range(3)
    ]
    spans = seq.groupBy("sequence_id").agg((F.max("sensor1") - F.min("sensor1")).alias("d")).collect()
    assert {r.d for r in spans} == {99.0}


def test_windows_across_groups_take_the_last_group(spark):
    df = spark.createDataFrame([(i // 100 + 1, i, float(i), 0) for i in range(400)], "subject_id int, time int, x double, label int")
    tgt = W.segment_time_series(df, 100, 100, "time", ["x"], "label", "last", "subject_id", cross_group=True)[1]
    assert [r.group for r in tgt.orderBy("sequence_id").collect()] == [1, 2, 3, 4]


def test_horizon_mode(spark):
    df = series(spark, 300)
    seq, tgt = W.segment_time_series(df, 50, 25, "time", ["sensor1"], "sensor1", forecast_horizon=6)
    rows = tgt.orderBy("sequence_id").collect()
    assert len(rows) == (300 - 50 - 6) // 25 + 1 == 10
    assert rows[2].target == [float(2 * 25 + 50 + h) for h in range(6)]
    assert rows[2].target_5 == rows[2].target[5]


@pytest.mark.parametrize("bad", [{"window_size": 0}, {"stride": 0}, {"window_size": 81}, {"forecast_horizon": -1}])
def test_bad_windows_raise(spark, bad):
    args = {"window_size": 20, "stride": 5} | bad
    with pytest.raises(ValueError):
        W.segment_time_series(series(spark, 80), time_col="time", label_col="label", **args)


def test_bad_forecasts_raise(spark):
    df = series(spark, 50)
    for bad in ({"test_size": 1.5}, {"history_len": 0}, {"forecast_horizon": -1}, {"stride": 0}, {"history_len": 60}):
        args = {"history_len": 20, "forecast_horizon": 5} | bad
        with pytest.raises(ValueError):
            W.segment_forecasting_series(df, time_col="time", feature_cols=["sensor1"], group_col="subject_id", **args)


@MODEST
@given(n=st.integers(30, 120), w=st.integers(3, 20), h=st.integers(1, 8), s=st.integers(1, 6), share=st.floats(0.2, 0.45))
def test_forecasts_are_causal(spark, n, w, h, s, share):
    cut = int(n * (1 - share))
    if cut < w + h or n - cut < h:
        return
    rows = [(1, i, float(i)) for i in range(n)]
    df = spark.createDataFrame(rows, "series_id int, time int, value double")
    seq, tgt = W.segment_forecasting_series(df, w, h, s, "time", ["value"], "value", "series_id", share)
    ends = tgt.groupBy("split").agg(F.max(F.array_max("target")).alias("hi"), F.min(F.array_min("target")).alias("lo"))
    found = {r.split: r for r in ends.collect()}
    assert found["train"].hi < cut <= found["test"].lo
    # The first target follows the last step of its history.
    last = seq.filter(F.col("step") == w - 1).join(tgt, "sequence_id").select((F.col("target_0") - F.col("value")).alias("d"))
    assert {r.d for r in last.distinct().collect()} == {1.0}
    first = max(0, cut - w)
    assert tgt.count() == (cut - w - h) // s + 1 + (n - w - h - first) // s + 1


@MODEST
@given(n=st.integers(1, 60), w=st.integers(1, 15), s=st.integers(1, 20))
def test_window_count_formula(spark, n, w, s):
    df = spark.createDataFrame([(i, float(i)) for i in range(n)], "time int, v double")
    if n < w:
        with pytest.raises(ValueError):
            W.segment_time_series(df, w, s, "time", ["v"])
        return
    seq = W.segment_time_series(df, w, s, "time", ["v"])[0]
    got = sorted((r.sequence_id, r.step, r.v) for r in seq.collect())
    assert got == [(k, j, float(k * s + j)) for k in range((n - w) // s + 1) for j in range(w)]


def test_forecast_arrays_of_two_series(spark):
    rows = [(g, i, float(i), float(g), float(i + g)) for g in (1, 2) for i in range(75)]
    df = spark.createDataFrame(rows, "series_id int, time int, feat_1 double, feat_2 double, target double")
    seq, tgt = W.segment_forecasting_series(df, 25, 8, 2, "time", ["feat_1", "feat_2"], "target", "series_id")
    both = history_and_horizon(seq, tgt)
    assert require_equal_lengths(sequence_arrays(seq)) == 25
    assert {(len(r.feat_1), len(r.feat_2), len(r.target)) for r in both.collect()} == {(25, 25, 8)}
    assert both.count() == 2 * ((75 - 33) // 2 + 1)
    with pytest.raises(ValueError):
        history_and_horizon(seq, tgt.filter("sequence_id > 0"))


def test_string_series_keys_and_short_series(spark):
    rows = [(s, i, float(i)) for s, n in (("anna", 50), ("ben", 50), ("short", 10)) for i in range(n)]
    df = spark.createDataFrame(rows, "subject string, time int, reading double")
    tgt = W.segment_forecasting_series(df, 20, 5, 5, "time", ["reading"], "reading", "subject")[1]
    assert {r.series_id for r in tgt.collect()} == {"anna", "ben"}


def test_roll_out_both_ways(spark):
    rows = [(g, t, float(v)) for g, vs in ((1, (10, 20, 30)), (2, (40, 50, 60))) for t, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "id int, time int, val double")
    def windows(direction, least=0):
        out: dict = {}
        for r in W.roll_time_series(df, "id", "time", 2, least, direction).orderBy("id", "shift", "step").collect():
            out.setdefault((r.id, r.shift), []).append(r.val)
        return out

    assert windows(1)[(1, 2)] == [10, 20, 30] and windows(1)[(1, 0)] == [10]
    assert windows(-1)[(2, 0)] == [40, 50, 60] and windows(-1)[(2, 2)] == [60]
    assert set(windows(1, 1)) == {(g, t) for g in (1, 2) for t in (1, 2)}
    assert set(windows(-1, 1)) == {(g, t) for g in (1, 2) for t in (0, 1)}


def test_windows_feed_extractors(spark):
    seq, _ = W.segment_time_series(series(spark, 100), 20, 10, "time", ["sensor1"], "label")
    long = extract(seq, "statistics_sample")
    first = {r.feature: r.value for r in long.filter("sequence_id = 0").collect()}
    assert first["sensor1__mean"] == 9.5 and first["sensor1__max"] == 19.0
