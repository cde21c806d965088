"""The paths for groups that no task may hold give what the simple paths give."""

import math

import numpy as np
import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tidemark.operators import compare, position, selection
from tidemark.operators.position import with_position
from tidemark.operators.features import basic, compact, drift, efficient, long_sequences, signal
from tidemark.operators.features.rows import sequence_rows

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()
SPLIT_QUERIES = (
    "sliding_windows",
    "windows_across_groups",
    "horizon_windows",
    "forecasting_targets",
    "rolling_windows_forward",
    "rolling_windows_backward",
    "minimal_set",
    "base_statistics",
    "lag_correlations",
    "compact_statistics",
    "compact_fourier",
    "fill_forward_backward",
    "row_index_as_time",
    "quartiles",
    "rank_sum_test",
    "two_sample_distance",
    "kendall_tau",
    "purged_blocked_folds",
    "expanding_time_splits",
    "stratified_time_blocks",
    "persistence_baseline",
    "area_under_curve",
    "signal_statistical_domain",
    "signal_temporal_domain",
    "ingest_machine_log",
    "ingest_sparse_batches",
)


@pytest.mark.parametrize("name", SPLIT_QUERIES)
def test_query_with_split_groups(spark, small_tasks, name):
    assert differences(connect(SF), QUERIES[name](spark, SF), ORACLES[name]) == []


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s, n in ((1, 700), (2, 1100), (3, 30)):
        x = np.round(np.cumsum(rng.normal(size=n)) * 0.3 + rng.normal(size=n), 2)
        rows += [(s, i, float(v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "sequence_id long, step int, v double").repartition(5).cache()


SETS = {
    "statistical": lambda df: signal.statistical_domain(df, channels=["v"]),
    "temporal": lambda df: signal.temporal_domain(df, channels=["v"]),
    "mixed": lambda df: signal.mixed_set(df, channels=["v"]),
    "drift": lambda df: drift.drift_features(df, channels=["v"]),
    "compact": lambda df: compact.compact_features(df, channels=["v"], n_fft_coeffs=5),
    "lags": lambda df: basic.lag_correlations(df, channels=["v"]),
    "wide": lambda df: efficient.efficient_features(
        df, channels=["v"], fft_coefficients=20, comprehensive=True, query=[1.0, 2.0, 1.0, 0.5], threshold=1.0
    ),
}


def by_id(df):
    return {r["sequence_id"]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("name", SETS)
def test_feature_set_of_long_sequences(spark, series, name):
    whole = by_id(SETS[name](series))
    try:
        spark.conf.set("spark.tidemark.maxGroupRows", "1000")
        spark.conf.set("spark.tidemark.blockRows", "256")
        split = by_id(SETS[name](series))
    finally:
        spark.conf.unset("spark.tidemark.maxGroupRows")
        spark.conf.unset("spark.tidemark.blockRows")
    assert whole.keys() == split.keys()
    for s, row in whole.items():
        assert row.keys() == split[s].keys()
        for feature, want in row.items():
            got = split[s][feature]
            if isinstance(want, float) and want == want:
                assert math.isclose(got, want, rel_tol=1e-7, abs_tol=1e-7), (s, feature)


def test_slow_decay_needs_several_rounds(spark, small_tasks):
    n = 3000
    rows = [(1, i, float(i)) for i in range(n)] + [(2, i, float((-1) ** i)) for i in range(n)]
    df = spark.createDataFrame(rows, "sequence_id long, step int, v double")
    rows = sequence_rows(df, channels=["v"]).with_stats({"mu": F.avg("x")})
    got = {r["sequence_id"]: r["lag"] for r in long_sequences.decay_lag_table(rows).collect()}
    x = np.arange(n) - (n - 1) / 2
    acf = np.correlate(x, x, "full")[n - 1 :]
    assert got == {1: float(np.flatnonzero(acf <= acf[0] / math.e)[0]), 2: 1.0}


def test_positions_with_many_ties_and_one_hot_group(spark, small_tasks):
    rows = [(0 if i % 3 else i % 7 + 1, i // 50, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, t int, k int").repartition(6)
    got = {(r.g, r.k): (r.p, r.n) for r in position.with_position(df, ["g"], ["t", "k"], "p", "n").collect()}
    seen: dict = {}
    for g, _t, k in rows:
        seen.setdefault(g, []).append(k)
    assert got == {(g, k): (i, len(ks)) for g, ks in seen.items() for i, k in enumerate(ks)}


def test_neighbour_information_with_split_groups(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(size=400)
    features = spark.createDataFrame([(i, "f", float(v)) for i, v in enumerate(values)], "sequence_id long, feature string, value double")
    targets = spark.createDataFrame([(i, int(v > 0.2)) for i, v in enumerate(values)], "sequence_id long, target int")
    whole = selection.neighbour_mutual_information(features, targets).first()["score"]
    try:
        spark.conf.set("spark.tidemark.maxGroupRows", "50")
        spark.conf.set("spark.tidemark.blockRows", "256")
        split = selection.neighbour_mutual_information(features, targets).first()["score"]
    finally:
        spark.conf.unset("spark.tidemark.maxGroupRows")
        spark.conf.unset("spark.tidemark.blockRows")
    assert math.isclose(whole, split, rel_tol=1e-9)
    # The class is a function of the value, so its entropy is the limit.
    p = float((values > 0.2).mean())
    assert abs(whole + p * math.log(p) + (1 - p) * math.log(1 - p)) < 0.05


def test_persistence_over_a_split_series(spark, small_tasks):
    df = spark.createDataFrame([(1, i, float(i * i)) for i in range(200)], "s int, t int, y double")
    got = {r.t: r.prediction for r in compare.persistence_baseline(df, ["s"], ["t"], "y", -1.0).collect()}
    assert got == {0: -1.0} | {i: float((i - 1) ** 2) for i in range(1, 200)}


def test_step_up_over_many_tests(spark):
    rng = np.random.default_rng(1)
    p = np.round(rng.uniform(size=300) ** 2, 3)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "i int, p double").repartition(4)
    for method in ("bh", "by"):
        whole = {r.i: r.p_adjusted for r in selection.adjust_p_values(df, "p", method=method).collect()}
        try:
            spark.conf.set("spark.tidemark.maxGroupRows", "20")
            split = {r.i: r.p_adjusted for r in selection.adjust_p_values(df, "p", method=method).collect()}
        finally:
            spark.conf.unset("spark.tidemark.maxGroupRows")
        assert whole.keys() == split.keys() and all(math.isclose(whole[i], split[i]) for i in whole)


def test_text_and_boolean_order_on_both_paths(spark, small_tasks):
    names = [f"a common beginning longer than any chunk {i % 37:03d}" if i % 2 else f"{i % 11}é" for i in range(300)]
    rows = spark.createDataFrame([(n, i % 3 == 0, i) for i, n in enumerate(names)], "name string, flag boolean, i long")
    for order in (["name", "i"], ["flag", "name", "i"]):
        whole = sorted(rows.collect(), key=lambda r: tuple(r[c].encode() if c == "name" else r[c] for c in order))
        found = {r.i: r.position for r in position.with_position(rows, [], order).collect()}
        assert found == {r.i: p for p, r in enumerate(whole)}


def test_fourier_sums_of_blocks_hold_few_waves(spark):
    import numpy as np

    from tidemark.functions.fourier import fourier_sums

    x = np.random.default_rng(3).normal(size=150_000)
    cut = 65_536
    rows = [(a, x[a : a + cut].tolist()) for a in range(0, len(x), cut)]
    df = spark.createDataFrame(rows, "start long, xs array<double>").withColumn("n", F.lit(len(x)).cast("long"))
    parts = np.array([r[0] for r in df.select(fourier_sums(F.col("xs"), F.col("start"), F.col("n"), 100)).collect()])
    want = np.fft.rfft(x)[:100]
    assert np.allclose(parts.sum(0)[::2], want.real) and np.allclose(parts.sum(0)[1::2], want.imag)


def test_steps_on_top_of_each_other_read_the_input_once(spark, small_tasks, tmp_path):
    spark.range(60).select("id", (F.col("id") * 7 % 60).alias("o")).write.parquet(str(tmp_path / "t"))
    out = spark.read.parquet(str(tmp_path / "t"))
    for i in range(3):
        out = with_position(out, [], ["o"], f"p{i}")
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2
    assert all(r.p0 == r.p1 == r.p2 == r.o for r in out.collect())
