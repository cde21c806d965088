"""Paired tests, ranks, stability and the tables behind the reports."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregate, compare, models
from tidemark.functions import expr


@pytest.fixture(scope="module")
def results(spark):
    rng = np.random.default_rng(8)
    rows = []
    for seed, fold, ext, select, model in itertools.product((1, 2), (0, 1), ("fast", "slow"), ("none", "fdr"), ("forest", "linear")):
        rows.append(("d", "classification", seed, fold, ext, select, model, 0.7 + 0.1 * (ext == "slow") + float(rng.normal()) * 0.01))
    schema = "Dataset string, Task string, Seed int, Fold int, Extractor string, Selector string, Model string, Accuracy double"
    return spark.createDataFrame(rows, schema).cache()


def test_pairs_are_matched_not_multiplied(results):
    test = compare.pairwise_tests(results, "Extractor", "Accuracy").collect()
    assert len(test) == 1 and test[0].n_pairs == 16
    assert (test[0].group_1, test[0].group_2, test[0].winner, test[0].final_winner) == ("fast", "slow", "slow", "slow")


def test_combinations_pair_across_the_rest(results):
    rows = results.withColumn("Combination", F.concat_ws(" + ", "Extractor", "Selector")).filter("Fold = 0")
    tests = compare.pairwise_tests(rows, "Combination", "Accuracy").collect()
    assert len(tests) == 6 and {t.n_pairs for t in tests} == {4}


def test_paired_t_by_hand(results):
    wide: dict = {}
    for r in results.collect():
        wide.setdefault((r.Seed, r.Fold, r.Selector, r.Model), {})[r.Extractor] = r.Accuracy
    d = np.array([v["fast"] - v["slow"] for v in wide.values()])
    got = compare.pairwise_tests(results, "Extractor", "Accuracy").first()
    assert math.isclose(got.cohens_d, d.mean() / d.std(ddof=1))
    assert math.isclose(got.t_statistic, d.mean() / d.std(ddof=1) * 4)


def test_lower_is_better_and_no_winner(spark):
    rows = [(s, m, 5.0 + (m == "b") * (0.1 if s % 2 else -0.1) + s) for s in range(6) for m in ("a", "b")]
    df = spark.createDataFrame(rows, "Seed int, Model string, RMSE double")
    got = compare.pairwise_tests(df, "Model", "RMSE").first()
    assert got.final_winner == compare.NO_WINNER and compare.metric_direction("RMSE") == "lower"


def test_cached_rows_do_not_count_for_times(spark):
    rows = [(s, m, 1.0 + s + (m == "b"), s == 0) for s in range(4) for m in ("a", "b")]
    df = spark.createDataFrame(rows, "`Seed` int, `Extractor` string, `Extraction Time (s)` double, is_cached boolean")
    assert compare.pairwise_tests(df, "Extractor", "Extraction Time (s)").first().n_pairs == 3


def test_ranks_over_common_datasets(spark):
    rows = [("d1", "a", 0.9), ("d1", "b", 0.8), ("d2", "a", 0.7), ("d2", "b", 0.7), ("d3", "a", 0.5), ("d3", "b", 0.6), ("d4", "a", 0.1)]
    df = spark.createDataFrame(rows, "Dataset string, Extractor string, Accuracy double")
    got = {r.Extractor: (r.avg_rank, r.n_datasets) for r in compare.average_ranks(df, "Accuracy", "Extractor", "Dataset").collect()}
    assert got == {"a": (1.5, 3), "b": (1.5, 3)}
    apart = spark.createDataFrame([("d1", "a", 0.9), ("d2", "b", 0.8)], "Dataset string, Extractor string, Accuracy double")
    assert compare.average_ranks(apart, "Accuracy", "Extractor", "Dataset").isEmpty()


def test_signed_rank_p_by_enumeration(spark):
    d = [0.3, -0.1, 0.5, 0.7, 0.9, 1.2, -0.2]
    rows = [(f"d{i}", m, (m == "b") * v) for i, v in enumerate(d) for m in ("a", "b")]
    df = spark.createDataFrame(rows, "Dataset string, Model string, Accuracy double")
    got = compare.rank_significance(df, "Accuracy", "Model", "Dataset").first()
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    w = min(ranks[np.array(d) > 0].sum(), ranks[np.array(d) < 0].sum())
    sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product((0, 1), repeat=7)]
    assert math.isclose(got.p_value, min(1, 2 * np.mean(np.array(sums) <= w)))


def test_cliques_are_maximal(spark):
    ranks = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", 4.0)], "m string, avg_rank double")
    tests = spark.createDataFrame([("a", "c", True), ("a", "d", True), ("b", "d", False)], "group_1 string, group_2 string, significant boolean")
    assert compare.rank_cliques(ranks, tests, "m") == [["a", "b"], ["b", "c", "d"]]


def test_stability(spark):
    picks = {0: {"a", "b"}, 1: {"a", "b", "c"}, 2: {"d"}}
    df = spark.createDataFrame([(f, n) for f, ns in picks.items() for n in ns], "fold int, feature string")
    assert math.isclose(compare.selection_stability(df).first().jaccard, (2 / 3) / 3)


def test_truth_match(spark):
    names = lambda *ns: spark.createDataFrame([(n,) for n in ns], "feature string")
    picked = spark.createDataFrame([(1, "t1"), (1, "n1"), (2, "t1"), (2, "t2")], "run int, feature string")
    got = {r.run: r for r in compare.truth_match(picked, names("t1", "t2"), names("t1", "t2", "n1", "n2"), ["run"]).collect()}
    assert (got[1].tp, got[1].fp, got[1].fn, got[1].fdp, got[1].power) == (1, 1, 1, 0.5, 0.5)
    assert (got[2].fdp, got[2].power) == (0.0, 1.0)


def test_horizon_columns_prefer_fewer_nulls(spark):
    df = spark.createDataFrame([("a", 1.0, None, 3.0), ("a", 2.0, 5.0, 4.0)], "Model string, `RMSE H1` double, `RMSE_H1` double, RMSE_H2 double")
    got = {(r.metric, r.horizon): r.mean for r in compare.horizon_profile(df, "Model", ["RMSE"]).collect()}
    assert got == {("RMSE", 1): 1.5, ("RMSE", 2): 3.5}


def test_forecast_metrics_by_hand(spark):
    rows = [(0, 1, 1.0, 1.5), (0, 2, 2.0, 2.5), (1, 1, 2.0, 1.0), (1, 2, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "sequence_id int, horizon int, truth double, prediction double")
    df = df.withColumns({"lower": F.col("prediction") - 1, "upper": F.col("prediction") + 1})
    got = {r.horizon: r for r in models.forecast_metrics(df, True).collect()}
    assert math.isclose(got[1].rmse, math.sqrt(0.625)) and got[1].mae == 0.75
    assert got[1].coverage == 1 and got[1].width == 2


def test_mean_interval_and_single_rows(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", 5.0)], "g string, v double")
    got = {r.g: r for r in aggregate.mean_interval(df, ["g"], "v").collect()}
    half = 3.182446 * np.std([1, 2, 3, 4], ddof=1) / 2
    assert math.isclose(got["a"].upper, 2.5 + half, abs_tol=1e-5)
    assert (got["b"].lower, got["b"].upper) == (5.0, 5.0)


def test_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(50)], "a int, b double")
    same = aggregate.table_fingerprint(df.orderBy(F.desc("a")).repartition(7)).first()
    assert same == aggregate.table_fingerprint(df).first()
    assert same != aggregate.table_fingerprint(df.withColumn("b", F.col("b") + (F.col("a") == 3).cast("int"))).first()


def test_natural_order_and_lenient_arrays(spark):
    assert expr.natural_order(["t_10", "t_2", "t_1"]) == ["t_1", "t_2", "t_10"]
    df = spark.createDataFrame([("[1.5, 2 x 3]",), ("(4 5)",), ("",)], "s string")
    assert [r.a for r in df.select(expr.decode_array("s").alias("a")).collect()] == [[1.5, 2.0, None, 3.0], [4.0, 5.0], []]


def test_repeated_measurements_need_an_order(table):
    rows = [("a", 1, 5.0, 1), ("a", 1, 3.0, 2), ("b", 1, 4.0, 1)]
    df = table(rows, "m string, seed int, v double, t int")
    pair = compare.paired_rows(df, "m", "v", ["seed"], ["t"]).first()
    assert (pair.x, pair.y) == (3.0, 4.0)
    with pytest.raises(Exception, match="state the order"):
        compare.paired_rows(df, "m", "v", ["seed"]).collect()
