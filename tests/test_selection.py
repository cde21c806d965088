"""Selectors, tests and masks."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import special
from tidemark.operators import model_selection as trees
from tidemark.operators import selection as sel
from tidemark.operators.position import running_last

ID = "sequence_id"


def long(spark, matrix, names=None):
    names = names or [f"feature_{j}" for j in range(matrix.shape[1])]
    rows = [(i, n, float(v)) for i, row in enumerate(matrix) for n, v in zip(names, row)]
    return spark.createDataFrame(rows, "sequence_id long, feature string, value double").repartition(4)


def target(spark, values, kind="int"):
    convert = int if kind == "int" else float
    return spark.createDataFrame([(i, convert(v)) for i, v in enumerate(values)], f"sequence_id long, target {kind}")


@pytest.fixture(scope="module")
def gaussian(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(60, 15))
    classes = (x[:, 0] + x[:, 1] > 0).astype(int)
    real = 2.5 * x[:, 0] - 1.8 * x[:, 1] + rng.normal(size=60) * 0.1
    return x, long(spark, x).cache(), target(spark, classes).cache(), target(spark, real, "double").cache(), classes, real


def kept(mask):
    return {r.feature for r in mask.filter("selected").collect()}


@pytest.mark.parametrize("name", ["anova", "mi", "fdr", "extra_trees", "random_forest", "l1", "subsampled"])
def test_class_selectors_keep_the_signal(gaussian, name):
    _x, features, classes, _real, _c, _r = gaussian
    params = {"k": 5} if name in ("anova", "mi") else {}
    mask = sel.run_selector(name, features, classes, "classification", **params)
    assert "feature_0" in kept(mask)
    assert mask.count() == 15
    if params:
        assert len(kept(mask)) == 5


@pytest.mark.parametrize("name", ["select_k_best", "mutual_info", "tsfresh", "lasso", "rf_importance"])
def test_real_target_selectors_keep_the_signal(gaussian, name):
    _x, features, _classes, real, _c, _r = gaussian
    params = {"k": 5} if name in ("select_k_best", "mutual_info") else {}
    assert {"feature_0", "feature_1"} <= kept(sel.run_selector(name, features, real, "regression", **params))


def test_k_at_the_edges(gaussian):
    _x, features, classes, *_ = gaussian
    assert kept(sel.select_k_best(features, classes, 0)) == set()
    assert len(kept(sel.select_k_best(features, classes, 99))) == 15


def test_unknown_selector_raises(gaussian):
    with pytest.raises(KeyError):
        sel.run_selector("absent", gaussian[1], gaussian[2])


def test_constant_columns_leave_nothing_and_fall_back(spark):
    features, classes = long(spark, np.ones((20, 5))), target(spark, [i % 2 for i in range(20)])
    for name in ("variance", "fdr"):
        mask = sel.run_selector(name, features, classes)
        assert kept(mask) == set()
        used, info = sel.with_fallback(mask)
        assert len(kept(used)) == 5
        assert info["fallback_triggered"] and info["n_survived_features"] == 0 and info["feature_reduction_pct"] == 0.0
    assert kept(sel.drop_constant(features)) == set()


def test_boruta_accepts_signal_and_rejects_noise(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4))
    mask = trees.boruta(long(spark, x), target(spark, x[:, 0] > 0), n_estimators=20, max_iter=12)
    assert kept(mask) == {"feature_0"}


def test_subsample_sizes():
    assert sel.subsample_size(1000, 0.1, 50, None) == 100
    assert sel.subsample_size(1000, 0.01, 50, None) == 50
    assert sel.subsample_size(199, 0.1, 10, 9) == math.ceil(2 * 199 / 9)
    assert sel.subsample_size(30, 0.1, 50, None) == 30


def test_stratified_sample_keeps_the_minority(spark):
    rng = np.random.default_rng(2)
    y = [1] * 9 + [0] * 190
    features, classes = long(spark, rng.normal(size=(199, 10))), target(spark, y)
    selector = sel.SubsampledSelector("variance_threshold", 0.1, min_samples=20)
    drawn, size, n = selector.sample(classes)
    assert drawn.join(classes, ID).filter("target = 1").count() >= 1 and n == 199 and size < n
    fitted = selector.fit(features, classes)
    assert fitted.transform(features).count() == 199 * 10
    assert fitted.telemetry_["subsample_size"] == size


def test_subsampled_takes_functions_lists_and_objects(gaussian):
    _x, features, classes, *_ = gaussian

    class Fixed:
        def fit(self, features, targets):
            self.rows = targets.count()

        def get_support(self):
            return ["feature_3"]

    def by_name(features, targets, random_state):
        return ["feature_1", f"feature_{random_state}"]

    assert kept(sel.SubsampledSelector(Fixed(), 0.5).fit(features, classes).get_support()) == {"feature_3"}
    assert kept(sel.SubsampledSelector(by_name, 0.5, random_state=2).fit(features, classes).get_support()) == {"feature_1", "feature_2"}
    with pytest.raises(RuntimeError):
        sel.SubsampledSelector().get_support()


def test_sweep_has_a_row_per_ratio(gaussian):
    out = sel.subsampling_sweep(gaussian[1], gaussian[2], (0.5, 1.0), base_selector="variance_threshold", min_samples=10)
    rows = {r.sample_ratio: r for r in out.collect()}
    assert set(rows) == {0.5, 1.0} and rows[1.0].subsample_size == 60


def test_vector_target_is_averaged(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 6.0])], "sequence_id long, target array<double>")
    assert sel.collapse_horizons(df).first().target == 3.0


# --- p-values against definitions -------------------------------------------------------------------


def test_tails_against_published_values():
    assert math.isclose(float(special.t_two_sided(2.228, 10)), 0.05, abs_tol=2e-5)
    assert math.isclose(float(special.t_two_sided(12.706, 1)), 0.05, abs_tol=2e-5)
    assert math.isclose(float(special.f_upper(4.965, 1, 10)), 0.05, abs_tol=2e-5)
    assert math.isclose(float(special.f_upper(2.978, 10, 10)), 0.05, abs_tol=5e-5)
    assert math.isclose(float(special.kolmogorov_upper(np.array(1.358))), 0.05, abs_tol=2e-4)
    assert math.isclose(special.t_quantile_value(0.975, 9), 2.262157, abs_tol=1e-5)
    assert math.isclose(special.normal_quantile(0.95), 1.644854, abs_tol=1e-6)


def test_fisher_by_enumeration(spark):
    def exact(a, b, c, d):
        row, col, n = a + b, a + c, a + b + c + d
        p = [math.comb(row, k) * math.comb(n - row, col - k) / math.comb(n, col) for k in range(max(0, row + col - n), min(row, col) + 1)]
        here = p[a - max(0, row + col - n)]
        return sum(v for v in p if v <= here * (1 + 1e-7))

    tables = [(3, 1, 1, 3), (8, 2, 1, 5), (0, 10, 10, 0), (40, 60, 55, 45), (7, 0, 3, 2)]
    df = spark.createDataFrame(tables, "a int, b int, c int, d int")
    got = df.select(special.fisher_exact_p(*[F.col(c) for c in "abcd"]).alias("p")).collect()
    assert all(math.isclose(r.p, exact(*t), rel_tol=1e-8) for r, t in zip(got, tables))
    big = spark.createDataFrame([(500_000_000, 500_000_000, 500_010_000, 499_990_000)], "a long, b long, c long, d long")
    p = big.select(special.fisher_exact_p(*[F.col(c) for c in "abcd"]).alias("p")).first().p
    z = 10_000 / math.sqrt(1e9 / 2)
    assert math.isclose(p, math.erfc(z / math.sqrt(2)), rel_tol=1e-3)


def test_rank_sum_by_pairs(gaussian):
    x, features, classes, _real, c, _r = gaussian
    got = {(r.feature, r.label): r for r in sel.mann_whitney(features, classes).collect()}
    for j in (0, 7):
        a, b = x[c == 1, j], x[c == 0, j]
        u = sum((v > b).sum() + 0.5 * (v == b).sum() for v in a)
        spread = math.sqrt(len(a) * len(b) * (len(a) + len(b) + 1) / 12)
        z = (max(u, len(a) * len(b) - u) - len(a) * len(b) / 2 - 0.5) / spread
        row = got[(f"feature_{j}", 1)]
        assert row.u == u and math.isclose(row.p_value, min(1.0, math.erfc(z / math.sqrt(2))))


def test_kendall_by_pairs(spark):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 8, 50).astype(float), rng.integers(0, 6, 50).astype(float)
    got = sel.kendall(long(spark, x[:, None]), target(spark, y, "double")).first()
    dx, dy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    upper = np.triu_indices(50, 1)
    s = (dx * dy)[upper].sum()
    want = s / math.sqrt((dx[upper] != 0).sum() * (dy[upper] != 0).sum())
    assert math.isclose(got.tau, want)


def test_two_sample_distance_by_steps(spark):
    rng = np.random.default_rng(6)
    f, y = rng.integers(0, 2, 80).astype(float), np.round(rng.normal(size=80), 1)
    got = sel.smirnov(long(spark, f[:, None]), target(spark, y, "double")).first()
    a, b = y[f == 1], y[f == 0]
    want = max(abs((a <= v).mean() - (b <= v).mean()) for v in y)
    assert math.isclose(got.distance, want)


def test_anova_by_hand_and_by_fold(gaussian, spark):
    x, features, classes, _real, c, _r = gaussian
    def f_value(values, labels):
        groups = [values[labels == k] for k in np.unique(labels)]
        within = sum(((g - g.mean()) ** 2).sum() for g in groups)
        between = sum(len(g) * (g.mean() - values.mean()) ** 2 for g in groups)
        return between / (len(groups) - 1) / (within / (len(values) - len(groups)))

    got = {r.feature: r.score for r in sel.anova_scores(features, classes).collect()}
    assert all(math.isclose(got[f"feature_{j}"], f_value(x[:, j], c)) for j in range(15))
    folds = classes.select(ID, (F.col(ID) % 3).cast("int").alias("fold"))
    by_fold = {(r.feature, r.fold): r.score for r in sel.anova_scores_by_fold(features, classes, folds).collect()}
    train = np.arange(60) % 3 != 1
    assert math.isclose(by_fold[("feature_2", 1)], f_value(x[train, 2], c[train]), rel_tol=1e-9)


def test_step_up_by_hand(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, None, 0.041]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double")
    filled = [1.0 if v is None else v for v in p]
    order = np.argsort(filled, kind="stable")
    raw = np.array(filled)[order] * len(p) / np.arange(1, len(p) + 1)
    want = np.empty(len(p))
    want[order] = np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1])
    got = {r.i: r.p_adjusted for r in sel.adjust_p_values(df, "p").collect()}
    assert all(math.isclose(got[i], want[i]) for i in range(len(p)))
    harmonic = sum(1 / k for k in range(1, len(p) + 1))
    dependent = {r.i: r.p_adjusted for r in sel.adjust_p_values(df, "p", method="by").collect()}
    assert all(math.isclose(dependent[i], min(1, want[i] * harmonic), rel_tol=1e-10) for i in range(len(p)) if want[i] * harmonic < 1)


def test_false_discoveries_stay_rare(spark):
    """20 planted features among 180 noise ones: few false finds with the step-up, many without."""
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 250)
    x = rng.normal(size=(250, 200))
    x[:, :20] += y[:, None] * 0.8
    features, classes = long(spark, x), target(spark, y)
    planted = {f"feature_{j}" for j in range(20)}
    strict, loose = kept(sel.fdr_selector(features, classes)), kept(sel.uncorrected_anova(features, classes))
    assert len(strict & planted) >= 15 and len(strict - planted) <= 2
    assert len(loose - planted) > len(strict - planted)


def test_assembled_vectors_fill_missing_cells(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (1, "a", 1.0), (2, "c", 3.0)], "sequence_id long, feature string, value double")
    got = {r.sequence_id: list(r.features) for r in trees.assemble(df, ["a", "b", "c"]).collect()}
    assert got == {1: [1.0, 2.0, 0.0], 2: [0.0, 0.0, 3.0]}


def test_binomial_tail_by_counting():
    for n in (1, 7, 20):
        for k in range(0, n + 2):
            want = sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n
            assert math.isclose(float(special.binomial_upper(np.array(float(k)), float(n))), want, abs_tol=1e-14)


def frames_to_the_end(df):
    """Frames from the current row to the end of its group: Spark evaluates those anew for every row."""
    plan = df._jdf.queryExecution().toString().lower()
    return plan.count("currentrow$(), unboundedfollowing$()") + plan.count("1, unboundedfollowing$()")


def test_adjusted_p_values_take_one_pass(spark, small_tasks):
    rows = [(i, i % 2, (i * 7 % 11 + 1) / 40) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, g int, p double")
    long = sel.adjust_p_values(df, "p", keys=["g"])
    spark.conf.unset("spark.tidemark.maxGroupRows")
    short = sel.adjust_p_values(df, "p", keys=["g"])
    assert frames_to_the_end(short) == frames_to_the_end(long) == 0

    def found(out):
        return {r.id: round(r.p_adjusted, 12) for r in out.collect()}

    want = {}
    for g in (0, 1):
        own = [(i, p) for i, k, p in rows if k == g]
        raw = {p: p * len(own) / sum(q <= p for _, q in own) for _, p in own}
        want |= {i: round(min(1.0, *(v for q, v in raw.items() if q >= p), 1.0), 12) for i, p in own}
    assert found(short) == found(long) == want


def test_fills_take_one_pass(spark):
    rows = [(0, None), (1, None), (2, 5.0), (3, None), (4, 7.0), (5, None)]
    df = spark.createDataFrame(rows, "t int, v double")
    out = running_last(df, [], ["t"], {"f": "v"})
    assert frames_to_the_end(out) == 0
    assert [r.f for r in out.orderBy("t").collect()] == [5.0, 5.0, 5.0, 5.0, 7.0, 7.0]


def test_long_fills_keep_columns_with_dots(spark, small_tasks):
    rows = [(i, None if i < 9 or i % 4 else float(i), i) for i in range(80)]
    df = spark.createDataFrame(rows, "t int, v double, `pm2.5` int")
    out = running_last(df, [], ["t"], {"f": "v"}).orderBy("t").collect()
    assert [r.f for r in out] == [float(max(12, i - i % 4)) for i in range(80)] and [r["pm2.5"] for r in out] == list(range(80))


def test_student_quantiles_of_many_groups():
    start = time.perf_counter()
    found = special.t_quantile_values(0.975, np.arange(1.0, 1001.0))
    assert time.perf_counter() - start < 20
    assert np.allclose(found[[0, 8, 999]], [12.706205, 2.262157, 1.962339], atol=1e-5) and (np.diff(found) < 0).all()
