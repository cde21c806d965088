"""Feature store, stored pairs and the experiment matrix."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregate
from tidemark.plans import matrix as M
from tidemark.sources import store as S
from tidemark.sources import tables


def features(spark, n=30, d=20):
    rng = np.random.default_rng(0)
    rows = [(i, f"f_{j}", float(v)) for i in range(n) for j, v in enumerate(rng.normal(size=d))]
    return spark.createDataFrame(rows, "sequence_id long, feature string, value double")


@pytest.fixture
def store(spark, tmp_path):
    return S.FeatureStore(spark, str(tmp_path / "store"))


def test_parameter_hash_and_key(store):
    assert S.parameter_hash({}) == S.parameter_hash(None) == "default"
    assert S.parameter_hash({"p": 1}) == "262ae956981d"
    assert store.key("ds_test", "numba_efficient", {"p": 1}) == "ds_test__numba_efficient__262ae956981d"
    assert store.key("A B", "x", None, "0123456789ab", "abcdef0123") == "a_b__x__default__ds_01234567__ext_abcdef01"


@pytest.mark.parametrize("backend", ["parquet", "memory"])
def test_round_trip_and_slices(spark, tmp_path, backend):
    store = S.FeatureStore(spark, str(tmp_path / "s"), backend)
    df = features(spark)
    assert not store.exists("d", "e")
    store.save(df, "d", "e")
    assert store.exists("d", "e")
    back = store.load("d", "e")
    assert back.exceptAll(df).isEmpty() and back.count() == 600
    ids = spark.createDataFrame([(3,), (5,)], "sequence_id long")
    part = store.load("d", "e", features=["f_0", "f_3", "absent"], ids=ids)
    assert {(r.sequence_id, r.feature) for r in part.collect()} == {(i, f) for i in (3, 5) for f in ("f_0", "f_3")}
    with pytest.raises(FileNotFoundError):
        store.load("d", "other")


def test_second_call_is_a_hit(spark, store):
    calls = []

    def compute():
        calls.append(1)
        return features(spark)

    assert [store.get_or_compute("d", "e", compute, {"p": 1})[1] for _ in range(2)] == [False, True]
    assert len(calls) == 1
    # Other parameters, data or versions are other entries.
    for change in ({"params": {"p": 2}}, {"params": {"p": 1}, "dataset_hash": "x" * 12}, {"params": {"p": 1}, "version": "v2"}):
        assert store.get_or_compute("d", "e", compute, **change)[1] is False


def test_clear_by_dataset(spark, store):
    df = features(spark, 3, 2)
    for d in ("one", "two"):
        store.save(df, d, "e")
    store.clear("one")
    assert not store.exists("one", "e") and store.exists("two", "e")
    assert {r.dataset for r in store.metadata().collect()} == {"one", "two"}
    store.clear()
    assert not store.exists("two", "e")


def test_versions_and_fingerprints(spark, tmp_path):
    def a(df):
        return df

    def b(df):
        return df.distinct()

    assert S.extractor_version(a) != S.extractor_version(b)
    assert S.extractor_version("compact") == S.EXTRACTOR_VERSIONS["compact"]
    path = str(tmp_path / "t")
    features(spark, 2, 2).write.parquet(path)
    before = S.path_fingerprint(spark, path)
    assert before == S.path_fingerprint(spark, path)
    features(spark, 2, 2).write.mode("append").parquet(path)
    assert before != S.path_fingerprint(spark, path)
    df = features(spark)
    assert S.frame_fingerprint(df) == S.frame_fingerprint(df.repartition(9))


def pair(spark, n=40, steps=12, groups=False):
    rng = np.random.default_rng(1)
    rows, targets = [], []
    for s in range(n):
        y = s % 2
        rows += [(s, t, float(v)) for t, v in enumerate(rng.normal(size=steps) + 2 * y)]
        targets.append((s, y, s // 5))
    sequences = spark.createDataFrame(rows, "sequence_id long, step int, sensor double")
    labels = spark.createDataFrame(targets, "sequence_id long, target int, subject_id int")
    return sequences, labels if groups else labels.drop("subject_id")


def test_pair_is_written_read_and_checked(spark, tmp_path):
    sequences, targets = pair(spark, 10, 50)
    folder = str(tmp_path / "pair")
    assert not tables.validate_pair(spark, folder)
    tables.write_pair(sequences, targets, folder)
    assert tables.validate_pair(spark, folder)
    assert tables.read_pair(spark, folder)[0].count() == 500
    assert tables.leaked_columns(spark, f"{folder}/{tables.SEQUENCES}", ["sensor", "absent"]) == ["sensor"]
    # A null in any column counts, also in the last.
    holed = sequences.withColumn("sensor", F.when(F.col("step") > 0, F.col("sensor")))
    tables.write_pair(holed, targets, folder)
    assert not tables.validate_pair(spark, folder)


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "a int, b array<double>")
    tables.export_table(df, str(tmp_path / "x"), "csv")
    assert spark.read.csv(str(tmp_path / "x"), header=True).first().b == "[1.0,2.0]"
    tables.export_table(df, str(tmp_path / "y"))
    assert spark.read.parquet(str(tmp_path / "y")).first().b == [1.0, 2.0]
    with pytest.raises(ValueError):
        tables.export_table(df, str(tmp_path / "z"), "xlsx")
    with pytest.raises(TypeError):
        tables.export_table([1], str(tmp_path / "z"))


def config(**more):
    base = {"extractors": ["statistics_sample"], "selectors": ["none"], "models": ["random_forest"], "n_splits": 2, "trees": 5}
    return M.MatrixConfig(**(base | more))


def test_config_round_trip(tmp_path):
    c = config(seeds=[1, 2])
    c.to_json(str(tmp_path / "c.json"))
    assert M.MatrixConfig.from_json(str(tmp_path / "c.json")) == c
    (tmp_path / "c.yaml").write_text("seeds: [1, 2]\nmodels: [ridge]\n")
    assert M.MatrixConfig.from_yaml(str(tmp_path / "c.yaml")).models == ["ridge"]


def test_matrix_runs_resumes_and_reuses(spark, tmp_path, store):
    out = str(tmp_path / "run")
    data = {"sim": lambda: pair(spark, groups=True)}
    c = config(selectors=["none", {"name": "anova", "k": 2}])
    first = M.Matrix(spark, c, out, store).run(data)
    assert first.count() == 2
    rows = {r.selector: r for r in first.collect()}
    assert rows["none"].accuracy > 0.9 and rows["none"].n_selected == 5 and rows["anova"].n_selected == 2
    assert rows["none"].stability == 1.0 and 0 <= rows["anova"].stability <= 1
    # Nothing is left to do; a new selector runs alone and finds the features stored.
    assert M.Matrix(spark, c, out, store).run(data).count() == 2
    c.selectors.append("variance")
    third = M.Matrix(spark, c, out, store).run(data)
    assert third.count() == 3
    assert {r.selector: r.is_cached for r in third.collect()} == {"none": False, "anova": False, "variance": True}
    runs = M.inventory(third).collect()
    assert sorted(r.n_cells for r in runs) == [1, 2]
    tests = M.analyse(third, "classification")
    assert tests["summary:Selector"].count() == 3


def test_parameters_are_part_of_the_cell(spark, tmp_path, store):
    c = config(extractors=[{"name": "compact", "n_fft_coeffs": n} for n in (1, 2, 3)])
    cells = M.Matrix(spark, c, str(tmp_path / "r"), store).cells(["d"])
    assert cells.select("cell").distinct().count() == 3


def test_changed_data_is_extracted_again(spark, tmp_path, store):
    c = config(selectors=["none"])
    M.Matrix(spark, c, str(tmp_path / "a"), store).run({"d": lambda: pair(spark)})
    def changed():
        sequences, targets = pair(spark)
        return sequences.withColumn("sensor", F.col("sensor") + 1), targets

    again = M.Matrix(spark, c, str(tmp_path / "b"), store).run({"d": lambda: pair(spark)}).first()
    other = M.Matrix(spark, c, str(tmp_path / "c"), store).run({"d": changed}).first()
    assert again.is_cached and not other.is_cached


def test_nothing_selected_is_flagged(spark, tmp_path, store):
    c = config(selectors=[{"name": "variance_threshold", "threshold": 1e9}])
    row = M.Matrix(spark, c, str(tmp_path / "r"), store).run({"sim": lambda: pair(spark)}).first()
    assert row.fallback_triggered and row.n_selected == 5 and row.reduction_pct == 0.0 and row.stability == 0.0


def test_forecasting_matrix(spark, tmp_path, store):
    from tidemark.operators.windowing import segment_forecasting_series

    raw = spark.createDataFrame([(g, t, float(np.sin(t / 5) + g)) for g in (1, 2, 3) for t in range(90)], "series_id int, time int, value double")
    def load():
        return segment_forecasting_series(raw, 30, 3, 6, "time", ["value"], "value", "series_id", 0.25)

    c = config(task_type="forecasting", models=["random_forest", "ridge"])
    rows = M.Matrix(spark, c, str(tmp_path / "r"), store).run({"sines": load}).collect()
    assert {r.model for r in rows} == {"random_forest", "ridge"}
    for r in rows:
        horizons = json.loads(r.horizons)
        assert [h["horizon"] for h in horizons] == [1, 2, 3] and r.rmse > 0 and r.width > 0


def test_regression_matrix_has_pooled_metrics(spark, tmp_path, store):
    def load():
        sequences, targets = pair(spark)
        return sequences, targets.withColumn("target", F.col("target") * 2.5 + F.col("sequence_id") * 0.01)

    row = M.Matrix(spark, config(task_type="regression"), str(tmp_path / "r"), store).run({"d": load}).first()
    assert row.r2 > 0.5 and row.pooled_rmse > 0


def test_close_errors_stay_apart(spark, tmp_path, store):
    sequences, targets = pair(spark)
    targets = targets.withColumn("target", F.col("target").cast("double"))
    given = [{"name": "ridge", "alpha": alpha} for alpha in (1.0, 1.00001)]
    run = M.Matrix(spark, config(task_type="regression", models=given, selectors=["none"]), str(tmp_path / "r"), store)
    rows = run.run({"d": lambda: (sequences, targets)}).collect()
    assert len(rows) == 2 and len({r.rmse for r in rows}) == len({r.pooled_rmse for r in rows}) == 2
    assert abs(rows[0].rmse - rows[1].rmse) < 1e-4


def test_target_profile_counts(spark):
    got = aggregate.target_profile(pair(spark)[1]).first()
    assert got["count"] == 40 and got["mean"] == 0.5
