import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidemark.operators import models
from tidemark.operators.forests import RandomForest
from tidemark.plans.selection_queries import line_features


def rows_of(spark, x, y):
    data = [(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "sequence_id long, x array<double>, label double")
    return df.select("sequence_id", array_to_vector("x").alias("features"), "label")


def noise(seed, n, classes=3):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 20, (n, 4)), rng.integers(0, classes, n)


def predicted(model, rows, column="prediction"):
    return [r[column] for r in model.transform(rows).orderBy("sequence_id").collect()]


def cart(x, y, depth):
    """The mean in the leaf of each row, by trying every cut."""
    best = None
    if depth and np.ptp(y) > 0:
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= cut
                cost = sum(((p - p.mean()) ** 2).sum() for p in (y[left], y[~left]))
                if best is None or cost < best[0] - 1e-9:
                    best = cost, left
    if best is None:
        return np.full(len(y), y.mean())
    out = np.empty(len(y))
    for side in (best[1], ~best[1]):
        out[side] = cart(x[side], y[side], depth - 1)
    return out


def test_full_trees_take_few_jobs(spark):
    train = rows_of(spark, *noise(1, 1500)).localCheckpoint()
    context = spark.sparkContext
    context.setJobGroup("full trees", "")
    models.build_model({"name": "random_forest", "trees": 3}, "classification", train).fit(train)
    jobs = context.statusTracker().getJobIdsForGroup("full trees")
    context.setJobGroup("other", "")
    assert len(jobs) <= 16


@pytest.mark.parametrize("piece_rows", [1 << 17, 60])
def test_one_tree_equals_the_exhaustive_search(spark, piece_rows):
    x, _ = noise(2, 300)
    y = np.random.default_rng(3).normal(size=300)
    rows = rows_of(spark, x, y)
    model = RandomForest(False, 1, 5, 4, 1, "all", piece_rows).fit(rows)
    assert np.allclose(predicted(model, rows), cart(x, y, 4))


def test_pieces_change_nothing_and_runs_agree(spark):
    x, y = noise(4, 400)
    rows = rows_of(spark, x, y)
    whole = RandomForest(True, 4, 7, 30, 1, "all").fit(rows)
    cut = RandomForest(True, 4, 7, 30, 1, "all", 50).fit(rows.repartition(5))
    assert cut.pieces > whole.pieces
    assert np.allclose(predicted(whole, rows, "probabilities"), predicted(cut, rows, "probabilities"))
    assert np.allclose(whole.importances(), cut.importances())
    again = RandomForest(True, 4, 7, 30, 1, "sqrt").fit(rows), RandomForest(True, 4, 7, 30, 1, "sqrt").fit(rows.repartition(3))
    assert predicted(again[0], rows, "probabilities") == predicted(again[1], rows, "probabilities")


def test_a_full_tree_tells_all_rows_apart(spark):
    x = np.stack([np.arange(30), np.arange(30)[::-1]], axis=1)
    y = np.arange(30) % 3
    rows = rows_of(spark, x, y)
    assert predicted(RandomForest(True, 1, features="all").fit(rows), rows) == list(y)
    # One class, or one label: a single leaf.
    for classes, value in ((True, 0.0), (False, 4.5)):
        same = rows.withColumn("label", F.lit(value))
        assert set(predicted(RandomForest(classes, 3).fit(same), same)) == {value}


def test_trees_predict_one_by_one_and_rows_go_to_a_side(spark):
    x, y = noise(6, 200)
    rows = rows_of(spark, x, x[:, 0] + 0.5)
    model = RandomForest(False, 5, 1, 30, 10).fit(rows)
    out = model.transform(rows).collect()
    assert len(out) == 200 and all(len(r["each"]) == 5 for r in out)
    assert all(r["prediction"] == pytest.approx(np.mean(r["each"])) for r in out)
    strong = RandomForest(False, 5, 1, 30, 1, "all").fit(rows)
    assert np.corrcoef(predicted(strong, rows), x[:, 0])[0, 1] > 0.99
    assert int(np.argmax(strong.importances())) == 0


def test_line_rows_are_numbered_once(spark):
    # Boruta and logistic regression read them again and again.
    for part in line_features(spark, "/root/testdata/sf0.001"):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Join" not in plan
