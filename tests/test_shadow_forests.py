"""Boruta on all sequences: blocks of codes, dealt shadows and the forests on them."""

import numpy as np
import pytest
from test_selection import kept, long, target

from tidemark.operators import model_selection as trees
from tidemark.operators import shadow_forests as sf
from tidemark.operators.splits import sample_rows
from tidemark.session import Scratch

ID = "sequence_id"


def test_boruta_looks_at_all_sequences(spark):
    """The signal is in the sequences that a sample of 1,000 leaves out."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(3000, 2)), rng.integers(0, 2, 3000)
    classes = target(spark, y)
    drawn = {r[ID] for r in sample_rows(classes, 1000, ID, 42).collect()}
    for i in set(range(3000)) - drawn:
        x[i, 0] = abs(x[i, 0]) * (1 if y[i] else -1)
    assert kept(trees.boruta(long(spark, x), classes, n_estimators=10)) == {"feature_0"}
    assert kept(trees.boruta(long(spark, x), classes, n_estimators=10, max_samples=1000)) == set()


def test_boruta_with_a_real_target(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 4))
    y = 1e9 + 3 * x[:, 1] + x[:, 2] ** 2
    mask = trees.boruta(long(spark, x), target(spark, y, "double"), n_estimators=10, task_type="regression")
    assert kept(mask) == {"feature_1", "feature_2"}
    with pytest.raises(ValueError):
        trees.boruta(long(spark, x), target(spark, [float("nan"), *y[1:]], "double"), task_type="regression")


def test_permutation_of_any_number_of_ranks():
    for n in (1, 2, 3, 31, 1000, 4097):
        key = sf.seeds(5, n).generate_state(8, np.uint64)
        to = sf.dealt(np.arange(n), n, key)
        assert sorted(to.tolist()) == list(range(n))
        assert n < 1000 or (to == np.arange(n)).sum() < 10


def blocks_of(spark, scratch, cells, labels, names, classes=2):
    features = spark.createDataFrame(cells, "sequence_id long, feature string, value double")
    return sf.coded_blocks(scratch, features, spark.createDataFrame(labels, "sequence_id long, label double"), names, classes, ID)


def test_shadows_hold_all_values_over_blocks(spark, monkeypatch):
    """Every value of a feature is in its shadow once, in rows that have the feature; null and missing cells, repeated and
    null ids, ids without a target."""
    monkeypatch.setattr(sf, "BLOCK_CELLS", 200)
    rng = np.random.default_rng(6)
    cells = [(i, f"f{j}", float(rng.integers(1, 9))) for i in range(900) for j in range(2) if j == 0 or i % 3]
    cells += [(None, "f0", 1.0), (2000, "f1", None), (2001, "f2", 7.0), (3000, "f3", 7.0)]
    labels = [(i, float(i % 2)) for i in range(900)] + [(5, 1.0), (None, 1.0), (2000, 0.0), (2001, None), (9999, 1.0)]
    with Scratch(spark) as scratch:
        blocks = blocks_of(spark, scratch, cells, labels, ["f0", "f1", "f2", "f3"])
        assert len(blocks.present) > 5 and blocks.seen.tolist() == [True, True, True, False]
        assert blocks.present.sum(0).tolist() == [901, 602, 0, 0]
        rows = [r for r in sf.with_shadows(blocks, [0, 1], 7).collect()]
        assert sum(r.n for r in rows) == 902
        x = np.concatenate([np.frombuffer(r.x, np.uint8).reshape(4, r.n) for r in rows], axis=1)
        zero = 0 if 0.0 not in blocks.cuts[0] else int(sf.codes_of(np.zeros((1, 1)), [blocks.cuts[0]])[0, 0])
        for f in (0, 1):
            assert sorted(x[f].tolist()) == sorted(x[2 + f].tolist())
            assert 0.05 < (x[f] == x[2 + f])[x[f] != zero].mean() < 0.25
        assert ((x[1] == zero) == (x[3] == zero)).mean() > 0.99
        again = np.concatenate([np.frombuffer(r.x, np.uint8).reshape(4, r.n) for r in sf.with_shadows(blocks, [0, 1], 7).collect()], axis=1)
        assert sorted(map(tuple, x.T.tolist())) == sorted(map(tuple, again.T.tolist()))


def test_cuts_are_those_of_all_values(spark, monkeypatch):
    monkeypatch.setattr(sf, "BLOCK_CELLS", 500)
    values = np.random.default_rng(8).permutation(3200)
    cells = [(i, "many", float(v)) for i, v in enumerate(values)] + [(i, "few", float(i % 5)) for i in range(3200)]
    with Scratch(spark) as scratch:
        blocks = blocks_of(spark, scratch, cells, [(i, 0.0) for i in range(3200)], ["few", "many"])
    assert blocks.cuts[0].tolist() == [0, 1, 2, 3, 4]
    assert blocks.cuts[1].tolist() == [0.0, *[100.0 * k - 1 for k in range(1, 32)]]


def test_importances_are_near_those_of_a_forest(spark):
    from pyspark.ml.classification import RandomForestClassifier

    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 4))
    features, classes = long(spark, x), target(spark, np.where(x[:, 1] > 0, 2, np.where(x[:, 2] > 0.5, 1, 0)))
    names = trees.feature_names(features)
    rows = trees.training_rows(features, classes, names, "classification")
    spark_own = RandomForestClassifier(numTrees=40, seed=1).fit(rows).featureImportances.toArray()
    with Scratch(spark) as scratch:
        blocks = sf.coded_blocks(scratch, features, trees.indexed_target(classes, "classification").select(ID, "label"), names, 3, ID)
        own = sf.importances(blocks.table, blocks, 4, 40, 1)
    assert np.abs(own - spark_own).max() < 0.06 and abs(own.sum() - 1) < 1e-9


def test_boruta_without_rows(spark):
    none = spark.createDataFrame([], "sequence_id long, feature string, value double")
    assert trees.boruta(none, target(spark, [0, 1])).count() == 0
    one = trees.boruta(long(spark, np.ones((6, 2))), target(spark, [1] * 6), n_estimators=3, max_iter=3)
    assert kept(one) == set() and one.count() == 2
