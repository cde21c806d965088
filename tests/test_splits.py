"""Folds and hold-outs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import splits

ID = "sequence_id"


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, int(i % 10 == 0), i // 7, i) for i in range(140)]
    return spark.createDataFrame(data, "sequence_id long, target int, subject_id int, t int").repartition(5).cache()


def sizes(folds, *by):
    return {tuple(r[:-1]): r[-1] for r in folds.groupBy("fold", *by).count().collect()}


def test_stratified_folds_are_even_and_seeded(rows):
    folds = splits.stratified_k_fold(rows, 5)
    assert set(sizes(folds).values()) == {28}
    per_class = sizes(folds.join(rows, ID), "target")
    assert all(2 <= n <= 3 for (_f, t), n in per_class.items() if t == 1)
    again, other = splits.stratified_k_fold(rows, 5), splits.stratified_k_fold(rows, 5, seed=7)
    assert folds.exceptAll(again).isEmpty() and not folds.exceptAll(other).isEmpty()


def test_groups_stay_together(rows):
    for target in (None, "target"):
        folds = splits.group_k_fold(rows, 4, "subject_id", target=target)
        spread = folds.join(rows, ID).groupBy("subject_id").agg(F.countDistinct("fold").alias("n"))
        assert {r.n for r in spread.collect()} == {1}
        assert folds.count() == 140 and set(sizes(folds)) == {(f,) for f in range(4)}


def test_groups_are_dealt_evenly_at_any_size(spark, rows):
    plain = splits.group_k_fold(rows, 4, "subject_id")
    assert set(sizes(plain).values()) == {35}
    spark.conf.set("spark.tidemark.maxSmallRows", "5")
    spark.conf.set("spark.tidemark.maxGroupRows", "4")
    try:
        assert splits.group_k_fold(rows, 4, "subject_id").exceptAll(plain).isEmpty()
    finally:
        spark.conf.unset("spark.tidemark.maxSmallRows")
        spark.conf.unset("spark.tidemark.maxGroupRows")


def test_rows_without_group_or_class_stay(rows):
    holes = rows.withColumns({
        "subject_id": F.when(F.col(ID) % 10 != 0, F.col("subject_id")), "target": F.when(F.col(ID) % 7 != 0, F.col("target")),
    })
    for folds in (splits.group_k_fold(holes, 4, "subject_id"), splits.group_k_fold(holes, 4, "subject_id", target="target"), splits.stratified_k_fold(holes, 4)):
        assert folds.count() == rows.count() and folds.filter("fold IS NULL").count() == 0


def test_more_folds_than_groups_and_a_single_group(rows):
    few = rows.withColumn("subject_id", F.col(ID) % 3)
    assert len(sizes(splits.group_k_fold(few, 5, "subject_id"))) == 3
    one = rows.withColumn("subject_id", F.lit(1))
    assert set(sizes(splits.group_k_fold(one, 5, "subject_id")).values()) == {28}


def test_purged_blocks(rows):
    parts: dict = {}
    for r in splits.purged_blocked_splits(rows, 3, 4, ["t"]).collect():
        parts.setdefault((r.fold, r.role), set()).add(r[ID])
    assert [len(parts[f, "test"]) for f in range(3)] == [46, 46, 48]
    for f in range(3):
        lo, hi = min(parts[f, "test"]), max(parts[f, "test"])
        assert parts[f, "train"] == {i for i in range(140) if i < lo - 4 or i > hi + 4}


def test_expanding_splits(rows):
    parts: dict = {}
    for r in splits.expanding_splits(rows, 3, ["t"]).collect():
        parts.setdefault((r.fold, r.role), []).append(r[ID])
    assert [len(parts[f, "test"]) for f in range(3)] == [35] * 3
    assert all(max(parts[f, "train"]) < min(parts[f, "test"]) for f in range(3))


def test_blocks_and_classes_in_time_order(rows):
    folds = {r[ID]: r.fold for r in splits.blocked_folds(rows, 3, ["t"]).collect()}
    assert [folds[i] for i in range(140)] == sorted(folds.values())
    assert [list(folds.values()).count(f) for f in range(3)] == [47, 47, 46]
    per_class = sizes(splits.blocked_folds(rows, 2, ["t"], target="target").join(rows, ID), "target")
    assert per_class == {(0, 0): 63, (1, 0): 63, (0, 1): 7, (1, 1): 7}


def test_holdouts(rows):
    late = {r.role: r.n for r in splits.holdout(rows, 0.25, order=["t"]).groupBy("role").agg(F.min(ID).alias("n")).collect()}
    assert late == {"train": 0, "test": 105}
    given = rows.withColumn("split", F.when(F.col(ID) < 3, "test").otherwise("train"))
    assert splits.holdout(given, 0.5).filter("role = 'test'").count() == 3
    strat = splits.holdout(rows, 0.5, target="target").join(rows, ID).filter("role = 'test'")
    assert {r.target: r["count"] for r in strat.groupBy("target").count().collect()} == {0: 63, 1: 7}


def test_balance_flags_a_single_class(rows):
    roles = splits.fold_roles(splits.blocked_folds(rows.filter("t < 20"), 10, ["t"]), 10)
    flags = {(r.fold, r.role): r.single_class for r in splits.fold_balance(roles, rows).collect()}
    assert flags[1, "test"] and not flags[0, "test"] and not flags[0, "train"]


def test_repeats_differ(rows):
    out = splits.repeated_stratified_k_fold(rows, 5, [1, 2])
    assert out.count() == 280
    a, b = (out.filter(F.col("repeat") == r).select(ID, "fold") for r in (0, 1))
    assert not a.exceptAll(b).isEmpty()


def test_group_column_names(rows):
    assert splits.group_column(rows) == "subject_id"
    assert splits.group_column(rows.drop("subject_id")) is None


def test_a_round_passes_over_the_groups_once(spark, monkeypatch):
    passes, read = [], splits._with_moves
    monkeypatch.setattr(splits, "_with_moves", lambda *a: passes.append(read(*a)) or passes[-1])
    rows = spark.range(900).select(F.col("id").alias(ID), F.pmod(F.xxhash64("id"), F.lit(61)).alias("subject_id"))
    rows = rows.withColumn("target", F.pmod(F.xxhash64(F.lit(1), ID), F.col("subject_id") % 4 + 1))
    scans, explode = [], F.explode
    monkeypatch.setattr(splits.F, "explode", lambda c: scans.append(c) or explode(c))
    folds = splits.group_k_fold(rows, 4, "subject_id", target="target")
    assert len(passes) > 2 and len(scans) == 1
    assert folds.count() == 900


def test_proposals_are_the_best_moves(spark):
    rng = np.random.default_rng(5)
    share, weight = rng.normal(size=(3, 4)), rng.random(4)
    rows = []
    for g in range(50):
        at = sorted(rng.choice(4, rng.integers(1, 5), replace=False).tolist())
        rows.append((g, int(rng.integers(0, 3)), at, rng.integers(1, 9, len(at)).tolist()))
    groups = spark.createDataFrame(rows, "__group long, fold int, at array<int>, n array<long>")
    got = {r["__group"]: (r["to"], r["gain"]) for r in splits._proposals(groups, share, weight).collect()}
    for g, fold, at, n in rows:
        gain = splits._gains(share, weight, fold, np.array(at), np.array(n))
        assert (g in got) == (gain.max() > 1e-12)
        assert g not in got or (got[g][0] == gain.argmax() and np.isclose(got[g][1], gain.max()))
