"""Nearest-neighbour information, exact small-sample p, balanced group folds and count windows on a stream."""

import itertools
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.exact_tests import inversions_tail, smirnov_tail
from tidemark.operators import neighbours, splits
from tidemark.operators.selection import mutual_information
from tidemark.operators.windowing import segment_time_series
from tidemark.streaming.count_windows import stream_count_windows


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def plain_information(x, y, k=3):
    x, y = x / (x.std() or 1.0), y / (y.std() or 1.0)
    k, total = min(k, len(x) - 1), 0.0
    for i in range(len(x)):
        dx, dy = np.abs(x - x[i]), np.abs(y - y[i])
        r = np.sort(np.delete(np.maximum(dx, dy), i))[k - 1]
        nx, ny = (max(1, int((np.delete(d, i) < r).sum()) + 1) for d in (dx, dy))
        total += psi(nx) + psi(ny)
    return max(0.0, psi(len(x)) + psi(k) - total / len(x))


@pytest.mark.parametrize("margin, blocks", [(None, False), (None, True), (4, True)])
def test_information_equals_brute_force(spark, margin, blocks):
    """In one block, in blocks of 256, and with a margin so small that most points are measured again."""
    rng = np.random.default_rng(2)
    n = 700
    y = rng.normal(size=n)
    made = {"line": 2 * y + 0.1 * rng.normal(size=n), "none": rng.normal(size=n), "wave": np.sin(3 * y) + 0.05 * rng.normal(size=n), "tail": rng.standard_cauchy(n) + y}
    rows = [(i, f, float(v)) for f, x in made.items() for i, v in enumerate(x)] + [(0, "single", 1.0), (1, "pair", 1.0), (2, "pair", 5.0)]
    features = spark.createDataFrame(rows, "sequence_id long, feature string, value double")
    targets = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "sequence_id long, target double")
    if blocks:
        spark.conf.set("spark.tidemark.blockRows", "256")
    try:
        found = {r["feature"]: r["score"] for r in neighbours.real_mutual_information(features, targets, jitter=False, margin=margin).collect()}
    finally:
        spark.conf.unset("spark.tidemark.blockRows")
    assert found.pop("single") == 0.0 and found.pop("pair") >= 0.0 and found.keys() == made.keys()
    for f, x in made.items():
        assert math.isclose(found[f], plain_information(x, y), abs_tol=1e-9), f


def test_top_features_of_a_real_target(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(size=300)
    made = {"good": y**3, "noise": rng.normal(size=300), "flat": np.ones(300), "steps": np.round(y)}
    rows = [(i, f, float(v)) for f, x in made.items() for i, v in enumerate(x)]
    features = spark.createDataFrame(rows, "sequence_id long, feature string, value double")
    targets = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "sequence_id long, target double")
    kept = {r["feature"] for r in mutual_information(features, targets, k=2, task_type="regression").where("selected").collect()}
    assert kept == {"good", "steps"}


def test_two_sample_tail_equals_all_orders():
    for n1, n0 in ((1, 1), (2, 3), (4, 4), (5, 3)):
        every = []
        for places in itertools.combinations(range(n1 + n0), n1):
            flags = np.isin(np.arange(n1 + n0), places)
            every.append(np.abs(np.cumsum(flags) / n1 - np.cumsum(~flags) / n0).max())
        for d in sorted(set(np.round(every, 12))):
            assert math.isclose(smirnov_tail(n1, n0, d), float((np.array(every) >= d - 1e-9).mean()), rel_tol=1e-12)
    assert math.isnan(smirnov_tail(0, 5, 0.5)) and smirnov_tail(3, 4, 0.0) == 1.0
    assert 0 < smirnov_tail(400, 300, 0.9) < 1e-80


def test_inversion_tail_equals_all_orders():
    for n in (2, 3, 5, 7):
        inversions = [sum(a > b for a, b in itertools.combinations(p, 2)) for p in itertools.permutations(range(n))]
        for c in range(n * (n - 1) // 2 + 1):
            fewer = min(c, n * (n - 1) // 2 - c)
            assert math.isclose(inversions_tail(n, c), min(1.0, 2 * np.mean(np.array(inversions) <= fewer)), rel_tol=1e-12)


def test_group_folds_are_even_in_every_class(spark):
    """Groups whose commonest class says little: shares come out as near as a group allows, and no group is split."""
    rng = np.random.default_rng(4)
    rows = []
    for g in range(150):
        shares = rng.dirichlet([0.6, 0.4, 0.2])
        for c in rng.choice(3, size=int(rng.integers(3, 40)), p=shares):
            rows.append((len(rows), f"g{g}" if g else None, f"c{c}"))
    df = spark.createDataFrame(rows, "sequence_id long, subject string, target string")
    folds = splits.group_k_fold(df, 5, "subject", target="target")
    plain = splits.group_k_fold(df, 5, "subject", target="target", rounds=0)

    def worst(table):
        cells = table.join(df, "sequence_id").groupBy("fold", "target").count().toPandas().pivot(index="fold", columns="target", values="count").to_numpy()
        assert table.count() == len(rows)
        return np.abs(cells / cells.sum(0) - 0.2).max()

    assert folds.join(df, "sequence_id").groupBy("subject").agg(F.countDistinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1
    assert worst(folds) < 0.01 < worst(plain)
    assert sorted(folds.collect()) == sorted(splits.group_k_fold(df, 5, "subject", target="target").collect())


def test_count_windows_of_a_stream(spark, tmp_path):
    """Rows in any order within the lateness, a row that comes too late, a stream that is started again, gaps between windows."""
    start = datetime(2024, 1, 1)
    rng = np.random.default_rng(5)
    rows = [(s, start + timedelta(seconds=int(t)), i, float(rng.normal())) for s in ("a", "b", None) for i, t in enumerate(np.sort(rng.integers(0, 400, 60)))]
    schema = "s string, t timestamp, k long, v double, closing boolean"
    late = sorted(rows, key=lambda r: (r[1] - start).total_seconds() + float(rng.uniform(0, 30)))
    parts = [late[i : i + 45] for i in range(0, len(late), 45)]
    end = [(None, start + timedelta(days=9), 0, 0.0, True)]

    def run(name, size, stride, upto):
        for i, part in enumerate([*parts, [("a", start, 99, 0.0)]]):
            if upto[0] <= i < upto[1]:
                spark.createDataFrame([(*r, False) for r in part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
        if upto[1] > len(parts):
            spark.createDataFrame(end, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/in")
        out = stream_count_windows(stream, ["s"], "t", size, stride, ["v"], ["k"], "31 seconds", "closing")
        sink = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{name}/log").option("path", f"{tmp_path}/{name}/out")
        sink.trigger(availableNow=True).start().awaitTermination()

    df = spark.createDataFrame(rows, "s string, t timestamp, k long, v double")
    for name, size, stride in (("overlap", 7, 3), ("gaps", 4, 9)):
        run(name, size, stride, (0, 2))
        run(name, size, stride, (2, 99))
        got = spark.read.parquet(f"{tmp_path}/{name}/out").collect()
        want = []
        for s in ("a", "b", None):
            own = sorted((r[1], r[2], r[3]) for r in rows if r[0] == s)
            want += [(s, w, i, *own[w * stride + i]) for w in range((len(own) - size) // stride + 1) for i in range(size)]
        key = lambda r: (r[0] or "", r[1], r[2])
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    windows = segment_time_series(df.where("s = 'a'"), 7, 3, ["t", "k"], ["v"])[0]
    assert windows.count() == spark.read.parquet(f"{tmp_path}/overlap/out").where("s = 'a'").count()
