import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import selection as sel


def test_tasks_unfold_few_rows(spark, small_tasks):
    ordered = spark.range(5000).coalesce(1).select(
        F.lit("a").alias("feature"), F.col("id").alias("p"), F.lit(5000).cast("long").alias("n"), F.rand(1).alias("y")
    )
    levels = sel._merge_levels(ordered)
    each = [r["count"] for r in levels.groupBy(F.spark_partition_id()).count().collect()]
    # 13 levels, and about 256 rows of them in a task.
    assert sum(each) == 13 * 5000 and max(each) < 13 * 512


def test_tau_of_long_columns(spark, small_tasks):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 9, 700), rng.normal(size=700)
    features = spark.createDataFrame([(i, "a", float(v)) for i, v in enumerate(x)], "sequence_id long, feature string, value double")
    targets = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "sequence_id long, target double")
    signs = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
    pairs = np.sqrt((x[:, None] != x).sum() * (y[:, None] != y).sum())
    assert np.isclose(sel.kendall(features, targets).first()["tau"], signs.sum() / pairs)


def test_counts_by_value_are_spread(spark, small_tasks):
    rows = spark.range(2000).coalesce(1).select(F.col("id").alias("sequence_id"), F.lit("a").alias("feature"))
    each = [r["count"] for r in sel._spread(rows).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(each) == 2000 and max(each) < 60
