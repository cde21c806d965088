import pytest
from pyspark.sql import functions as F

from tidemark.operators import position
from tidemark.operators import selection as sel


def test_kinds_of_features(spark):
    values = {"a": [1.0, 1.0, 1.0], "b": [0.0, 2.0, 2.0], "c": [0.0, 1.0, 2.0], "d": [None, float("nan"), 1.0]}
    rows = [(i, f, v) for f, vs in values.items() for i, v in enumerate(vs)]
    kinds = sel.value_kinds(spark.createDataFrame(rows, "sequence_id long, feature string, value double"))
    assert {r["feature"]: r["type"] for r in kinds.collect()} == {"a": "constant", "b": "binary", "c": "real", "d": "binary"}


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_only_the_tests_that_features_take_run(spark, monkeypatch, task):
    for name in ("fisher_exact", "smirnov"):
        monkeypatch.setattr(sel, name, lambda *_: pytest.fail("no feature has two values"))
    rows = spark.range(60).select(F.col("id").alias("sequence_id"), F.lit("a").alias("feature"), (F.col("id") % 7).cast("double").alias("value"))
    targets = spark.range(60).select(F.col("id").alias("sequence_id"), (F.col("id") % 3).alias("target"))
    assert sel.relevance_table(rows, targets, task).first()["type"] == "real"


def test_later_order_columns_are_measured_where_they_divide(spark, small_tasks):
    rows = spark.range(400).select("id", (F.col("id") % 3).alias("few"), F.when(F.col("id") > 200, F.col("id")).alias("holes"))
    assert len(position.bucket_codes(rows, ["id", "few"], 400)) == 1
    assert len(position.bucket_codes(rows, ["few", "id"], 400)) == 2
    assert len(position.bucket_codes(rows, ["holes", "id"], 400)) == 2
    for order in (["id", "few"], ["few", "id"], ["holes", "id"]):
        coded = rows.withColumns(position.bucket_codes(rows, order, 400))
        assert max(r["count"] for r in coded.groupBy(*[c for c in coded.columns if c.startswith("__bucket")]).count().collect()) <= 20
