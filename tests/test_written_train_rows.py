from pyspark.sql import functions as F

from tidemark.operators import models, splits
from tidemark.plans import feature_queries
from tidemark.plans.registry import QUERIES


def test_a_fit_reads_written_rows(spark, monkeypatch):
    plans, build = [], models.build_model
    monkeypatch.setattr(models, "build_model", lambda m, t, train, *a: plans.append(train._jdf.queryExecution().optimizedPlan().toString()) or build(m, t, train, *a))
    ids = spark.range(60).select(F.col("id").alias("sequence_id"), F.lit("a").alias("feature"), F.col("id").cast("double").alias("value"))
    targets = spark.range(60).select(F.col("id").alias("sequence_id"), (F.col("id") * 2.0).alias("target"))
    roles = splits.fold_roles(targets.select("sequence_id", (F.col("sequence_id") % 2).cast("int").alias("fold")), 2)
    assert models.cross_validate(ids, targets, roles, "ridge", "regression").count() == 60
    assert len(plans) == 2 and not any("Join" in p for p in plans)


def test_the_pipeline_selects_on_written_tables(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(feature_queries, "run_selector", lambda _name, *tables: seen.extend(tables))
    QUERIES["pipeline_end_to_end"](spark, "/root/testdata/sf0.001")
    plans = [t._jdf.queryExecution().optimizedPlan().toString() for t in seen]
    assert len(plans) == 2 and not any("Window" in p or "Join" in p for p in plans)
