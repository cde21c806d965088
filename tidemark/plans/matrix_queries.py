"""Queries that run the experiment matrix over windowed events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import matrix as M
from tidemark.plans.feature_queries import scratch_folder
from tidemark.plans.registry import query
from tidemark.plans.window_queries import event_windows, forecasting_windows
from tidemark.sources.store import FeatureStore


def run_matrix(spark, sf_dir, times: int = 1, **settings):
    """Results of a small matrix over the event windows, run once or again to resume."""
    folder = scratch_folder(spark)
    store = FeatureStore(spark, f"{folder}/store")
    config = M.MatrixConfig(n_splits=2, trees=5, **settings)

    def load():
        if config.task_type == "forecasting":
            return forecasting_windows(spark, sf_dir)
        # The type of the last event as class: any half of the windows has several types.
        return event_windows(spark, sf_dir, "code", "last")

    results = None
    for _ in range(times):
        results = M.Matrix(spark, config, folder, store).run({"events": load})
    return results


KEYS = ["dataset", "task", "seed", "extractor", "selector", "model", "is_cached", "fallback_triggered", "n_extracted"]


@query(
    "experiment_matrix",
    """SELECT DISTINCT 'events' AS dataset, 'classification' AS task, 42::INTEGER AS seed, 'statistics_sample' AS extractor, s AS selector,
'random_forest' AS model, false AS is_cached, false AS fallback_triggered, 5::INTEGER AS n_extracted,
(CASE s WHEN 'none' THEN 5 ELSE 2 END)::DOUBLE AS n_selected FROM events CROSS JOIN (SELECT unnest(['none', 'anova']) AS s)""",
)
def _(spark, sf_dir):
    selectors = ["none", {"name": "anova", "k": 2}]
    results = run_matrix(spark, sf_dir, extractors=["statistics_sample"], selectors=selectors)
    return results.select(*KEYS, "n_selected")


@query(
    "experiment_matrix_resumed",
    """SELECT DISTINCT 1::BIGINT AS n_runs, 2::BIGINT AS n_cells, 2::BIGINT AS n_distinct FROM events""",
)
def _(spark, sf_dir):
    results = run_matrix(spark, sf_dir, times=2, extractors=["statistics_sample", "minimal"], selectors=["none"])
    runs = M.inventory(results)
    return runs.agg(F.count(F.lit(1)).alias("n_runs"), F.sum("n_cells").alias("n_cells")).crossJoin(
        results.agg(F.countDistinct("cell").alias("n_distinct"))
    )


@query("experiment_matrix_forecasts")
def _(spark, sf_dir):
    results = run_matrix(spark, sf_dir, task_type="forecasting", extractors=["statistics_sample"], selectors=["none"], models=["ridge"])
    return results.select(*KEYS, "rmse", "mae", "coverage", "width", "horizons")


@query(
    "experiment_matrix_model_settings",
    """SELECT DISTINCT p AS model_params, 1::BIGINT AS n_cells, 3::BIGINT AS n_errors FROM events
CROSS JOIN (SELECT unnest(['{}', '{"alpha": 50.0}', '{"alpha": 100000.0}']) AS p)""",
)
def _(spark, sf_dir):
    """One model with three settings: three cells with an error of their own each."""
    folder = scratch_folder(spark)
    config = M.MatrixConfig(
        task_type="regression", n_splits=2, extractors=["statistics_sample"], selectors=["none"],
        models=["ridge", {"name": "ridge", "alpha": 50.0}, {"name": "ridge", "alpha": 100000.0}],
    )
    results = M.Matrix(spark, config, folder, FeatureStore(spark, f"{folder}/store")).run({"events": lambda: event_windows(spark, sf_dir, "code", "mean")})
    errors = results.agg(F.countDistinct("rmse").alias("n_errors"))
    return results.groupBy("model_params").agg(F.count(F.lit(1)).alias("n_cells")).crossJoin(errors)


@query("experiment_analysis")
def _(spark, sf_dir):
    """Paired tests of the extractors over the seeds of a matrix run."""
    results = run_matrix(
        spark, sf_dir, extractors=["statistics_sample", "statistics_population"], selectors=["none"], seeds=[1, 2, 3]
    )
    return M.analyse(results, "classification")["tests:Extractor:Accuracy"]


@query(
    "experiment_matrix_cached",
    """SELECT DISTINCT c AS is_cached, 1::BIGINT AS n FROM events CROSS JOIN (SELECT unnest([false, true]) AS c)""",
)
def _(spark, sf_dir):
    """The same cell twice without resuming: the second run takes its features from the store."""
    results = run_matrix(spark, sf_dir, times=2, resume=False, extractors=["statistics_sample"], selectors=["none"])
    return results.groupBy("is_cached").agg(F.count(F.lit(1)).alias("n"))


@query(
    "configuration_stages",
    """SELECT DISTINCT s AS stage, s AS task, 1::BIGINT AS n_cells, 5::INTEGER AS n_extracted, true AS scored FROM events
CROSS JOIN (SELECT unnest(['classification', 'regression']) AS s)""",
)
def _(spark, sf_dir):
    """A classification run and a regression run in sequence."""
    folder = scratch_folder(spark)
    settings = {"n_splits": 2, "trees": 5, "extractors": ["statistics_sample"], "selectors": ["none"]}
    stages = {
        "classification": (M.MatrixConfig(**settings), {"events": lambda: event_windows(spark, sf_dir, "code", "last")}),
        "regression": (
            M.MatrixConfig(task_type="regression", models=["ridge"], **settings),
            {"events": lambda: event_windows(spark, sf_dir, "code", "mean")},
        ),
    }
    results = M.run_stages(spark, stages, folder, FeatureStore(spark, f"{folder}/store"))
    score = F.coalesce("accuracy", "rmse").isNotNull()
    return results.groupBy("stage", "task").agg(
        F.count(F.lit(1)).alias("n_cells"), F.max("n_extracted").alias("n_extracted"), F.every(score).alias("scored")
    )
