"""The experiment matrix: datasets x seeds x extractors x selectors x models under cross-validation."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expr import null_label
from tidemark.operators import aggregate, compare, models, selection, splits
from tidemark.operators.features.extractors import extract, extractor_name
from tidemark.operators.reshape import horizon_vector
from tidemark.session import cut_lineage
from tidemark.sources.store import FeatureStore, extractor_version, frame_fingerprint, parameter_hash
from tidemark.sources.tables import path_exists

ID = "sequence_id"
# Result columns with their types.
RESULT_SCHEMA = """run_id string, cell string, dataset string, task string, seed int, extractor string, extractor_params string,
selector string, model string, model_params string, is_cached boolean, fallback_triggered boolean, n_extracted int, n_selected double,
reduction_pct double, stability double, extraction_s double, selection_s double, fit_s double, predict_s double,
ms_per_row double, total_s double, accuracy double, rmse double, mae double, r2 double, coverage double, width double,
pooled_rmse double, pooled_mae double, pooled_r2 double, horizons string, saved_at timestamp"""
METRICS = {
    "classification": ("accuracy",),
    "regression": ("rmse", "mae", "r2"),
    "forecasting": ("rmse", "mae", "coverage", "width"),
}
# Analysis metric names of the result columns, for their direction.
METRIC_LABELS = {
    "accuracy": "Accuracy", "rmse": "RMSE", "mae": "MAE", "r2": "R2", "coverage": "Interval Coverage",
    "width": "Mean Interval Width", "extraction_s": "Extraction Time (s)", "selection_s": "Selection Time (s)",
    "predict_s": "Prediction Time (s)", "total_s": "Total Time (s)", "n_selected": "N Selected Features",
    "stability": "Selection Stability (Jaccard)",
}


@dataclass
class MatrixConfig:
    """Settings of a run; each extractor, selector and model is a name or a dict with `name` and parameters."""

    task_type: str = "classification"
    extractors: list = field(default_factory=lambda: ["compact", "minimal", "statistics_sample"])
    selectors: list = field(default_factory=lambda: ["none", "fdr", "select_k_best"])
    models: list = field(default_factory=lambda: ["random_forest"])
    seeds: list = field(default_factory=lambda: [42])
    n_splits: int = 5
    trees: int = 100
    test_size: float = 0.2
    lower: float = 0.05
    upper: float = 0.95
    resume: bool = True

    def to_json(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))

    @classmethod
    def from_json(cls, path: str) -> MatrixConfig:
        return cls(**json.loads(Path(path).read_text()))

    @classmethod
    def from_yaml(cls, path: str) -> MatrixConfig:
        import yaml

        return cls(**yaml.safe_load(Path(path).read_text()))


def configuration_table(datasets: DataFrame, choices: Mapping[str, Sequence]) -> DataFrame:
    """One row per dataset and combination of the listed choices."""
    out = datasets
    for name, values in choices.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def _split_spec(spec) -> tuple[str, dict]:
    if spec is None:
        return "none", {}
    if isinstance(spec, str):
        return ("none" if spec == "None" else spec), {}
    params = dict(spec)
    name = params.pop("name")
    return name, {k: v for k, v in (params | params.pop("kwargs", {})).items() if k != "kwargs"}


def build_roles(targets: DataFrame, config: MatrixConfig, seed: int) -> DataFrame:
    """(id, fold, role): a given split or the last part in id order for forecasts; folds by group if
    there is a group column; otherwise stratified or plain shuffled folds."""
    if config.task_type == "forecasting":
        order = None if "split" in targets.columns else [ID]
        roles = splits.holdout(targets, config.test_size, order=order)
        return roles.withColumn("fold", F.lit(0)).select(ID, "fold", "role")
    k = config.n_splits
    classes = config.task_type == "classification"
    group = splits.group_column(targets)
    if group:
        folds = splits.group_k_fold(targets, k, group, seed=seed, target="target" if classes else None)
    elif classes:
        folds = splits.stratified_k_fold(targets, k, seed=seed)
    else:
        folds = splits.k_fold(targets, k, seed=seed)
    return splits.fold_roles(folds, k).join(
        folds.select("fold").distinct(), "fold", "left_semi"
    ).select(ID, "fold", "role")


class Matrix:
    """Runs every cell that the result table does not have yet and appends one row per cell."""

    def __init__(self, spark: SparkSession, config: MatrixConfig, output: str, store: FeatureStore):
        self.spark, self.config, self.store = spark, config, store
        self.results_path = f"{output.rstrip('/')}/results"
        self.run_id = uuid.uuid4().hex[:12]

    def results(self) -> DataFrame:
        if not path_exists(self.spark, self.results_path):
            return self.spark.createDataFrame([], RESULT_SCHEMA)
        return self.spark.read.schema(RESULT_SCHEMA).parquet(self.results_path)

    def cells(self, datasets: Sequence[str]) -> DataFrame:
        """The configured cells less the completed ones, keyed by every setting with its parameters."""
        c = self.config
        names = self.spark.createDataFrame([(d,) for d in datasets], "dataset string")
        as_text = [json.dumps(s, sort_keys=True) for s in c.extractors]
        table = configuration_table(
            names,
            {
                "seed": c.seeds,
                "extractor": as_text,
                "selector": [json.dumps(s, sort_keys=True) for s in c.selectors],
                "model": [json.dumps(m, sort_keys=True) for m in c.models],
            },
        )
        extra = parameter_hash({k: v for k, v in asdict(c).items() if k in ("task_type", "n_splits", "trees", "test_size", "lower", "upper")})
        key = F.sha2(F.concat_ws("|", *table.columns, F.lit(extra)), 256)
        table = table.withColumn("cell", F.substring(key, 1, 16))
        if c.resume:
            table = table.join(self.results().select("cell"), "cell", "left_anti")
        return table

    def run(self, datasets: Mapping[str, Callable[[], tuple[DataFrame, DataFrame]]]) -> DataFrame:
        """`datasets` maps names to loaders of (sequences, targets)."""
        todo = self.cells(list(datasets)).orderBy("dataset", "extractor", "seed", "selector", "model").collect()
        loaded: dict = {}
        for name, extractor, seed, selector in dict.fromkeys(
            (r["dataset"], r["extractor"], r["seed"], r["selector"]) for r in todo
        ):
            if loaded.get("key") != (name, extractor):
                sequences, targets = datasets[name]()
                features, cached, seconds = self._extract(name, json.loads(extractor), sequences)
                # Every fold of every cell reads the targets and the names.
                loaded = {
                    "key": (name, extractor), "features": features, "targets": cut_lineage(targets), "cached": cached,
                    "s": seconds, "n": features.select("feature").distinct().count(),
                }
            ready = self._select(loaded, json.loads(selector), seed)
            mine = [r for r in todo if (r["dataset"], r["extractor"], r["seed"], r["selector"]) == (name, extractor, seed, selector)]
            for row in mine:
                self._append(self._evaluate(row, loaded, ready))
        return self.results()

    def _extract(self, dataset: str, spec, sequences: DataFrame):
        name, params = _split_spec(spec)
        # Other data or another version of the set is another entry of the store.
        provenance = {"version": extractor_version(extractor_name(name)), "dataset_hash": frame_fingerprint(sequences)}
        start = time.perf_counter()
        features, cached = self.store.get_or_compute(
            dataset, name, lambda: extract(sequences, name, **params), params, **provenance
        )
        if self.store.backend == "none":
            features = cut_lineage(features)
        return features, cached, time.perf_counter() - start

    def _select(self, loaded: dict, spec, seed: int) -> dict:
        """Masks per fold, fitted on the train rows and shared by all models."""
        name, params = _split_spec(spec)
        features, targets, task = loaded["features"], loaded["targets"], self.config.task_type
        # Folds feed many jobs: fix them once.
        roles = cut_lineage(build_roles(targets, self.config, seed))
        labels = horizon_vector(targets) if task == "forecasting" else targets
        masks, fallback, seconds, sizes = {}, False, 0.0, []
        folds = sorted(r[0] for r in roles.select("fold").distinct().collect())
        for fold in folds:
            start = time.perf_counter()
            train = roles.filter((F.col("fold") == fold) & (F.col("role") == "train")).select(ID)
            part = features.join(train, ID, "left_semi")
            inner = "regression" if task == "forecasting" else task
            mask = selection.run_selector(
                name, part, labels.join(train, ID, "left_semi"), inner, random_state=seed, **params
            )
            mask = cut_lineage(mask.select("feature", "selected"))
            used, info = selection.with_fallback(mask)
            masks[fold] = used.filter("selected").select("feature")
            fallback |= info["fallback_triggered"]
            sizes.append(info["n_selected_features"])
            seconds += time.perf_counter() - start
        return {
            "name": name, "roles": roles, "labels": labels, "masks": masks, "fallback": fallback,
            "seconds": seconds / len(folds), "total_seconds": seconds, "n": sum(sizes) / len(sizes),
        }

    def _stability(self, ready: dict) -> float:
        if ready["name"] == "none":
            return 1.0
        if ready["fallback"]:
            return 0.0
        picked = None
        for fold, mask in ready["masks"].items():
            part = mask.withColumn("fold", F.lit(fold))
            picked = part if picked is None else picked.unionByName(part)
        return round(compare.selection_stability(picked).first()["jaccard"], 4)

    def _evaluate(self, row, loaded: dict, ready: dict) -> dict:
        c = self.config
        features, n_all = loaded["features"], loaded["n"]
        model_name, model_params = _split_spec(json.loads(row["model"]))
        model = {"name": model_name} | model_params
        n_test, parts, metrics, timings = 0, None, [], {}
        for fold, mask in ready["masks"].items():
            kept = features.join(mask, "feature", "left_semi")
            roles = ready["roles"].filter(F.col("fold") == fold)
            if c.task_type == "forecasting":
                scored = models.direct_forecast(
                    kept, ready["labels"], roles, model, c.lower, c.upper, row["seed"], c.trees, timings
                )
            else:
                scored = models.cross_validate(
                    kept, ready["labels"], roles, model, c.task_type, row["seed"], c.trees, timings
                )
            n_test += scored.count()
            if c.task_type == "classification":
                metrics.append(models.accuracy(scored).first().asDict())
            elif c.task_type == "regression":
                metrics.append(models.error_metrics(scored).first().asDict())
            else:
                metrics.append(models.forecast_metrics(scored).first().asDict())
            parts = scored if parts is None else parts.unionByName(scored)
        k = len(metrics)
        fit_s, predict_s = timings["fit_s"], timings["predict_s"]
        out = {m: sum(r[m] for r in metrics) / k for m in METRICS[c.task_type]}
        if c.task_type == "regression":
            pooled = models.error_metrics(parts).first()
            out |= {f"pooled_{m}": pooled[m] for m in ("rmse", "mae", "r2")}
        if c.task_type == "forecasting":
            per = models.forecast_metrics(parts, per_horizon=True).orderBy("horizon").collect()
            out["horizons"] = json.dumps([r.asDict() for r in per])
        name, params = _split_spec(json.loads(row["extractor"]))
        cached = loaded["cached"]
        total = (0.0 if cached else loaded["s"]) + ready["total_seconds"] + fit_s + predict_s
        return out | {
            "run_id": self.run_id, "cell": row["cell"], "dataset": row["dataset"], "task": c.task_type, "seed": row["seed"],
            "extractor": name, "extractor_params": json.dumps(params, sort_keys=True), "selector": ready["name"],
            "model": model_name, "model_params": json.dumps(model_params, sort_keys=True), "is_cached": cached, "fallback_triggered": ready["fallback"], "n_extracted": n_all,
            "n_selected": float(ready["n"]),
            "reduction_pct": 0.0 if ready["fallback"] else round((1 - ready["n"] / max(1, n_all)) * 100, 2),
            "stability": self._stability(ready), "extraction_s": None if cached else loaded["s"],
            "selection_s": ready["seconds"], "fit_s": fit_s / k, "predict_s": predict_s / k,
            "ms_per_row": predict_s / max(1, n_test) * 1000, "total_s": None if cached else total,
        }

    def _append(self, record: dict) -> None:
        names = [f.strip().split()[0] for f in RESULT_SCHEMA.split(",")]
        record = record | {"saved_at": datetime.now(UTC)}
        row = tuple(record.get(n) for n in names)
        self.spark.createDataFrame([row], RESULT_SCHEMA).write.mode("append").parquet(self.results_path)


def inventory(results: DataFrame) -> DataFrame:
    """One row per run: cells, datasets, tasks and total time."""
    return results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.countDistinct("dataset").alias("n_datasets"),
        F.array_join(F.sort_array(F.collect_set("task")), ",").alias("tasks"),
        F.sum("total_s").alias("total_s"),
    )


def analyse(results: DataFrame, task_type: str, alpha: float = 0.05) -> dict[str, DataFrame]:
    """Summaries and paired tests of the quality and cost of one task: by extractor, selector and their combination."""
    rows = results.filter(F.col("task") == task_type).select(
        *[null_label(c).alias(n) for c, n in (("dataset", "Dataset"), ("extractor", "Extractor"), ("selector", "Selector"))],
        # Settings other than a model's own are part of its name.
        F.when(F.coalesce("model_params", F.lit("{}")) == "{}", null_label("model")).otherwise(F.concat_ws(" ", "model", "model_params")).alias("Model"),
        F.col("seed").alias("Seed"),
        "is_cached",
        "saved_at",
        *[F.col(c).alias(n) for c, n in METRIC_LABELS.items()],
    )
    rows = rows.withColumn("Combination", F.concat_ws(" + ", "Extractor", "Selector"))
    quality = [METRIC_LABELS[m] for m in METRICS[task_type]]
    cost = [METRIC_LABELS[m] for m in ("selection_s", "total_s", "n_selected")]
    out = {}
    for group in ("Extractor", "Selector", "Combination"):
        out[f"summary:{group}"] = aggregate.summary_statistics(rows, [group], quality + cost)
        for metric in quality + cost:
            # Of a cell that was run again the last result counts.
            out[f"tests:{group}:{metric}"] = compare.pairwise_tests(rows, group, metric, alpha, order=["saved_at"])
        out[f"ranks:{group}:{quality[0]}"] = compare.average_ranks(rows, quality[0], group, "Dataset")
    return out


def run_stages(
    spark, stages: Mapping[str, tuple[MatrixConfig, Mapping[str, Callable[[], tuple[DataFrame, DataFrame]]]]], folder: str, store: FeatureStore
) -> DataFrame:
    """Run configurations one after the other, each with its data sets; their results together, by stage. A stage that
    fails stops the sequence; what earlier stages wrote stays and is not run again."""
    out = None
    for name, (config, datasets) in stages.items():
        results = Matrix(spark, config, f"{folder}/{name}", store).run(datasets).withColumn("stage", F.lit(name))
        out = results if out is None else out.unionByName(results)
    return out
