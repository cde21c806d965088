"""Selectors that fit a Spark ML model on the assembled feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expr import sanitise
from tidemark.functions.special import binomial_upper
from tidemark.operators import lasso, random_trees, shadow_forests
from tidemark.operators.splits import sample_rows
from tidemark.session import Scratch, cut_lineage, require_small

ID = "sequence_id"


def feature_names(features: DataFrame) -> list[str]:
    """Sorted feature names; their number is checked, since a vector must hold them all."""
    names = features.select("feature").distinct()
    require_small(names, "the list of features")
    return sorted(r[0] for r in names.collect())


def assemble(features: DataFrame, names: Sequence[str], id_col: str = ID) -> DataFrame:
    """(id, features) vectors in the order of `names`; missing features are 0."""
    # The names are size-checked where they are listed.
    places = features.sparkSession.createDataFrame(list(enumerate(names)), "__i int, feature string")
    cells = features.join(F.broadcast(places), "feature")
    cells = cells.select(id_col, F.struct("__i", sanitise("value").alias("__v")).alias("__c"))
    rows = cells.groupBy(id_col).agg(F.collect_list("__c").alias("__m"))
    present = F.transform("__m", lambda c: c["__i"])
    missing = F.array_except(F.sequence(F.lit(0), F.lit(len(names) - 1)), present)
    zeros = F.transform(missing, lambda i: F.struct(i.alias("__i"), F.lit(0.0).alias("__v")))
    dense = F.transform(F.array_sort(F.concat("__m", zeros)), lambda c: c["__v"])
    return rows.select(id_col, array_to_vector(dense).alias("features"))


def indexed_target(targets: DataFrame, task_type: str) -> DataFrame:
    """(id, target, label): class targets as 0..K-1 in value order, real targets as they are."""
    if task_type == "regression":
        return targets.select(ID, "target", F.col("target").cast("double").alias("label"))
    classes = targets.select("target").distinct()
    require_small(classes, "the list of classes")
    values = sorted(r[0] for r in classes.collect() if r[0] is not None)
    kind = targets.schema["target"].dataType
    schema = T.StructType([T.StructField("target", kind), T.StructField("label", T.DoubleType())])
    labels = targets.sparkSession.createDataFrame([(c, float(i)) for i, c in enumerate(values)], schema)
    return targets.select(ID, "target").join(F.broadcast(labels), "target").select(ID, "target", "label")


def training_rows(features: DataFrame, targets: DataFrame, names: Sequence[str], task_type: str) -> DataFrame:
    return assemble(features, names).join(indexed_target(targets, task_type), ID)


def _mask(features: DataFrame, names, scores, keep) -> DataFrame:
    rows = [(n, float(s), bool(k)) for n, s, k in zip(names, scores, keep)]
    return features.sparkSession.createDataFrame(rows, "feature string, score double, selected boolean")


def l1_selector(
    features: DataFrame,
    targets: DataFrame,
    C: float = 1.0,
    alpha: float = 0.01,
    task_type: str = "classification",
) -> DataFrame:
    """Features with a non-zero coefficient in an L1 model on standardised values, found by coordinate descent on summed cross
    products; Spark's own solver takes over above `lasso.MAX_FEATURES` features, whose cross products no driver need hold."""
    names = feature_names(features)
    rows = training_rows(features, targets, names, task_type)
    if task_type != "regression" and rows.select("label").distinct().limit(2).count() < 2:
        return _mask(features, names, np.zeros(len(names)), np.zeros(len(names)))
    if len(names) <= lasso.MAX_FEATURES:
        # Read once a pass, so the vectors are built once.
        model = lasso.fit_l1(cut_lineage(rows.select("features", "label")), task_type, C, alpha)
        scores = np.abs(model.coefficients).sum(axis=0)
        return _mask(features, names, scores, scores > 1e-5)
    rows = rows.persist()
    try:
        spread = rows.select(F.explode(_indexed(rows)).alias("s")).groupBy("s.i").agg(F.stddev_pop("s.v").alias("sd"))
        sd = {r["i"]: r["sd"] or 0.0 for r in spread.collect()}
        scales = np.array([sd.get(i, 0.0) for i in range(len(names))])
        if task_type == "regression":
            model = LinearRegression(elasticNetParam=1.0, regParam=alpha, maxIter=500, tol=1e-6).fit(rows)
            weights = np.abs(model.coefficients.toArray())
        else:
            model = LogisticRegression(elasticNetParam=1.0, regParam=1.0 / (C * rows.count()), maxIter=100, tol=1e-4).fit(rows)
            weights = np.abs(model.coefficientMatrix.toArray()).sum(axis=0)
    finally:
        rows.unpersist()
    scores = weights * np.where(scales > 0, scales, 0.0)
    return _mask(features, names, scores, scores > 1e-5)


def _indexed(rows: DataFrame):
    from pyspark.ml.functions import vector_to_array

    return F.transform(vector_to_array("features"), lambda v, i: F.struct(i.alias("i"), v.alias("v")))


def forest(task_type: str, trees: int, seed: int, depth: int = 5):
    kind = RandomForestRegressor if task_type == "regression" else RandomForestClassifier
    return kind(numTrees=trees, seed=seed, maxDepth=depth)


def tree_importance(
    features: DataFrame,
    targets: DataFrame,
    n_estimators: int = 50,
    threshold: str | float = "median",
    task_type: str = "classification",
    random_state: int = 42,
    model_type: str = "extra_trees",
    depth: int | None = None,
) -> DataFrame:
    """Features whose importance in extremely randomised trees (or a "random_forest") reaches the median, the mean or a number."""
    if model_type not in ("extra_trees", "random_forest"):
        raise ValueError(f"unknown model type {model_type}")
    names = feature_names(features)
    rows = training_rows(features, targets, names, task_type)
    if model_type == "extra_trees":
        # Read twice a level, so the vectors are built once.
        rows = cut_lineage(rows.select("features", "label"))
        classes = 0 if task_type == "regression" else int(rows.agg(F.max("label")).first()[0] or 0) + 1
        scores = random_trees.fit_extra_trees(rows, classes, n_estimators, random_state, depth).importances
    else:
        scores = forest(task_type, n_estimators, random_state, 30 if depth is None else depth).fit(rows).featureImportances.toArray()
    cut = {"median": np.median, "mean": np.mean}[threshold](scores) if isinstance(threshold, str) else threshold
    return _mask(features, names, scores, scores >= cut)


def binomial_tail(hits: np.ndarray, rounds: int) -> np.ndarray:
    """P(X >= hits) for fair draws."""
    return binomial_upper(np.asarray(hits, float), float(rounds))


def _step_up(p: np.ndarray, level: float) -> np.ndarray:
    order = np.argsort(p)
    ok = p[order] <= level * np.arange(1, len(p) + 1) / len(p)
    out = np.zeros(len(p), bool)
    if ok.any():
        out[order[: np.flatnonzero(ok)[-1] + 1]] = True
    return out


def boruta(
    features: DataFrame,
    targets: DataFrame,
    n_estimators: int = 50,
    max_iter: int = 20,
    max_samples: int | None = None,
    random_state: int = 42,
    task_type: str = "classification",
    level: float = 0.05,
) -> DataFrame:
    """All-relevant selection: a feature stays if it beats the best shuffled copy more often than
    chance. Each round fits one forest on the undecided and accepted features and their shadows.

    All sequences are looked at, or `max_samples` of them if that is given.
    """
    if max_samples is not None:
        targets = cut_lineage(sample_rows(targets, max_samples, ID, random_state))
    names = feature_names(features)
    known = indexed_target(targets, task_type).select(ID, "label")
    if task_type == "regression":
        if not known.where("label IS NULL OR isnan(label) OR abs(label) = double('infinity')").isEmpty():
            raise ValueError("a target is no finite number")
        classes, labels = 0, known
    else:
        classes = int(known.agg(F.max("label")).first()[0] or 0) + 1
        # A feature of sequences without a target is listed, though no forest sees it.
        labels = known.union(targets.where("target IS NULL").select(ID, F.lit(None).cast("double")))
    with Scratch(features.sparkSession) as scratch:
        blocks = shadow_forests.coded_blocks(scratch, features, labels, names, classes, ID)
        place = dict(zip(names, range(len(names))))
        names = [n for n in names if blocks.seen[place[n]]]
        hits = dict.fromkeys(names, 0)
        decided: dict[str, bool] = {}
        scores = dict.fromkeys(names, 0.0)
        rows = None
        for turn in range(1, max_iter + 1):
            live = [n for n in names if decided.get(n, True)]
            if not live:
                break
            # A fit reads its rows several times: the shadows are dealt once.
            dealt = shadow_forests.with_shadows(blocks, [place[n] for n in live], random_state + turn)
            rows = scratch.cut(dealt, *([] if rows is None else [rows]))
            gains = shadow_forests.importances(rows, blocks, 2 * len(live), n_estimators, random_state + turn)
            bar = gains[len(live) :].max()
            for n, g in zip(live, gains):
                scores[n] = float(g)
                hits[n] += int(g > bar)
            open_names = [n for n in live if n not in decided]
            if not open_names:
                break
            h = np.array([hits[n] for n in open_names])
            up = binomial_tail(h, turn)
            down = 1 - binomial_tail(h + 1, turn)
            accept = _step_up(up, level) & (up <= level / turn)
            reject = _step_up(down, level) & (down <= level / turn)
            for n, a, r in zip(open_names, accept, reject):
                if a or r:
                    decided[n] = bool(a)
            if not any(n not in decided for n in names):
                break
    keep = [decided.get(n, False) for n in names]
    return _mask(features, names, [scores[n] for n in names], keep)
