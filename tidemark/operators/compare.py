"""Comparison of pipelines: paired tests, ranks, stability, calibration and parity.

Result tables are keyed by method and pairing key. After duplicates are merged a
pairing key holds at most one row per method, and the number of methods is
checked, so the method-against-method join grows with the table only by that
bounded factor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import horizon_columns, ratio, sanitise
from tidemark.functions.special import normal_p, signed_rank_p, student_p
from tidemark.operators.aggregate import mean_interval
from tidemark.operators.position import fits_one_task, value_ranks, with_position
from tidemark.operators.selection import adjust_p_values
from tidemark.session import require_small

# Metrics for which smaller is better (fixed names).
LOWER_IS_BETTER = (
    "Extraction Time",
    "Selection Time",
    "Prediction Time",
    "Total Time",
    "Extraction Time (s)",
    "Selection Time (s)",
    "Prediction Time (s)",
    "Total Time (s)",
    "Extraction Peak RAM (MB)",
    "Extraction Peak RAM Increase (MB)",
    "Selection Peak RAM (MB)",
    "RMSE",
    "MAE",
    "Forecast RMSE",
    "Forecast MAE",
    "Mean Interval Width",
    "N Extracted Features",
    "N Selected Features",
    "fit_time_seconds",
    "inference_latency_ms",
    "Fit Time (s)",
    "Inference Latency (ms)",
    "Tau RMSE",
    "Tau MAE",
)
# Columns that may identify a measurement, in order of preference, and the name for no winner.
PAIR_KEYS = ("Dataset", "Seed", "Fold", "Task", "Selector", "Model", "Extractor")
NO_WINNER = "No Statistically Significant Difference"
MAX_METHODS = 500


def metric_direction(metric: str) -> str:
    return "lower" if metric in LOWER_IS_BETTER else "higher"


def direction_column(metric: Column) -> Column:
    return F.when(metric.isin(*LOWER_IS_BETTER), "lower").otherwise("higher")


def pair_keys_for(columns: Sequence[str], group_col: str) -> list[str]:
    dropped = {group_col}
    if group_col == "Combination":
        dropped |= {"Extractor", "Selector"}
    return [c for c in PAIR_KEYS if c in columns and c not in dropped]


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last by the order columns; combines on the map side."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(newest).select(*keys, "__row.*").select(*df.columns)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The k first rows of each group; Spark limits every group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")


def paired_rows(
    df: DataFrame, group_col: str, metric: str, pair_keys: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """(pair keys, group_1, group_2, x, y) for every pair of methods measured under the same key. Of several rows of a
    method and key the last by `order` counts; without an order there must be one, since any choice would be a bias."""
    rows = df.filter(F.col(f"`{metric}`").isNotNull() & F.col(f"`{group_col}`").isNotNull())
    rows = rows.select(
        F.col(f"`{group_col}`").cast("string").alias("__g"),
        *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("none")).alias(f"__k{i}") for i, k in enumerate(pair_keys)],
        F.col(f"`{metric}`").cast("double").alias("__v"),
        *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)],
    )
    keys = [f"__k{i}" for i in range(len(pair_keys))]
    if order:
        last = F.max_by("__v", F.struct(*[f"__o{i}" for i in range(len(order))]))
    else:
        several = F.raise_error("several rows of one method and key: state the order of rows").cast("double")
        last = F.when(F.count(F.lit(1)) > 1, several).otherwise(F.max("__v"))
    rows = rows.groupBy("__g", *keys).agg(last.alias("__v"))
    if require_small(rows.select("__g").distinct(), "the list of methods") > MAX_METHODS:
        raise ValueError(f"more than {MAX_METHODS} methods to compare")
    left = rows.select(*keys, F.col("__g").alias("group_1"), F.col("__v").alias("x"))
    right = rows.select(*keys, F.col("__g").alias("group_2"), F.col("__v").alias("y"))
    if not keys:
        raise ValueError("no pairing key; use positional_pairs")
    return left.join(right, keys).filter(F.col("group_1") < F.col("group_2"))


def positional_pairs(df: DataFrame, group_col: str, metric: str, order: Sequence[str], first, second) -> DataFrame:
    """Rows of two methods matched by their place in the given order, up to the shorter one."""
    rows = df.filter(F.col(metric).isNotNull())
    ranked = with_position(rows, [group_col], list(order), "__p")
    left = ranked.filter(F.col(group_col) == F.lit(first)).select("__p", F.col(metric).alias("x"))
    right = ranked.filter(F.col(group_col) == F.lit(second)).select("__p", F.col(metric).alias("y"))
    return left.join(right, "__p").withColumnRenamed("__p", "position")


def cohens_d(diff: Column) -> Column:
    return ratio(F.avg(diff), F.stddev_samp(diff))


def paired_t_tests(pairs: DataFrame, keys: Sequence[str] = ("group_1", "group_2")) -> DataFrame:
    """N, means, Cohen's d, t and p of each pair of methods with at least two matched rows."""
    d = F.col("x") - F.col("y")
    sums = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg("x").alias("mean_1"),
        F.avg("y").alias("mean_2"),
        F.avg(d).alias("mean_difference"),
        cohens_d(d).alias("cohens_d"),
        F.stddev_samp(d).alias("__sd"),
    )
    t = F.try_divide(F.col("mean_difference") * F.sqrt("n_pairs"), F.col("__sd"))
    sums = sums.filter("n_pairs >= 2").withColumn("t_statistic", t).drop("__sd")
    return sums.withColumn("p_value", student_p(F.col("t_statistic"), F.col("n_pairs") - 1))


def pairwise_tests(
    df: DataFrame,
    group_col: str,
    metric: str,
    alpha: float = 0.05,
    pair_keys: Sequence[str] | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """Every pair of methods: paired t-test, winner by metric direction, step-up correction."""
    if "is_cached" in df.columns and ("Extraction" in metric or "Total Time" in metric):
        df = df.filter(~F.coalesce(F.col("is_cached"), F.lit(False)))
    pair_keys = pair_keys_for(df.columns, group_col) if pair_keys is None else list(pair_keys)
    tests = paired_t_tests(paired_rows(df, group_col, metric, pair_keys, order))
    tests = adjust_p_values(tests, "p_value", alpha)
    better = F.col("mean_difference") > 0
    if metric_direction(metric) == "lower":
        better = F.col("mean_difference") < 0
    winner = F.when(F.col("p_value").isNull(), "N/A").when(better, F.col("group_1")).otherwise(F.col("group_2"))
    tests = tests.withColumns({"metric": F.lit(metric), "winner": winner})
    return tests.withColumn("final_winner", F.when(F.col("significant"), F.col("winner")).otherwise(NO_WINNER))


# --- ranks ---------------------------------------------------------------------------------------


def method_matrix(df: DataFrame, metric: str, method: str, dataset: str) -> DataFrame:
    """(dataset, method, value) over the datasets that every method with any value has."""
    cells = df.groupBy(dataset, method).agg(F.avg(metric).alias("value")).filter("value IS NOT NULL")
    n_methods = require_small(cells.select(method).distinct(), "the list of methods")
    complete = cells.groupBy(dataset).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == n_methods)
    return cells.join(complete.select(dataset), dataset, "left_semi")


def dataset_ranks(df: DataFrame, metric: str, method: str, dataset: str) -> DataFrame:
    """Average-tie rank of each method within each common dataset, best first."""
    cells = method_matrix(df, metric, method, dataset)
    by = F.col("value") if metric_direction(metric) == "lower" else F.col("value").desc()
    # A dataset holds one row per method.
    order = Window.partitionBy(dataset).orderBy(by)
    ties = Window.partitionBy(dataset, "value")
    rank = F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2
    return cells.withColumn("rank", rank)


def average_ranks(df: DataFrame, metric: str, method: str, dataset: str) -> DataFrame:
    ranks = dataset_ranks(df, metric, method, dataset)
    return ranks.groupBy(method).agg(F.avg("rank").alias("avg_rank"), F.count(F.lit(1)).alias("n_datasets"))


def rank_significance(df: DataFrame, metric: str, method: str, dataset: str, alpha: float = 0.05) -> DataFrame:
    """Signed-rank test per pair of methods over the common datasets (paired t-test below five
    datasets); a pair that never differs is not significant."""
    cells = method_matrix(df, metric, method, dataset)
    pairs = paired_rows(cells, method, "value", [dataset])
    d = F.col("x") - F.col("y")
    pairs = pairs.withColumns({"d": d, "size": F.abs(d)})
    keys = ["group_1", "group_2"]
    moved = pairs.filter("d <> 0")
    ranks = value_ranks(moved, keys, "size", F.col("d") > 0)
    t = F.col("n").cast("double")
    sums = ranks.groupBy(*keys).agg(
        F.sum(F.col("n1") * F.col("avg_rank")).alias("plus"),
        F.sum(t * t * t - t).alias("ties"),
        F.sum(t).alias("n"),
    )
    n, plus = F.col("n"), F.col("plus")
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    z = F.try_divide(plus - n * (n + 1) / 4, spread)
    counted = paired_t_tests(pairs).select(*keys, "n_pairs", F.col("p_value").alias("t_p"))
    out = counted.join(sums, keys, "left")
    exact = (F.col("n") <= 50) & (F.col("ties") == 0) & (F.col("n") == F.col("n_pairs"))
    w = F.least(plus, n * (n + 1) / 2 - plus)
    p = F.when(exact, signed_rank_p(F.when(exact, w), n)).otherwise(normal_p(z))
    out = out.withColumn("p_value", F.when(F.col("n_pairs") >= 5, p).otherwise(F.col("t_p")))
    out = out.withColumn("p_value", F.when(n.isNull(), F.lit(None).cast("double")).otherwise(F.col("p_value")))
    return out.select(*keys, "n_pairs", "plus", "p_value", F.coalesce(F.col("p_value") < alpha, F.lit(False)).alias("significant"))


def rank_cliques(ranks: DataFrame, tests: DataFrame, method: str) -> list[list[str]]:
    """Maximal runs of methods, in rank order, without a significant pair. Both tables are small
    (one row per method and per pair) and size-checked."""
    require_small(ranks, "the list of methods")
    require_small(tests, "the list of method pairs")
    names = [r[0] for r in ranks.orderBy("avg_rank", method).select(method).collect()]
    apart = {frozenset(r) for r in tests.filter("significant").select("group_1", "group_2").collect()}
    runs, reach = [], -1
    for i in range(len(names)):
        j = i
        while j + 1 < len(names) and all(frozenset((names[a], names[j + 1])) not in apart for a in range(i, j + 1)):
            j += 1
        if j > i and j > reach:
            runs.append(names[i : j + 1])
        reach = max(reach, j)
    return runs


# --- selection stability -------------------------------------------------------------------------


def selection_frequency(selected: DataFrame, k: int = 10) -> DataFrame:
    """The k features picked in most folds."""
    counts = selected.groupBy("feature").agg(F.count(F.lit(1)).alias("n_folds"))
    return counts.orderBy(F.desc("n_folds"), "feature").limit(k)


def channel_counts(mask: DataFrame) -> DataFrame:
    """Selected features per channel of `<channel>__<feature>` names."""
    channel = F.get(F.split("feature", "__"), F.lit(0))
    return mask.filter("selected").groupBy(channel.alias("channel")).agg(F.count(F.lit(1)).alias("n_selected"))


def selection_stability(selected: DataFrame) -> DataFrame:
    """Mean Jaccard similarity over all pairs of folds of (fold, feature). A feature has at most
    one row per fold, so the pair counts come from a join bounded by the number of folds."""
    a = selected.select(F.col("fold").alias("f1"), "feature")
    b = selected.select(F.col("fold").alias("f2"), "feature")
    common = a.join(b, "feature").filter("f1 < f2").groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("common"))
    sizes = selected.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    # Sum over fold pairs: pairs without a common feature add 0.
    n_folds = sizes.agg(F.count(F.lit(1)).alias("k"))
    joined = (
        common.join(sizes.select(F.col("fold").alias("f1"), F.col("n").alias("n1")), "f1")
        .join(sizes.select(F.col("fold").alias("f2"), F.col("n").alias("n2")), "f2")
        .agg(F.coalesce(F.sum(F.col("common") / (F.col("n1") + F.col("n2") - F.col("common"))), F.lit(0.0)).alias("s"))
    )
    k = n_folds.select("k").scalar()
    pairs = k * (k - 1) / 2
    return joined.select(F.when(pairs > 0, F.col("s") / pairs).otherwise(F.lit(1.0)).alias("jaccard"))


def feature_reduction(selected: Column, initial: Column) -> Column:
    return (1 - selected / F.greatest(initial, F.lit(1))) * 100


def truth_match(selected: DataFrame, truth: DataFrame, universe: DataFrame, keys: Sequence[str]) -> DataFrame:
    """True and false positives, misses, false discovery proportion and power of each run against
    the planted features. `universe` has the features on offer; `keys` name a run."""
    offered = universe.select("feature").distinct()
    planted = offered.join(truth.select("feature").distinct().withColumn("planted", F.lit(True)), "feature", "left")
    n_planted = planted.agg(F.count("planted").alias("n")).scalar()
    hits = selected.join(planted, "feature", "left").groupBy(*keys).agg(
        F.count("planted").alias("tp"), F.count_if(F.col("planted").isNull()).alias("fp")
    )
    return hits.withColumns(
        {
            "fn": n_planted - F.col("tp"),
            "fdp": ratio(F.col("fp"), F.col("fp") + F.col("tp")),
            "power": ratio(F.col("tp"), n_planted),
        }
    )


# --- tables behind the reports --------------------------------------------------------------------


def horizon_profile(df: DataFrame, method: str, metrics: Sequence[str]) -> DataFrame:
    """mean and std per (method, metric, horizon) from columns such as `RMSE_H1` or `RMSE H1`.

    Where a horizon is spelt twice the variant with fewer nulls is taken.
    """
    found = {(m, h): cs for m in metrics for h, cs in horizon_columns(df.columns, m).items()}
    if not found:
        raise KeyError(f"no horizon columns for {list(metrics)}")
    doubled = [c for cs in found.values() if len(cs) > 1 for c in cs]
    nulls = {}
    if doubled:
        nulls = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in doubled]).first().asDict()
    picked = {k: min(cs, key=lambda c: (nulls.get(c, 0), c)) for k, cs in found.items()}
    cells = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.lit(h).alias("horizon"), F.col(f"`{c}`").cast("double").alias("v"))
            for (m, h), c in picked.items()
        ]
    )
    long = df.select(method, F.explode(cells).alias("c")).select(method, "c.*")
    return long.groupBy(method, "metric", "horizon").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))


def forecast_summary(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean truth, prediction and interval ends per key and horizon, from long predictions
    (keys, horizon, truth, prediction, lower, upper)."""
    return predictions.groupBy(*keys, "horizon").agg(
        *[F.avg(c).alias(f"mean_{c}") for c in ("truth", "prediction", "lower", "upper")]
    )


def tolerance_join(conditions: DataFrame, rows: DataFrame, on: str, value: str, eps: float = 1e-10) -> DataFrame:
    """Mean of `value` over the rows whose `on` lies within eps of each condition; null if none.

    Rows are summed per exact `on` first, then met through buckets of width 2 * eps, so the range
    condition becomes an equi-join with at most two buckets per condition.
    """
    sums = rows.groupBy(on).agg(F.sum(value).alias("__s"), F.count(value).alias("__c"))
    width = 2 * eps
    sums = sums.select(F.col(on).alias("__on"), "__s", "__c", F.floor(F.col(on) / width).alias("__b"))
    wanted = conditions.select(on).distinct()
    spans = wanted.withColumn(
        "__b", F.explode(F.sequence(F.floor((F.col(on) - eps) / width), F.floor((F.col(on) + eps) / width)))
    )
    near = spans.join(sums, "__b").filter(F.abs(F.col(on) - F.col("__on")) <= eps)
    means = near.groupBy(on).agg(F.try_divide(F.sum("__s"), F.sum("__c")).alias("mean_value"))
    return wanted.join(means, on, "left")


def null_calibration(df: DataFrame, keys: Sequence[str], p: str, alphas: Sequence[float] = (0.05, 0.01)) -> DataFrame:
    """Share of p below each level, undefined p, and the distance of p from the uniform."""
    known = F.col(p).isNotNull() & ~F.isnan(p)
    rates = df.groupBy(*keys).agg(
        F.count_if(known).alias("n"),
        F.count_if(~known).alias("n_undefined"),
        *[F.avg(F.when(known, (F.col(p) < a).cast("double"))).alias(f"rate_{str(a).replace('.', '_')}") for a in alphas],
    )
    ranks = value_ranks(df.filter(known), keys, p)
    above = (F.col("n_before") + F.col("n")) / F.col("n_total") - F.col(p)
    below = F.col(p) - F.col("n_before") / F.col("n_total")
    gaps = ranks.groupBy(*keys).agg(F.max(F.greatest(above, below)).alias("uniform_distance"))
    return rates.join(gaps, list(keys), "left") if keys else rates.crossJoin(gaps)


def leakage_gap(scores: DataFrame, keys: Sequence[str], by: Sequence[str], shuffled: str, blocked: str) -> DataFrame:
    """Score under shuffled folds less the score under blocked folds, mean and interval per `by`."""
    s = scores.filter(F.col("strategy") == shuffled).select(*keys, F.col("score").alias("__s"))
    b = scores.filter(F.col("strategy") == blocked).select(*keys, F.col("score").alias("__b"))
    gaps = s.join(b, list(keys)).withColumn("gap", F.col("__s") - F.col("__b"))
    return mean_interval(gaps, by, "gap")


def table_parity(
    left: DataFrame, right: DataFrame, keys: Sequence[str], family: Column | None = None, tolerance: float = 1e-6
) -> DataFrame:
    """Agreement of two long tables (keys, feature, value) by feature family."""
    a = left.select(*keys, "feature", F.col("value").alias("a"))
    b = right.select(*keys, "feature", F.col("value").alias("b"))
    both = a.join(b, [*keys, "feature"])
    gap = F.abs(sanitise("a") - sanitise("b"))
    scale = F.greatest(F.abs(F.col("a")), F.abs(F.col("b")), F.lit(1.0))
    both = both.withColumn("family", family if family is not None else F.lit("all")).withColumn("gap", gap)
    return both.groupBy("family").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("gap").alias("max_abs_diff"),
        F.avg("gap").alias("mean_abs_diff"),
        F.count_if(F.col("gap") == 0).alias("n_exact"),
        F.count_if(F.col("gap") <= tolerance * scale).alias("n_close"),
    )


def determinism_check(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether two runs are identical, and close at 1e-12 and 1e-6."""
    out = table_parity(left, right, keys, tolerance=1e-12).select(
        "n", (F.col("n_exact") == F.col("n")).alias("identical"), (F.col("n_close") == F.col("n")).alias("close_1e_12"),
        (F.col("max_abs_diff") <= 1e-6).alias("close_1e_6"),
    )
    return out


def speed_up(slow: Column, fast: Column) -> Column:
    return slow / F.greatest(fast, F.lit(1e-6))


def persistence_baseline(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], target: str, start: Column | float
) -> DataFrame:
    """The previous target as prediction, and `start` for the first row of a series."""
    default = start if isinstance(start, Column) else F.lit(float(start))
    keys = list(keys)
    if fits_one_task(df, keys):
        previous = F.lag(target).over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn("prediction", F.coalesce(previous, default))
    # The predecessor of a row is the row one position before it.
    rows = with_position(df, keys, order, "__p")
    before = rows.select(*keys, (F.col("__p") + 1).alias("__p"), F.col(target).alias("__prev"))
    out = rows.join(before, [*keys, "__p"], "left")
    return out.withColumn("prediction", F.coalesce("__prev", default)).drop("__p", "__prev")


