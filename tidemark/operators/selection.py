"""Feature selection on long features (sequence_id, feature, value) and targets (sequence_id, target).

Every test is built from sums or value histograms that combine before the
shuffle, so a feature with any number of rows is never held by one task. The
result is a mask table: feature, score, p_value, selected. Features are read
several times: hand in a stored table, not a long plan.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import sanitise
from tidemark.functions.exact_tests import kendall_exact_p, smirnov_exact_p
from tidemark.functions.special import (
    fisher_exact_p,
    fisher_f_p,
    kolmogorov_p,
    normal_p,
)
from tidemark.operators.features.basic import guarded_corr
from tidemark.operators.features.rows import sequence_rows
from tidemark.operators.inversions import inverted_pairs
from tidemark.operators.neighbours import digamma, interval_counts, real_mutual_information
from tidemark.operators.position import bucket_codes, fits_one_task, prefix_sums, value_ranks, with_position
from tidemark.operators.splits import seeded_hash
from tidemark.session import BLOCK_ROWS, MAX_GROUP_ROWS, cut_lineage, limit

ID = "sequence_id"


def clean_features(features: DataFrame) -> DataFrame:
    return features.select(ID, "feature", sanitise("value").alias("value"))


def labelled(features: DataFrame, targets: DataFrame) -> DataFrame:
    """Features joined to their targets on the sequence id."""
    return clean_features(features).join(targets.select(ID, F.col("target").alias("y")), ID)


def collapse_horizons(targets: DataFrame, target: str = "target") -> DataFrame:
    """The mean over the horizon of an array target, for selectors that need one number."""
    total = F.aggregate(target, F.lit(0.0), lambda a, v: a + v)
    return targets.withColumn(target, F.try_divide(total, F.size(target)))


# --- p-value adjustment ------------------------------------------------------------------------


def adjust_p_values(
    df: DataFrame, p: str, level: float = 0.05, method: str = "bh", keys: Sequence[str] = ()
) -> DataFrame:
    """Step-up false discovery rate over one row per test: adds `p_adjusted` and `significant`.

    `bh` is Benjamini-Hochberg; `by` multiplies by the harmonic sum for dependent tests. An
    undefined p counts as 1.
    """
    if method not in ("bh", "by"):
        raise ValueError(f"unknown method {method}")
    keys = list(keys)
    tests = df.withColumn("__p", F.coalesce(F.nanvl(p, F.lit(None)), F.lit(1.0)))

    def scaled(upto: Column, m: Column) -> Column:
        # The harmonic sum of m is digamma(m + 1) plus Euler's constant.
        factor = digamma(m + 1) + F.lit(0.5772156649015329) if method == "by" else F.lit(1.0)
        return F.least(F.lit(1.0), F.col("__p") * m / upto * factor)

    by_p = Window.partitionBy(*keys).orderBy("__p")
    # Spark evaluates a frame that ends with the group anew for every row, one that begins with it only once.
    onwards = Window.partitionBy(*keys).orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, 0)
    if fits_one_task(tests, keys):
        # Equal p-values share the rank of the last of them.
        upto = F.count(F.lit(1)).over(by_p.rangeBetween(Window.unboundedPreceding, 0))
        raw = scaled(upto, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        out = tests.withColumn("__raw", raw).withColumn("p_adjusted", F.min("__raw").over(onwards)).drop("__raw")
    else:
        # The p-values are met again by value, so they are worked out once.
        tests = cut_lineage(tests)
        hist = tests.groupBy(*keys, "__p").agg(F.count(F.lit(1)).alias("__c"))
        ranked = prefix_sums(hist, keys, ["__p"], {"__m": F.col("__c")})
        ranked = ranked.withColumn("__raw", scaled(F.col("__m_before") + F.col("__c"), F.col("__m_total")))
        adjusted = suffix_minimum(ranked.select(*keys, "__p", "__raw"), keys, "__p", "__raw", "p_adjusted")
        out = tests.join(adjusted.select(*keys, "__p", "p_adjusted"), [*keys, "__p"])
    return out.drop("__p").withColumn("significant", F.col("p_adjusted") <= level)


def suffix_minimum(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Smallest `value` of the rows from each row on, for groups that no task may hold: within a
    bucket of the order, and over the buckets after it."""
    codes = bucket_codes(df, [order], df.count())
    bucket = next(iter(codes))
    rows = cut_lineage(df.withColumns(codes))
    least = rows.groupBy(*keys, bucket).agg(F.min(value).alias("__least"))
    later = Window.partitionBy(*keys).orderBy(F.desc(bucket)).rowsBetween(Window.unboundedPreceding, -1)
    least = least.select(*keys, bucket, F.min("__least").over(later).alias("__later"))
    inside = Window.partitionBy(*keys, bucket).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("__inside", F.min(value).over(inside)).join(least, [*keys, bucket])
    return out.withColumn(name, F.least("__inside", "__later")).drop("__inside", "__later", bucket)


# --- univariate scores -------------------------------------------------------------------------


def class_statistics(data: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return data.groupBy("feature", "y", *extra).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
    )


def anova_scores(features: DataFrame, targets: DataFrame) -> DataFrame:
    """One-way F of each feature over the classes, with its p."""
    stats = class_statistics(labelled(features, targets))
    return _anova_from_statistics(stats, ["feature"])


def _anova_from_statistics(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    n, m = F.col("n"), F.col("m")
    # Sum of squares between the classes from class sizes and means.
    weight = F.sum(n)
    grand = F.sum(n * m) / weight
    sums = stats.groupBy(*keys).agg(
        weight.alias("rows"),
        F.count(F.lit(1)).alias("classes"),
        grand.alias("grand"),
        F.sum(n * F.col("v")).alias("within"),
        F.collect_list(F.struct("n", "m")).alias("parts"),
    )
    between = F.aggregate(
        "parts",
        F.lit(0.0),
        lambda a, s: a + s["n"] * (s["m"] - F.col("grand")) * (s["m"] - F.col("grand")),
    )
    d1, d2 = F.col("classes") - 1, F.col("rows") - F.col("classes")
    sums = sums.withColumn("between", between)
    score = F.try_divide(F.col("between") / d1, F.col("within") / d2)
    sums = sums.withColumn("score", F.when((d1 > 0) & (d2 > 0), score))
    return sums.select(*keys, "score", fisher_f_p(F.col("score"), d1, d2).alias("p_value"))


def anova_scores_by_fold(features: DataFrame, targets: DataFrame, folds: DataFrame) -> DataFrame:
    """ANOVA on the train part of every fold from one pass: the sums of each (feature, class, fold)
    are kept and a train part is the total less the test fold."""
    data = labelled(features, targets).join(folds.select(ID, "fold"), ID)
    # Centring by the feature mean keeps the sums of squares free of cancellation.
    centre = data.groupBy("feature").agg(F.avg("value").alias("c"))
    data = data.join(centre, "feature").withColumn("d", F.col("value") - F.col("c"))
    parts = data.groupBy("feature", "y", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("q")
    )
    whole = Window.partitionBy("feature", "y")
    rest = parts.select(
        "feature", "y", "fold", *[(F.sum(c).over(whole) - F.col(c)).alias(c) for c in ("n", "s", "q")]
    )
    # A class that has no row in some fold keeps its totals there.
    totals = parts.groupBy("feature", "y").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.collect_set("fold").alias("seen")
    )
    all_folds = parts.groupBy("feature").agg(F.collect_set("fold").alias("folds"))
    absent = (
        totals.join(all_folds, "feature")
        .withColumn("fold", F.explode(F.array_except("folds", "seen")))
        .select("feature", "y", "fold", "n", "s", "q")
    )
    train = rest.unionByName(absent).filter("n > 0")
    mean = F.col("s") / F.col("n")
    stats = train.withColumns({"m": mean, "v": F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))})
    return _anova_from_statistics(stats, ["feature", "fold"])


def regression_scores(features: DataFrame, targets: DataFrame) -> DataFrame:
    """F of the linear relation of each feature with a real target."""
    data = labelled(features, targets)
    r = guarded_corr(F.col("value"), F.col("y").cast("double"))
    sums = data.groupBy("feature").agg(r.alias("r"), F.count(F.lit(1)).alias("n"))
    d2 = F.col("n") - 2
    score = F.try_divide(F.col("r") * F.col("r") * d2, 1 - F.col("r") * F.col("r"))
    sums = sums.withColumn("score", score)
    return sums.select("feature", "score", fisher_f_p(F.col("score"), F.lit(1), d2).alias("p_value"))


def correlation_scores(features: DataFrame, targets: DataFrame) -> DataFrame:
    data = labelled(features, targets)
    r = guarded_corr(F.col("value"), F.col("y").cast("double"))
    return data.groupBy("feature").agg(r.alias("score"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """Mark the k best scores (ties by name); k at most 0 marks none."""
    best = scores.filter(F.col("score").isNotNull()).orderBy(F.desc("score"), "feature").limit(max(k, 0))
    best = best.select("feature", F.lit(True).alias("selected"))
    return scores.join(best, "feature", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def select_k_best(
    features: DataFrame,
    targets: DataFrame,
    k: int = 20,
    task_type: str = "classification",
    score_func: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Top k by ANOVA F, regression F, or a custom function (features, targets) -> (feature, score)."""
    if score_func is None:
        score_func = regression_scores if task_type == "regression" else anova_scores
    return top_k(score_func(features, targets), k)


def variance_threshold(features: DataFrame, targets: DataFrame | None = None, threshold: float = 0.0) -> DataFrame:
    """Keep features whose population variance exceeds the threshold."""
    scores = clean_features(features).groupBy("feature").agg(F.var_pop("value").alias("score"))
    return scores.withColumn("selected", F.col("score") > threshold)


def correlation_threshold(features: DataFrame, targets: DataFrame, threshold: float = 0.1) -> DataFrame:
    scores = correlation_scores(features, targets)
    return scores.withColumn("selected", F.abs("score") >= threshold)


def drop_constant(features: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Features whose sample deviation is missing, 0, or tiny against the mean are not selected."""
    stats = features.groupBy("feature").agg(F.stddev_samp("value").alias("sd"), F.avg("value").alias("m"))
    relative = F.col("sd") / (F.abs("m") + F.lit(1e-12))
    keep = F.coalesce((F.col("sd") > 0) & (relative >= 1e-10), F.lit(False))
    return stats.select("feature", F.col("sd").alias("score"), keep.alias("selected"))


def drop_incomplete(features: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Features with any missing value are not selected."""
    missing = F.count_if(F.col("value").isNull() | F.isnan("value"))
    scores = features.groupBy("feature").agg(missing.cast("double").alias("score"))
    return scores.withColumn("selected", F.col("score") == 0)


def uncorrected_anova(features: DataFrame, targets: DataFrame, level: float = 0.05) -> DataFrame:
    return anova_scores(features, targets).withColumn(
        "selected", F.coalesce(F.col("p_value") < level, F.lit(False))
    )


def fdr_anova(features: DataFrame, targets: DataFrame, level: float = 0.05) -> DataFrame:
    scored = adjust_p_values(anova_scores(features, targets), "p_value", level)
    return scored.withColumnRenamed("significant", "selected")


# --- hypothesis tests --------------------------------------------------------------------------


def mann_whitney(features: DataFrame, targets: DataFrame) -> DataFrame:
    """Two-sided rank-sum test of every feature for each class against the rest.

    Ranks come from the value histogram of the feature; ties and continuity are corrected.
    """
    data = labelled(features, targets)
    hist = data.groupBy("feature", "value", "y").agg(F.count(F.lit(1)).alias("c"))
    # The counts per class stay with their value; there are as many as classes.
    values = hist.groupBy("feature", "value").agg(
        F.sum("c").alias("n"), F.collect_list(F.struct("y", "c")).alias("parts")
    )
    # Measured and ranked from one written table: the join of features and targets runs once.
    ranked = prefix_sums(cut_lineage(values), ["feature"], ["value"], {"__n": F.col("n")})
    ranked = ranked.withColumn("rank", F.col("__n_before") + (F.col("n") + 1) / 2)
    t = F.col("n").cast("double")
    per_feature = ranked.groupBy("feature").agg(
        F.sum(t * t * t - t).alias("ties"), F.sum(t).alias("rows")
    )
    sums = (
        ranked.select("feature", "rank", F.explode("parts").alias("s"))
        .select("feature", "rank", "s.*")
        .groupBy("feature", "y")
        .agg(F.sum(F.col("c") * F.col("rank")).alias("r"), F.sum("c").cast("double").alias("n1"))
        .join(per_feature, "feature")
    )
    n, n1 = F.col("rows"), F.col("n1")
    n2 = n - n1
    u = F.col("r") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - F.lit(0.5), spread)
    out = sums.select("feature", F.col("y").alias("label"), u.alias("u"), z.alias("z"))
    p = F.least(F.lit(1.0), F.when(F.col("z") < 0, 2 - normal_p(F.col("z"))).otherwise(normal_p(F.col("z"))))
    return out.withColumn("p_value", p)


def fisher_exact(features: DataFrame, targets: DataFrame) -> DataFrame:
    """Exact 2x2 test of each two-valued feature for each class against the rest."""
    data = labelled(features, targets)
    edge = data.groupBy("feature").agg(F.max("value").alias("hi"))
    counts = data.join(edge, "feature").groupBy("feature", "y").agg(
        F.count_if(F.col("value") == F.col("hi")).alias("a"),
        F.count_if(F.col("value") != F.col("hi")).alias("b"),
    )
    totals = counts.groupBy("feature").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    out = counts.join(totals, "feature")
    p = fisher_exact_p(F.col("a"), F.col("b"), F.col("ta") - F.col("a"), F.col("tb") - F.col("b"))
    return out.select("feature", F.col("y").alias("label"), p.alias("p_value"))


def two_sample_distance(
    df: DataFrame, keys: Sequence[str], value: str, flag: Column, exact_rows: int = 10_000
) -> DataFrame:
    """Kolmogorov-Smirnov distance between the flagged and the other rows, with its p: exact while neither sample has more
    than `exact_rows` rows, the limit form beyond."""
    ranks = value_ranks(df, keys, value, flag)
    n1, n0 = F.col("n1_total"), F.col("n_total") - F.col("n1_total")
    upto1 = F.col("n1_before") + F.col("n1")
    upto0 = F.col("n_before") + F.col("n") - upto1
    gap = F.abs(F.try_divide(upto1, n1) - F.try_divide(upto0, n0))
    out = ranks.groupBy(*keys).agg(
        F.max(gap).alias("distance"), F.max(n1).cast("double").alias("__n1"), F.max(n0).cast("double").alias("__n0")
    )
    scale = F.sqrt(F.try_divide(F.col("__n1") * F.col("__n0"), F.col("__n1") + F.col("__n0")))
    small = F.greatest("__n1", "__n0") <= exact_rows
    exact = smirnov_exact_p(F.when(small, F.col("__n1")), F.when(small, F.col("__n0")), F.col("distance"))
    p = F.when(small, exact).otherwise(kolmogorov_p(scale * F.col("distance")))
    return out.withColumn("p_value", F.nanvl(p, F.lit(None))).drop("__n1", "__n0")


def _spread(rows: DataFrame) -> DataFrame:
    """Written rows in parts that a task can count by value in memory, however many rows there are."""
    parts = max(8, -(-rows.count() // limit(rows.sparkSession, MAX_GROUP_ROWS)))
    return rows.repartition(parts, "feature", ID)


def smirnov(features: DataFrame, targets: DataFrame) -> DataFrame:
    """Distance between the target distributions of the two values of a feature."""
    data = _spread(cut_lineage(labelled(features, targets).withColumn("y", F.col("y").cast("double"))))
    edge = data.groupBy("feature").agg(F.max("value").alias("hi"))
    data = data.join(F.broadcast(edge), "feature")
    return two_sample_distance(data, ["feature"], "y", F.col("value") == F.col("hi"))


def _tie_sums(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    t = F.col("t").cast("double")
    counts = df.groupBy(*keys, *columns).agg(F.sum("c").alias("t"))
    return counts.groupBy(*keys).agg(
        F.sum(t * (t - 1) / 2).alias(f"{name}_pairs"),
        F.sum(t * (t - 1) * (t - 2)).alias(f"{name}_0"),
        F.sum(t * (t - 1) * (2 * t + 5)).alias(f"{name}_1"),
    )


def _merge_levels(ordered: DataFrame) -> DataFrame:
    """Each row (feature, p, n, y) in its block of every level of a merge sort, and whether it is in the right half."""
    # A task counts all it unfolds before the shuffle, in memory: so it gets no more rows however large the files are.
    parts = max(8, -(-ordered.count() // limit(ordered.sparkSession, BLOCK_ROWS)))
    rows = ordered.select("feature", "p", "n", "y").repartition(parts, "feature", "p")
    bits = F.ceil(F.log2(F.greatest(F.col("n"), F.lit(2)).cast("double"))).cast("int")
    levels = rows.withColumn("level", F.explode(F.sequence(F.lit(0), bits - 1)))
    half = F.expr("shiftright(p, level)")
    return levels.select(
        "feature", "level", F.expr("shiftright(p, level + 1)").alias("block"), "y", (half % 2).alias("right")
    )


def kendall(features: DataFrame, targets: DataFrame, exact_rows: int = 33) -> DataFrame:
    """Kendall's tau-b of each feature with a real target, with its p: without ties exact up to `exact_rows` rows, and beyond
    them while at most one pair goes against the others; the normal form otherwise (`exact_rows=0`: always).

    Discordant pairs are inversions of the target in the order of the feature, counted between the different pairs of
    values with their numbers of rows.
    """
    data = labelled(features, targets).select("feature", "value", F.col("y").cast("double").alias("y"))
    data = cut_lineage(data.groupBy("feature", "value", "y").agg(F.count(F.lit(1)).alias("c")))
    # Rows without a target are in no pair, but count as rows.
    dis = inverted_pairs(data.where("y IS NOT NULL"), ["feature"], "value", "y", "c")
    out = data.groupBy("feature").agg(F.sum("c").cast("double").alias("n"))
    out = out.join(dis.withColumnRenamed("pairs", "dis"), "feature")
    for columns, name in ((["value"], "x"), (["y"], "y"), (["value", "y"], "xy")):
        out = out.join(_tie_sums(data, ["feature"], columns, name), "feature")
    n, m = F.col("n"), F.col("n") * (F.col("n") - 1)
    xt, yt = F.col("x_pairs"), F.col("y_pairs")
    gap = m / 2 - xt - yt + F.col("xy_pairs") - 2 * F.col("dis")
    tau = F.try_divide(gap, F.sqrt((m / 2 - xt) * (m / 2 - yt)))
    var = (
        (m * (2 * n + 5) - F.col("x_1") - F.col("y_1")) / 18
        + F.try_divide(2 * xt * yt, m)
        + F.try_divide(F.col("x_0") * F.col("y_0"), 9 * m * (n - 2))
    )
    out = out.withColumns({"tau": tau, "z": F.try_divide(gap, F.sqrt(var))})
    untied = (xt == 0) & (yt == 0) & (F.least(F.col("dis"), m / 2 - F.col("dis")) <= F.when(n <= exact_rows, m).otherwise(1.0))
    untied = untied & (F.lit(exact_rows) > 0)
    exact = kendall_exact_p(F.when(untied, n), F.when(untied, F.col("dis")))
    return out.select("feature", "tau", "z", F.when(untied, exact).otherwise(normal_p(F.col("z"))).alias("p_value"))


def value_kinds(features: DataFrame) -> DataFrame:
    """(feature, type): constant, binary or real by the number of different values, from their least, greatest and any between."""
    clean = clean_features(features)
    ends = clean.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    between = (F.col("value") > F.col("lo")) & (F.col("value") < F.col("hi"))
    kind = F.when(F.max(between), "real").when(F.max(F.col("lo") < F.col("hi")), "binary").otherwise("constant")
    return clean.join(F.broadcast(cut_lineage(ends)), "feature").groupBy("feature").agg(kind.alias("type"))


def relevance_table(
    features: DataFrame, targets: DataFrame, task_type: str = "classification", level: float = 0.05
) -> DataFrame:
    """Type of each feature, the p of the test that fits it, and the step-up decision.

    Two-valued features take the exact test (class target) or the distribution distance (real
    target); real features take the rank-sum test or Kendall's tau. With several classes a
    feature is relevant if it is so for any of them.
    """
    kinds = cut_lineage(value_kinds(features))
    named = {r["type"] for r in kinds.select("type").distinct().collect()}

    def of(name: str) -> DataFrame:
        return features.join(kinds.filter(F.col("type") == name).select("feature"), "feature", "left_semi")

    if task_type == "regression":
        # The filter's own rank correlation test takes the normal form at any size.
        by_type = {"real": lambda x: kendall(x, targets, exact_rows=0), "binary": lambda x: smirnov(x, targets)}
        label = F.lit("all")
    else:
        by_type = {"real": lambda x: mann_whitney(x, targets), "binary": lambda x: fisher_exact(x, targets)}
        label = F.col("label").cast("string")
    # A test that no feature takes reads nothing.
    found = [by_type[name](of(name)).select("feature", "p_value", label.alias("label")) for name in by_type if name in named or (name == "real" and not named & set(by_type))]
    tests = reduce(DataFrame.unionByName, found)
    tests = adjust_p_values(tests, "p_value", level, "by", ["label"])
    best = tests.groupBy("feature").agg(
        F.min("p_value").alias("p_value"),
        F.min("p_adjusted").alias("p_adjusted"),
        F.max("significant").alias("selected"),
    )
    return kinds.join(best, "feature", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def fdr_selector(
    features: DataFrame, targets: DataFrame, fdr_level: float = 0.05, task_type: str = "classification"
) -> DataFrame:
    out = relevance_table(features, targets, task_type, fdr_level)
    return out.select("feature", F.col("p_adjusted").alias("score"), "p_value", "selected")


# --- mutual information ------------------------------------------------------------------------


def binned_mutual_information(features: DataFrame, targets: DataFrame, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of the class with the feature cut into equal-width bins."""
    data = labelled(features, targets)
    edges = data.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    data = data.join(edges, "feature")
    place = F.try_divide((F.col("value") - F.col("lo")) * bins, F.col("hi") - F.col("lo"))
    data = data.withColumn("bin", F.least(F.coalesce(F.floor(place), F.lit(0)), F.lit(bins - 1)))
    joint = data.groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).cast("double").alias("c"))
    # At most bins x classes rows per feature from here on.
    per = Window.partitionBy("feature")
    joint = joint.withColumns(
        {
            "n": F.sum("c").over(per),
            "cb": F.sum("c").over(Window.partitionBy("feature", "bin")),
            "cy": F.sum("c").over(Window.partitionBy("feature", "y")),
        }
    )
    term = F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cb") * F.col("cy")))
    return joint.groupBy("feature").agg(F.sum(term).alias("score"))


def neighbour_mutual_information(
    features: DataFrame, targets: DataFrame, neighbours: int = 3, seed: int = 42
) -> DataFrame:
    """Nearest-neighbour estimate of the mutual information of a real feature and a class.

    The distance to the k-th neighbour of the same class comes from the k rows before and after
    in class order; the rows of any class closer than that from running counts over the values
    merged with the ends of the intervals. Equal values are parted by a seeded jitter.
    """
    k = neighbours
    data = labelled(features, targets)
    scale = data.groupBy("feature").agg(F.greatest(F.lit(1.0), F.avg(F.abs("value"))).alias("scale"))
    noise = seeded_hash(seed, ID, "feature") / F.lit(2.0**63) * 1e-10 * F.col("scale")
    data = data.join(scale, "feature").withColumn("v", F.col("value") + noise)
    data = data.select("feature", "y", ID, "v")

    rows = sequence_rows(data, ["feature", "y"], ["v", ID], ["v"], halo=k)
    w = rows.ordered
    near = [F.abs(F.col("x") - F.lag("x", i).over(w)) for i in range(1, k + 1)]
    near += [F.abs(F.col("x") - F.lead("x", i).over(w)) for i in range(1, k + 1)]
    spans = rows.with_columns({f"__d{i}": c for i, c in enumerate(near)}).own()
    distances = F.array_sort(F.array_compact(F.array(*[F.col(f"__d{i}") for i in range(2 * k)])))
    # A class smaller than k + 1 uses the neighbours it has; a class of one row is left out.
    spans = spans.filter("n > 1").withColumn("__k", F.least(F.lit(k).cast("bigint"), F.col("n") - 1))
    spans = spans.withColumn("r", F.element_at(distances, F.col("__k").cast("int")))
    # Ends of intervals are met by value, so they are worked out once.
    spans = cut_lineage(spans.select("feature", "x", "r", "n", "__k"))

    return interval_counts(spans).groupBy("feature").agg(
        (
            F.max(digamma(F.col("rows")))
            + F.avg(digamma(F.col("__k")))
            - F.avg(digamma(F.col("n")))
            - F.avg(digamma(F.col("m")))
        ).alias("score")
    ).withColumn("score", F.greatest("score", F.lit(0.0)))


def mutual_information(
    features: DataFrame, targets: DataFrame, k: int = 20, task_type: str = "classification", random_state: int = 42
) -> DataFrame:
    """Top k by mutual information with a class, or with a real target."""
    if task_type == "regression":
        return top_k(real_mutual_information(clean_features(features), targets, seed=random_state), k)
    return top_k(neighbour_mutual_information(features, targets, seed=random_state), k)


# --- apply a mask ------------------------------------------------------------------------------


def with_fallback(mask: DataFrame) -> tuple[DataFrame, dict]:
    """The mask to use and what happened: if no feature survives all are kept, and that is flagged."""
    total, survived = mask.agg(F.count(F.lit(1)), F.count_if("selected")).first()
    fallback = survived == 0
    used = mask.withColumn("selected", F.lit(True)) if fallback else mask
    kept = total if fallback else survived
    info = {
        "n_initial_features": total,
        "n_survived_features": survived,
        "n_selected_features": kept,
        "fallback_triggered": fallback,
        "feature_reduction_pct": 0.0 if fallback or not total else round((1 - kept / total) * 100, 2),
    }
    return used, info


def apply_mask(features: DataFrame, mask: DataFrame) -> DataFrame:
    return features.join(mask.filter("selected").select("feature"), "feature", "left_semi")


# --- subsampled selection ----------------------------------------------------------------------


def subsample_size(
    n: int, ratio_: float, min_samples: int, min_class: int | None
) -> int:
    """Rows to draw: the larger of the floor, the share, and enough for two rows of the rarest class."""
    size = max(min_samples, -int(-n * ratio_ // 1))
    if min_class:
        size = max(size, -int(-2.0 * n / min_class // 1))
    return min(size, n)


class SubsampledSelector:
    """Fit a selector on a (stratified) sample of the sequences, apply its mask to all of them.

    `base_selector` is a registered name, a function (features, targets, ...) that returns a mask
    table or a list of names, or an object with `fit` and `get_support`.
    """

    def __init__(
        self,
        base_selector="fdr",
        sample_ratio: float = 0.1,
        random_state: int = 42,
        stratify: bool = True,
        min_samples: int = 50,
        task_type: str = "classification",
        **params,
    ):
        self.base_selector = base_selector
        self.sample_ratio = sample_ratio
        self.random_state = random_state
        self.stratify = stratify
        self.min_samples = min_samples
        self.task_type = task_type
        self.params = params
        self.mask_: DataFrame | None = None
        self.telemetry_: dict = {}

    def sample(self, targets: DataFrame) -> tuple[DataFrame, int, int]:
        n = targets.count()
        if self.sample_ratio >= 1.0 or n <= self.min_samples:
            return targets.select(ID), n, n
        rarest, classes = None, 0
        if self.stratify and self.task_type == "classification":
            sizes = targets.groupBy("target").count()
            rarest, classes = sizes.agg(F.min("count"), F.count(F.lit(1))).first()
        stratified = classes > 1 and rarest >= 2
        size = subsample_size(n, self.sample_ratio, self.min_samples, rarest if stratified else None)
        hashed = targets.withColumn("__hash", seeded_hash(self.random_state, ID))
        keys = ["target"] if stratified else []
        ranked = with_position(hashed.select(ID, "__hash", *keys), keys, ["__hash", ID], "__p", "__n")
        # A class gives its share of the sample, at least one row.
        quota = F.greatest(F.lit(1), F.round(F.col("__n") * (size / n)))
        drawn = ranked.filter(F.col("__p") < quota).select(ID)
        return drawn, drawn.count(), n

    def fit(self, features: DataFrame, targets: DataFrame) -> SubsampledSelector:
        drawn, size, n = self.sample(targets)
        part, labels = features.join(drawn, ID, "left_semi"), targets.join(drawn, ID, "left_semi")
        names = features.select("feature").distinct()
        mask = _run_selector(self.base_selector, part, labels, self.task_type, self.random_state, self.params)
        mask = names.join(mask.select("feature", "selected"), "feature", "left")
        mask = mask.withColumn("selected", F.coalesce("selected", F.lit(False)))
        # The mask has one row per feature and is used by every later job.
        self.mask_, self.telemetry_ = with_fallback(mask.persist())
        self.telemetry_ |= {
            "subsample_size": size,
            "total_size": n,
            "sample_ratio_actual": round(size / n, 4) if n else 0.0,
        }
        return self

    def transform(self, features: DataFrame) -> DataFrame:
        if self.mask_ is None:
            raise RuntimeError("fit before transform")
        return apply_mask(features, self.mask_)

    def get_support(self) -> DataFrame:
        if self.mask_ is None:
            raise RuntimeError("fit before get_support")
        return self.mask_


def subsampling_sweep(
    features: DataFrame, targets: DataFrame, ratios: Sequence[float] = (0.05, 0.1, 0.2, 0.5, 1.0), **params
) -> DataFrame:
    """Telemetry of the subsampled selector, one row per ratio."""
    rows = []
    for r in ratios:
        fitted = SubsampledSelector(sample_ratio=r, **params).fit(features, targets)
        rows.append({"sample_ratio": float(r), **fitted.telemetry_})
    return features.sparkSession.createDataFrame(rows)


def _run_selector(selector, features, targets, task_type, seed, params: Mapping) -> DataFrame:
    if selector is None or isinstance(selector, str):
        return run_selector(selector or "none", features, targets, task_type, random_state=seed, **params)
    if hasattr(selector, "fit") and hasattr(selector, "get_support"):
        selector.fit(features, targets)
        found = selector.get_support()
    elif callable(selector):
        accepted = inspect.signature(selector).parameters
        offered = {"task_type": task_type, "random_state": seed, **params}
        found = selector(features, targets, **{k: v for k, v in offered.items() if k in accepted})
    else:
        raise TypeError(f"not a selector: {selector!r}")
    if isinstance(found, DataFrame):
        if "selected" in found.columns:
            return found
        return found.select("feature").distinct().withColumn("selected", F.lit(True))
    names = [(str(f), True) for f in found]
    return features.sparkSession.createDataFrame(names, "feature string, selected boolean")


def run_selector(
    name: str, features: DataFrame, targets: DataFrame, task_type: str = "classification", **params
) -> DataFrame:
    """Mask table of a selector by name or alias; an unknown name raises."""
    from tidemark.operators import model_selection as trees

    if "target" in targets.columns and targets.schema["target"].dataType.typeName() == "array":
        targets = collapse_horizons(targets)
    table: dict[str, tuple[Callable, dict]] = {
        "fdr": (fdr_selector, {}),
        "select_k_best": (select_k_best, {}),
        "mutual_info": (mutual_information, {"k": 25}),
        "boruta": (trees.boruta, {}),
        "variance_threshold": (variance_threshold, {}),
        "l1": (trees.l1_selector, {}),
        "extra_trees": (trees.tree_importance, {}),
        "random_forest": (trees.tree_importance, {"model_type": "random_forest"}),
        "correlation": (correlation_threshold, {}),
    }
    key = ALIASES.get(name, name)
    if key == "none":
        return features.select("feature").distinct().withColumn("selected", F.lit(True))
    if key == "subsampled":
        inner = {k: v for k, v in params.items() if k not in ("base_selector", "sample_ratio")}
        fitted = SubsampledSelector(
            params.get("base_selector", "fdr"), params.get("sample_ratio", 0.1), task_type=task_type, **inner
        ).fit(features, targets)
        return fitted.get_support()
    if key not in table:
        raise KeyError(f"unknown selector {name}")
    fn, defaults = table[key]
    accepted = inspect.signature(fn).parameters
    given = {**defaults, "task_type": task_type, **{k: v for k, v in params.items() if v is not None}}
    return fn(features, targets, **{k: v for k, v in given.items() if k in accepted})


# Other names of the selectors.
ALIASES = {
    "tsfresh": "fdr",
    "select_k_best_anova": "select_k_best",
    "anova": "select_k_best",
    "select_k_best_mutual_info": "mutual_info",
    "mi": "mutual_info",
    "variance": "variance_threshold",
    "zero_variance": "variance_threshold",
    "lasso": "l1",
    "extratrees": "extra_trees",
    "tree_importance": "extra_trees",
    "rf_importance": "random_forest",
    "randomforest": "random_forest",
    "subsampled_fdr": "subsampled",
    "None": "none",
}
