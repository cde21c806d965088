"""Queries over result tables: paired tests, ranks, calibration, parity and forecast summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.expr import feature_family
from tidemark.operators import compare as cmp
from tidemark.operators.features.basic import statistical_features
from tidemark.operators.features.rows import features_long
from tidemark.operators.selection import adjust_p_values
from tidemark.plans.registry import digits, query, rounded, rounded_sql, table
from tidemark.plans.window_queries import event_windows


def result_table(spark, sf_dir):
    """Average price (as RMSE) of each return flag (method) per supplier (dataset) and status (seed)."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(
        F.col("l_suppkey").alias("Dataset"), F.col("l_linestatus").alias("Seed"), F.col("l_returnflag").alias("Extractor")
    ).agg(F.avg("l_extendedprice").alias("RMSE"))


_RESULTS = """WITH res AS (SELECT l_suppkey AS d, l_linestatus AS s, l_returnflag AS g, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2, 3)"""

_TESTS = {"mean_1": 4, "mean_2": 4, "mean_difference": 4, "cohens_d": 6, "t_statistic": 6}


@query(
    "paired_t_tests",
    rounded_sql(
        f"""{_RESULTS} SELECT a.g AS group_1, b.g AS group_2, count(*) AS n_pairs, avg(a.v) AS mean_1, avg(b.v) AS mean_2,
avg(a.v - b.v) AS mean_difference, avg(a.v - b.v) / stddev_samp(a.v - b.v) AS cohens_d,
avg(a.v - b.v) * sqrt(count(*)) / stddev_samp(a.v - b.v) AS t_statistic
FROM res a JOIN res b ON a.d = b.d AND a.s = b.s AND a.g < b.g GROUP BY 1, 2 HAVING count(*) >= 2""",
        ["group_1", "group_2", "n_pairs"],
        _TESTS,
    ),
)
def _(spark, sf_dir):
    pairs = cmp.paired_rows(result_table(spark, sf_dir), "Extractor", "RMSE", ["Dataset", "Seed"])
    return rounded(cmp.paired_t_tests(pairs), ["group_1", "group_2", "n_pairs"], _TESTS)


@query("pairwise_tests_with_winner")
def _(spark, sf_dir):
    return cmp.pairwise_tests(result_table(spark, sf_dir), "Extractor", "RMSE")


_STEP_UP = """WITH t AS (SELECT o_orderkey, o_orderstatus, (o_custkey % 997 + 1) / 1000.0::DOUBLE AS p FROM orders),
h AS (SELECT o_orderstatus, p, count(*) AS c FROM t GROUP BY 1, 2),
r AS (SELECT *, sum(c) OVER (PARTITION BY o_orderstatus ORDER BY p) AS k, sum(c) OVER (PARTITION BY o_orderstatus) AS m FROM h),
a AS (SELECT o_orderstatus, p, min(least(1.0, p * m / k * {factor})) OVER (PARTITION BY o_orderstatus ORDER BY p
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM r)
SELECT o_orderkey, round(q, 6)::DOUBLE AS p_adjusted FROM t JOIN a USING (o_orderstatus, p)"""


def _p_values(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", "o_orderstatus", ((F.col("o_custkey") % 997 + 1) / F.lit(1000.0)).alias("p"))


@query("step_up_adjustment", _STEP_UP.format(factor="1.0"))
def _(spark, sf_dir):
    out = adjust_p_values(_p_values(spark, sf_dir), "p", keys=["o_orderstatus"])
    return out.select("o_orderkey", F.round("p_adjusted", 6).alias("p_adjusted"))


@query(
    "step_up_adjustment_dependent",
    _STEP_UP.format(factor="list_sum([1.0::DOUBLE / i FOR i IN range(1, m::BIGINT + 1)])"),
)
def _(spark, sf_dir):
    out = adjust_p_values(_p_values(spark, sf_dir), "p", method="by", keys=["o_orderstatus"])
    return out.select("o_orderkey", F.round("p_adjusted", 6).alias("p_adjusted"))


_RANKS = f"""{_RESULTS}, cells AS (SELECT d, g, avg(v) AS v FROM res GROUP BY 1, 2),
common AS (SELECT d FROM cells GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT g) FROM cells)),
ranked AS (SELECT d, g, rank() OVER (PARTITION BY d ORDER BY v) + (count(*) OVER (PARTITION BY d, v) - 1) / 2 AS r
  FROM cells SEMI JOIN common USING (d))"""


@query("dataset_ranks", f"""{_RANKS} SELECT d AS "Dataset", g AS "Extractor", r::DOUBLE AS rank FROM ranked""")
def _(spark, sf_dir):
    out = cmp.dataset_ranks(result_table(spark, sf_dir), "RMSE", "Extractor", "Dataset")
    return out.select("Dataset", "Extractor", F.col("rank").cast("double").alias("rank"))


@query(
    "average_ranks",
    f"""{_RANKS} SELECT g AS "Extractor", round(avg(r), 6) AS avg_rank, count(*) AS n_datasets FROM ranked GROUP BY 1""",
)
def _(spark, sf_dir):
    out = cmp.average_ranks(result_table(spark, sf_dir), "RMSE", "Extractor", "Dataset")
    return out.select("Extractor", F.round("avg_rank", 6).alias("avg_rank"), "n_datasets")


@query(
    "signed_rank_sums",
    f"""{_RANKS}, cell AS (SELECT d, g, avg(v) AS v FROM res SEMI JOIN common USING (d) GROUP BY 1, 2),
pairs AS (SELECT a.g AS group_1, b.g AS group_2, a.v - b.v AS diff FROM cell a JOIN cell b ON a.d = b.d AND a.g < b.g),
rk AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY group_1, group_2, abs(diff)) - 1) / 2 AS r FROM pairs
  WHERE diff <> 0 WINDOW w AS (PARTITION BY group_1, group_2 ORDER BY abs(diff)))
SELECT group_1, group_2, (SELECT count(*) FROM common)::BIGINT AS n_pairs, sum(CASE WHEN diff > 0 THEN r ELSE 0 END)::DOUBLE AS plus FROM rk GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    out = cmp.rank_significance(result_table(spark, sf_dir), "RMSE", "Extractor", "Dataset")
    return out.select("group_1", "group_2", "n_pairs", F.col("plus").cast("double").alias("plus"))


@query("rank_cliques")
def _(spark, sf_dir):
    results = result_table(spark, sf_dir)
    ranks = cmp.average_ranks(results, "RMSE", "Extractor", "Dataset")
    tests = cmp.rank_significance(results, "RMSE", "Extractor", "Dataset")
    runs = cmp.rank_cliques(ranks, tests, "Extractor")
    rows = [(i, m) for i, run in enumerate(runs) for m in run]
    return spark.createDataFrame(rows, "clique int, method string")


@query(
    "metric_direction",
    """SELECT DISTINCT l_returnflag, CASE l_returnflag WHEN 'A' THEN 'lower' ELSE 'higher' END AS direction FROM lineitem""",
)
def _(spark, sf_dir):
    name = F.when(F.col("l_returnflag") == "A", "RMSE").otherwise("Accuracy")
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", cmp.direction_column(name).alias("direction"))
    return lines.distinct()


_P = "((o_custkey * 37 + o_orderkey) % 1009) / 1009.0::DOUBLE"


@query(
    "null_calibration",
    rounded_sql(
        f"""WITH t AS (SELECT o_orderpriority, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE {_P} END AS p FROM orders),
k AS (SELECT o_orderpriority, p, row_number() OVER (PARTITION BY o_orderpriority ORDER BY p) AS r,
  count(*) OVER (PARTITION BY o_orderpriority) AS n FROM t WHERE p IS NOT NULL),
ks AS (SELECT o_orderpriority, max(greatest(r / n - p, p - (r - 1) / n)) AS uniform_distance FROM k GROUP BY 1)
SELECT o_orderpriority, count(p) AS n, count(*) - count(p) AS n_undefined, avg((p < 0.05)::INTEGER) AS rate_0_05,
avg((p < 0.01)::INTEGER) AS rate_0_01, max(uniform_distance) AS uniform_distance FROM t JOIN ks USING (o_orderpriority) GROUP BY 1""",
        ["o_orderpriority", "n", "n_undefined"],
        digits(["rate_0_05", "rate_0_01", "uniform_distance"]),
    ),
)
def _(spark, sf_dir):
    p = ((F.col("o_custkey") * 37 + F.col("o_orderkey")) % 1009) / F.lit(1009.0)
    rows = table(spark, sf_dir, "orders").withColumn("p", F.when(F.col("o_orderkey") % 50 != 0, p))
    out = cmp.null_calibration(rows, ["o_orderpriority"], "p")
    return rounded(out, ["o_orderpriority", "n", "n_undefined"], digits(["rate_0_05", "rate_0_01", "uniform_distance"]))


@query(
    "leakage_gap",
    rounded_sql(
        f"""{_RESULTS}, gaps AS (SELECT o.g, o.v - f.v AS gap FROM res o JOIN res f ON o.d = f.d AND o.g = f.g AND o.s = 'O' AND f.s = 'F')
SELECT g AS "Extractor", count(*) AS n, avg(gap) AS mean FROM gaps GROUP BY 1""",
        ['"Extractor"', "n"],
        {"mean": 4},
    ),
)
def _(spark, sf_dir):
    scores = result_table(spark, sf_dir).withColumnsRenamed({"Seed": "strategy", "RMSE": "score"})
    out = cmp.leakage_gap(scores, ["Dataset", "Extractor"], ["Extractor"], "O", "F")
    return rounded(out, ["Extractor", "n"], {"mean": 4})


_PARITY = """WITH s AS (SELECT l_suppkey AS id, avg(l_tax) AS m, stddev_samp(l_tax) AS sd1, stddev_pop(l_tax) AS sd0, min(l_tax) AS lo, max(l_tax) AS hi,
sum(l_tax * l_tax) AS e FROM lineitem GROUP BY 1),
gaps AS (SELECT 'Other' AS family, abs(sd1 - sd0) AS gap FROM s UNION ALL SELECT 'Other', 0 FROM s, (SELECT unnest(range(0, 3))) AS three
UNION ALL SELECT 'Location & Energy', 0 FROM s)"""


@query(
    "table_parity",
    f"""{_PARITY} SELECT family, count(*) AS n, round(max(gap), 6) AS max_abs_diff, round(avg(gap), 8) AS mean_abs_diff,
count(*) FILTER (gap <= 1e-3) AS n_close FROM gaps GROUP BY 1""",
)
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    a = features_long(statistical_features(lines, "l_suppkey", ["l_tax"]), ["l_suppkey"])
    b = features_long(statistical_features(lines, "l_suppkey", ["l_tax"], sample_std=False), ["l_suppkey"])
    out = cmp.table_parity(a, b, ["l_suppkey"], feature_family("feature"), tolerance=1e-3)
    return out.select(
        "family", "n", F.round("max_abs_diff", 6).alias("max_abs_diff"), F.round("mean_abs_diff", 8).alias("mean_abs_diff"), "n_close"
    )


@query("determinism_check", "SELECT 5 * count(DISTINCT l_suppkey) AS n, true AS close_1e_12, true AS close_1e_6 FROM lineitem")
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    a = features_long(statistical_features(lines, "l_suppkey", ["l_tax"]), ["l_suppkey"])
    b = features_long(statistical_features(lines.repartition(5), "l_suppkey", ["l_tax"]), ["l_suppkey"])
    return cmp.determinism_check(a, b, ["l_suppkey"]).select("n", "close_1e_12", "close_1e_6")


@query(
    "speed_up_ratios",
    rounded_sql(
        """SELECT l_suppkey, max(l_quantity) / greatest(min(l_tax), 1e-6) AS speed_up FROM lineitem GROUP BY 1""",
        ["l_suppkey"],
        {"speed_up": 4},
    ),
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.max("l_quantity").alias("slow"), F.min("l_tax").alias("fast")
    )
    return rounded(rows.withColumn("speed_up", cmp.speed_up(F.col("slow"), F.col("fast"))), ["l_suppkey"], {"speed_up": 4})


@query(
    "feature_reduction",
    rounded_sql(
        """SELECT l_suppkey, (1 - count(*) FILTER (l_quantity > 30) / greatest(count(*), 1)) * 100 AS reduction FROM lineitem GROUP BY 1""",
        ["l_suppkey"],
        {"reduction": 6},
    ),
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_quantity") > 30).alias("kept"), F.count("*").alias("all")
    )
    rows = rows.withColumn("reduction", cmp.feature_reduction(F.col("kept"), F.col("all")))
    return rounded(rows, ["l_suppkey"], {"reduction": 6})


@query(
    "horizon_profile",
    rounded_sql(
        """WITH wide AS (SELECT l_returnflag AS method, l_suppkey, avg(l_tax) FILTER (l_linenumber = 1) AS h1,
avg(l_tax) FILTER (l_linenumber = 2) AS h2, avg(l_quantity) FILTER (l_linenumber = 1) AS q1 FROM lineitem GROUP BY 1, 2)
SELECT method, 'RMSE' AS metric, 1 AS horizon, avg(h1) AS mean, stddev_samp(h1) AS std FROM wide GROUP BY 1
UNION ALL SELECT method, 'RMSE', 2, avg(h2), stddev_samp(h2) FROM wide GROUP BY 1
UNION ALL SELECT method, 'Interval Width', 1, avg(q1), stddev_samp(q1) FROM wide GROUP BY 1""",
        ["method", "metric", "horizon"],
        digits(["mean", "std"]),
    ),
)
def _(spark, sf_dir):
    def part(column, number):
        return F.avg(F.when(F.col("l_linenumber") == number, F.col(column)))

    wide = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("method"), "l_suppkey").agg(
        part("l_tax", 1).alias("RMSE_H1"), part("l_tax", 2).alias("RMSE H2"), part("l_quantity", 1).alias("Interval Width 1")
    )
    out = cmp.horizon_profile(wide, "method", ["RMSE", "Interval Width"])
    return rounded(out, ["method", "metric", "horizon"], digits(["mean", "std"]))


@query(
    "interval_width_summary",
    rounded_sql(
        """SELECT l_returnflag AS method, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS std, median(l_extendedprice) AS median
FROM lineitem GROUP BY 1""",
        ["method"],
        digits(["mean", "std", "median"], 3),
    ),
)
def _(spark, sf_dir):
    from tidemark.operators.aggregate import summary_statistics

    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_extendedprice").alias("width"))
    out = summary_statistics(lines, ["method"], ["width"])
    out = out.withColumnsRenamed({f"width__{n}": n for n in ("mean", "std", "median")})
    return rounded(out, ["method"], digits(["mean", "std", "median"], 3))


@query("windows_run_twice", "SELECT true AS same")
def _(spark, sf_dir):
    from tidemark.operators.aggregate import table_fingerprint

    a = table_fingerprint(event_windows(spark, sf_dir)[0]).select(F.col("hash_sum").alias("a"), "n_rows")
    b = table_fingerprint(event_windows(spark, sf_dir)[0].repartition(3)).select(F.col("hash_sum").alias("b"), "n_rows")
    return a.join(b, "n_rows").select((F.col("a") == F.col("b")).alias("same"))
