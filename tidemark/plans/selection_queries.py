"""Queries over long feature tables: scores, tests, masks and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.neighbours import real_mutual_information
from tidemark.operators import model_selection as trees
from tidemark.operators import selection as sel
from tidemark.operators import splits
from tidemark.operators.position import with_position
from tidemark.plans.registry import digits, query, rounded, rounded_sql, table
from tidemark.session import cut_lineage

ID = "sequence_id"


def embedding_features(spark, sf_dir):
    """One feature per embedding dimension, the label as class."""
    rows = table(spark, sf_dir, "embeddings")
    features = rows.select(F.col("vec_id").alias(ID), F.posexplode("embedding").alias("i", "v")).select(
        ID, F.concat(F.lit("dim_"), "i").alias("feature"), F.col("v").cast("double").alias("value")
    )
    return features, rows.select(F.col("vec_id").alias(ID), F.col("label").alias("target"))


EMB = """WITH data AS (SELECT vec_id, label AS y, 'dim_' || (i - 1) AS feature, embedding[i]::DOUBLE AS value
FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


def line_features(spark, sf_dir):
    """Four numeric line features; the return flag as class."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]
    # No columns of a line are a key, so its place in their order is its id.
    rows = with_position(table(spark, sf_dir, "lineitem").select(*order), [], order, ID)
    # Both results are read several times, so the places are worked out once.
    rows = cut_lineage(rows.select(ID, *order[4:]))
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    features = rows.select(ID, *names).unpivot([ID], names, "feature", "value")
    return features, rows.select(ID, F.col("l_returnflag").alias("target"))


def order_features(spark, sf_dir):
    """Features of orders against the total price, for a real target."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias(ID),
        F.col("o_totalprice").alias("target"),
        (F.col("o_custkey") % 97).cast("double").alias("cust_mod"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"),
        (F.col("o_orderstatus") == "O").cast("double").alias("is_open"),
        F.lit(1.0).alias("constant"),
    )
    names = ["cust_mod", "priority", "is_open", "constant"]
    return orders.select(ID, *names).unpivot([ID], names, "feature", "value"), orders.select(ID, "target")


ORD = """WITH wide AS (SELECT o_orderkey, o_totalprice AS y, (o_custkey % 97)::DOUBLE AS cust_mod,
substr(o_orderpriority, 1, 1)::DOUBLE AS priority, CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_open
FROM orders),
data AS (SELECT o_orderkey, y, 'cust_mod' AS feature, cust_mod AS value FROM wide
UNION ALL SELECT o_orderkey, y, 'priority', priority FROM wide
UNION ALL SELECT o_orderkey, y, 'is_open', is_open FROM wide)"""

_ANOVA = """stats AS (SELECT feature, y, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM data GROUP BY 1, 2),
grand AS (SELECT feature, sum(n) AS rows, count(*) AS k, sum(n * m) / sum(n) AS g, sum(n * v) AS within FROM stats GROUP BY 1),
scored AS (SELECT feature, (sum(n * pow(m - g, 2)) / (max(k) - 1)) / (max(within) / (max(rows) - max(k))) AS score
  FROM stats JOIN grand USING (feature) GROUP BY 1)"""


@query("anova_f_scores", rounded_sql(f"{EMB}, {_ANOVA} SELECT * FROM scored", ["feature"], {"score": 6}))
def _(spark, sf_dir):
    return rounded(sel.anova_scores(*embedding_features(spark, sf_dir)), ["feature"], {"score": 6})


@query(
    "top_k_anova",
    f"""{EMB}, {_ANOVA}, ranked AS (SELECT feature, row_number() OVER (ORDER BY score DESC, feature) AS r FROM scored)
SELECT feature, r <= 20 AS selected FROM ranked""",
)
def _(spark, sf_dir):
    return sel.select_k_best(*embedding_features(spark, sf_dir), k=20).select("feature", "selected")


@query("anova_uncorrected")
def _(spark, sf_dir):
    return sel.uncorrected_anova(*embedding_features(spark, sf_dir))


@query("anova_fdr")
def _(spark, sf_dir):
    return sel.fdr_anova(*embedding_features(spark, sf_dir))


@query(
    "anova_by_fold",
    rounded_sql(
        f"""{EMB}, folds AS (SELECT unnest(range(0, 5))::INTEGER AS fold),
stats AS (SELECT feature, fold, y, count(*) AS n, avg(value) AS m, var_pop(value) AS v
  FROM data JOIN folds ON vec_id % 5 <> fold GROUP BY 1, 2, 3),
grand AS (SELECT feature, fold, sum(n) AS rows, count(*) AS k, sum(n * m) / sum(n) AS g, sum(n * v) AS within
  FROM stats GROUP BY 1, 2)
SELECT feature, fold, (sum(n * pow(m - g, 2)) / (max(k) - 1)) / (max(within) / (max(rows) - max(k))) AS score
FROM stats JOIN grand USING (feature, fold) GROUP BY 1, 2""",
        ["feature", "fold"],
        {"score": 6},
    ),
)
def _(spark, sf_dir):
    features, targets = embedding_features(spark, sf_dir)
    folds = targets.select(ID, (F.col(ID) % 5).cast("int").alias("fold"))
    return rounded(sel.anova_scores_by_fold(features, targets, folds), ["feature", "fold"], {"score": 6})


@query(
    "regression_f_scores",
    rounded_sql(
        f"""{ORD} SELECT feature, pow(corr(value, y), 2) * (count(*) - 2) / (1 - pow(corr(value, y), 2)) AS score
FROM data GROUP BY 1 UNION ALL SELECT 'constant', 0.0::DOUBLE""",
        ["feature"],
        {"score": 6},
    ),
)
def _(spark, sf_dir):
    features, targets = order_features(spark, sf_dir)
    scores = sel.regression_scores(features, targets)
    return rounded(scores, ["feature"], {"score": 6})


@query(
    "correlation_threshold",
    f"""{EMB}, r AS (SELECT feature, corr(value, y) AS score FROM data GROUP BY 1)
SELECT feature, round(score, 6) AS score, abs(score) >= 0.05 AS selected FROM r""",
)
def _(spark, sf_dir):
    out = sel.correlation_threshold(*embedding_features(spark, sf_dir), threshold=0.05)
    return out.select("feature", F.round("score", 6).alias("score"), "selected")


@query(
    "variance_threshold",
    f"""{EMB}, v AS (SELECT feature, var_pop(value) AS score FROM data GROUP BY 1)
SELECT feature, round(score, 6) AS score, score > 0.015 AS selected FROM v""",
)
def _(spark, sf_dir):
    out = sel.variance_threshold(embedding_features(spark, sf_dir)[0], threshold=0.015)
    return out.select("feature", F.round("score", 6).alias("score"), "selected")


@query(
    "constant_features",
    f"""{ORD}, every AS (SELECT feature, value FROM data UNION ALL SELECT 'constant', 1.0 FROM wide)
SELECT feature, stddev_samp(value) > 0 AND stddev_samp(value) / (abs(avg(value)) + 1e-12) >= 1e-10 AS selected
FROM every GROUP BY 1""",
)
def _(spark, sf_dir):
    return sel.drop_constant(order_features(spark, sf_dir)[0]).select("feature", "selected")


_DOCS = """WITH wide AS (SELECT d.doc_id, n_chars::DOUBLE AS n_chars, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@query(
    "incomplete_features",
    f"""{_DOCS} SELECT 'n_chars' AS feature, count(*) = count(n_chars) AS selected FROM wide
UNION ALL SELECT 'quality', count(*) = count(quality) FROM wide
UNION ALL SELECT 'toxic', count(*) = count(toxic) FROM wide""",
)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    names = ["n_chars", "quality", "toxic"]
    cells = docs.select("doc_id", *[F.col(c).cast("double") for c in names])
    features = cells.unpivot(["doc_id"], names, "feature", "value")
    return sel.drop_incomplete(features).select("feature", "selected")


_RANK_SUM = """hist AS (SELECT feature, value, count(*) AS c FROM data GROUP BY 1, 2),
ranks AS (SELECT feature, value, c, sum(c) OVER (PARTITION BY feature ORDER BY value) - c + (c + 1) / 2 AS rk FROM hist),
ties AS (SELECT feature, sum(pow(c::DOUBLE, 3) - c) AS t, sum(c)::DOUBLE AS n FROM hist GROUP BY 1),
sums AS (SELECT feature, y AS label, sum(rk) AS r, count(*)::DOUBLE AS n1 FROM data JOIN ranks USING (feature, value) GROUP BY 1, 2),
tests AS (SELECT feature, label, r - n1 * (n1 + 1) / 2 AS u, n1, n - n1 AS n2, t, n FROM sums JOIN ties USING (feature))
SELECT feature, label, u, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) /
  sqrt(n1 * n2 / 12 * (n + 1 - t / (n * (n - 1)))) AS z FROM tests"""


@query("rank_sum_test", rounded_sql(f"{EMB}, {_RANK_SUM}", ["feature", "label"], {"u": 1, "z": 6}))
def _(spark, sf_dir):
    out = sel.mann_whitney(*embedding_features(spark, sf_dir))
    return rounded(out, ["feature", "label"], {"u": 1, "z": 6})


@query(
    "rank_sum_test_quality",
    rounded_sql(
        f"""WITH data AS (SELECT 'n_chars' AS feature, n_chars::DOUBLE AS value, quality AS y
FROM documents JOIN labels USING (doc_id)), {_RANK_SUM}""",
        ["feature", "label"],
        {"u": 1, "z": 6},
    ),
)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    features = docs.select(
        F.col("doc_id").alias(ID), F.lit("n_chars").alias("feature"), F.col("n_chars").cast("double").alias("value")
    )
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias(ID), F.col("quality").alias("target"))
    return rounded(sel.mann_whitney(features, labels), ["feature", "label"], {"u": 1, "z": 6})


@query(
    "two_sample_distance",
    rounded_sql(
        f"""{ORD}, flagged AS (SELECT feature, y, (value = max(value) OVER (PARTITION BY feature))::DOUBLE AS hi FROM data),
sizes AS (SELECT feature, sum(hi) AS n1, sum(1 - hi) AS n0 FROM flagged GROUP BY 1),
cum AS (SELECT feature, y, sum(sum(hi)) OVER (PARTITION BY feature ORDER BY y) AS c1,
sum(sum(1 - hi)) OVER (PARTITION BY feature ORDER BY y) AS c0 FROM flagged GROUP BY 1, 2)
SELECT feature, max(abs(c1 / n1 - c0 / n0)) AS distance FROM cum JOIN sizes USING (feature) GROUP BY 1
UNION ALL SELECT 'constant', NULL::DOUBLE""",
        ["feature"],
        {"distance": 6},
    ),
)
def _(spark, sf_dir):
    features, targets = order_features(spark, sf_dir)
    return rounded(sel.smirnov(features, targets), ["feature"], {"distance": 6})


def customer_features(spark, sf_dir):
    """Two features of customers, one with many ties, against the account balance."""
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias(ID),
        F.col("c_nationkey").cast("double").alias("nation"),
        ((F.col("c_custkey") * 37) % 1009).cast("double").alias("mixed"),
        F.col("c_acctbal").alias("target"),
    )
    features = rows.select(ID, "nation", "mixed").unpivot([ID], ["nation", "mixed"], "feature", "value")
    return features, rows.select(ID, "target")


_KENDALL = """WITH wide AS (SELECT c_custkey AS id, c_nationkey::DOUBLE AS nation, ((c_custkey * 37) % 1009)::DOUBLE AS mixed, c_acctbal AS y FROM customer),
data AS (SELECT id, 'nation' AS feature, nation AS x, y FROM wide UNION ALL SELECT id, 'mixed', mixed, y FROM wide),
s AS (SELECT feature, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS gap, count(*) FILTER (a.x <> b.x)::DOUBLE AS px,
  count(*) FILTER (a.y <> b.y)::DOUBLE AS py FROM data a JOIN data b USING (feature) WHERE a.id < b.id GROUP BY 1)
SELECT feature, round(gap / sqrt(px * py), 6) AS tau FROM s"""


@query("kendall_tau", _KENDALL)
def _(spark, sf_dir):
    out = sel.kendall(*customer_features(spark, sf_dir))
    return rounded(out, ["feature"], {"tau": 6})


def _nation_pairs(spark, sf_dir):
    """Per nation the balances of customers, of one market segment and of all others."""
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_nationkey", "c_acctbal", (F.col("c_mktsegment") == "BUILDING").alias("flag"))


@query(
    "two_sample_distance_exact",
    """WITH RECURSIVE d AS (SELECT c_nationkey AS nation, c_acctbal AS y, (c_mktsegment = 'BUILDING')::INTEGER AS hi FROM customer),
z AS (SELECT nation, sum(hi)::BIGINT AS n1, sum(1 - hi)::BIGINT AS n0 FROM d GROUP BY 1 HAVING sum(hi) > 0 AND sum(1 - hi) > 0),
cum AS (SELECT nation, y, sum(sum(hi)) OVER w AS c1, sum(sum(1 - hi)) OVER w AS c0 FROM d GROUP BY 1, 2 WINDOW w AS (PARTITION BY nation ORDER BY y)),
g AS (SELECT nation, n1, n0, max(abs(c1 * n0 - c0 * n1))::BIGINT AS edge FROM cum JOIN z USING (nation) GROUP BY 1, 2, 3),
walk AS (SELECT nation, n1, n0, edge, 0::BIGINT AS s, 0::BIGINT AS i, 1.0::DOUBLE AS inside, 0.0::DOUBLE AS out FROM g
  UNION ALL SELECT nation, n1, n0, edge, s + 1, j, sum(CASE WHEN abs(j * n0 - (s + 1 - j) * n1) < edge THEN part ELSE 0 END),
    sum(CASE WHEN abs(j * n0 - (s + 1 - j) * n1) >= edge THEN part ELSE 0 END)
  FROM (SELECT nation, n1, n0, edge, s, i + step AS j, inside * (CASE WHEN step = 1 THEN n1 - i ELSE n0 - (s - i) END) / (n1 + n0 - s)::DOUBLE AS part
        FROM walk, (VALUES (0), (1)) AS t(step) WHERE s < n1 + n0 AND inside > 0) AS moves
  WHERE j <= n1 AND s + 1 - j <= n0 GROUP BY nation, n1, n0, edge, s, j)
SELECT nation, round(edge / (n1 * n0)::DOUBLE, 6) AS distance, round(sum(out), 9) AS p_value FROM walk GROUP BY nation, n1, n0, edge""",
)
def _(spark, sf_dir):
    out = sel.two_sample_distance(_nation_pairs(spark, sf_dir), ["c_nationkey"], "c_acctbal", F.col("flag"))
    out = out.where("p_value IS NOT NULL").select(F.col("c_nationkey").alias("nation"), F.round("distance", 6).alias("distance"), F.round("p_value", 9).alias("p_value"))
    return out


@query(
    "kendall_tau_exact",
    """WITH RECURSIVE d AS (SELECT s_nationkey AS nation, s_suppkey AS x, s_acctbal AS y FROM supplier),
p AS (SELECT a.nation, count(*) FILTER ((a.x < b.x) <> (a.y < b.y)) AS dis, count(*) AS pairs FROM d a JOIN d b ON a.nation = b.nation AND a.x < b.x GROUP BY 1),
n AS (SELECT nation, count(*) AS n, count(DISTINCT y) = count(*) AS untied FROM d GROUP BY 1),
c AS (SELECT nation, n, least(dis, pairs - dis) AS fewer FROM p JOIN n USING (nation) WHERE untied AND n <= 33),
f AS (SELECT 1::BIGINT AS m, 0::BIGINT AS c, 1.0::DOUBLE AS chance
  UNION ALL SELECT m + 1, c + k, sum(chance) / (m + 1) FROM f, range(0, 33) AS r(k) WHERE m < 33 AND k <= m GROUP BY m, c + k)
SELECT nation::VARCHAR AS feature, round(least(1.0, 2 * sum(chance)), 9) AS p_value FROM c JOIN f ON f.m = c.n AND f.c <= c.fewer GROUP BY nation""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    features = rows.select(F.col("s_suppkey").alias(ID), F.col("s_nationkey").cast("string").alias("feature"), F.col("s_suppkey").cast("double").alias("value"))
    sizes = features.groupBy("feature").agg(F.count("*").alias("n")).where("n BETWEEN 2 AND 33").select("feature")
    targets = rows.select(F.col("s_suppkey").alias(ID), F.col("s_acctbal").alias("target"))
    out = sel.kendall(features.join(sizes, "feature"), targets)
    return out.select("feature", F.round("p_value", 9).alias("p_value"))


@query("relevance_table_classes")
def _(spark, sf_dir):
    return sel.relevance_table(*line_features(spark, sf_dir))


@query("relevance_table_real_target")
def _(spark, sf_dir):
    return sel.relevance_table(*order_features(spark, sf_dir), task_type="regression")


@query("fdr_selector")
def _(spark, sf_dir):
    return sel.fdr_selector(*embedding_features(spark, sf_dir))


@query(
    "mutual_information_binned",
    rounded_sql(
        f"""{EMB}, edges AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM data GROUP BY 1),
binned AS (SELECT feature, y, least(floor((value - lo) * 10 / (hi - lo)), 9) AS bin FROM data JOIN edges USING (feature)),
joint AS (SELECT feature, bin, y, count(*) AS c FROM binned GROUP BY 1, 2, 3),
cells AS (SELECT *, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, bin) AS cb,
  sum(c) OVER (PARTITION BY feature, y) AS cy FROM joint)
SELECT feature, sum(c / n * ln(c * n / (cb * cy))) AS score FROM cells GROUP BY 1""",
        ["feature"],
        {"score": 6},
    ),
)
def _(spark, sf_dir):
    out = sel.binned_mutual_information(*embedding_features(spark, sf_dir))
    return rounded(out, ["feature"], {"score": 6})


@query("mutual_information_neighbours")
def _(spark, sf_dir):
    return sel.mutual_information(*embedding_features(spark, sf_dir))


_NEAR = """WITH f AS (SELECT s_suppkey AS id, s_acctbal::DOUBLE AS balance, (s_suppkey * 7919 % 10007)::DOUBLE AS mixed, s_acctbal * s_acctbal / 1000 + s_suppkey % 7 AS bent,
  s_acctbal / 10 + (s_suppkey * 31 % 17) AS y FROM supplier),
raw AS (SELECT id, 'balance' AS feature, balance AS x, y FROM f UNION ALL SELECT id, 'mixed', mixed, y FROM f UNION ALL SELECT id, 'bent', bent, y FROM f),
d AS (SELECT id, feature, x / stddev_pop(x) OVER w AS x, y / stddev_pop(y) OVER w AS y FROM raw WINDOW w AS (PARTITION BY feature)),
pair AS (SELECT a.feature, a.id, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy FROM d a JOIN d b ON a.feature = b.feature AND a.id <> b.id),
k AS (SELECT feature, id, greatest(dx, dy) AS r FROM pair QUALIFY row_number() OVER (PARTITION BY feature, id ORDER BY greatest(dx, dy)) = 3),
m AS (SELECT feature, id, 1 + count(*) FILTER (dx < r) AS nx, 1 + count(*) FILTER (dy < r) AS ny FROM pair JOIN k USING (feature, id) GROUP BY 1, 2),
h AS (SELECT n, sum(1.0::DOUBLE / n) OVER (ORDER BY n) - 1.0::DOUBLE / n - 0.57721566490153286 AS psi FROM range(1, 100001) AS r(n)),
s AS (SELECT feature, avg(a.psi + b.psi) AS part, count(*) AS n FROM m JOIN h a ON a.n = nx JOIN h b ON b.n = ny GROUP BY 1)
SELECT feature, greatest(0.0, t.psi + u.psi - part) AS score FROM s JOIN h t ON t.n = s.n JOIN h u ON u.n = 3"""


@query("mutual_information_real_target", rounded_sql(_NEAR, ["feature"], {"score": 6}))
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    key, balance = F.col("s_suppkey"), F.col("s_acctbal").cast("double")
    wide = rows.select(
        key.alias(ID), balance.alias("balance"), (key * 7919 % 10007).cast("double").alias("mixed"), (balance * balance / 1000 + key % 7).alias("bent"),
        (balance / 10 + key * 31 % 17).alias("target"),
    )
    features = wide.select(ID, "balance", "mixed", "bent").unpivot([ID], ["balance", "mixed", "bent"], "feature", "value")
    return rounded(real_mutual_information(features, wide.select(ID, "target"), jitter=False), ["feature"], {"score": 6})


@query("l1_selector")
def _(spark, sf_dir):
    return trees.l1_selector(*embedding_features(spark, sf_dir), C=0.05)


@query(
    "l1_selector_single",
    """WITH d AS (SELECT s_acctbal::DOUBLE AS balance, (s_suppkey * 7919 % 10007)::DOUBLE AS mixed, s_suppkey % 7 AS week, s_acctbal / 10 + (s_suppkey * 31 % 17) AS y FROM supplier),
f AS (SELECT 'balance' AS feature, balance AS x, y FROM d UNION ALL SELECT 'mixed', mixed, y FROM d UNION ALL SELECT 'week', week, y FROM d),
s AS (SELECT feature, greatest(0.0, abs(covar_pop(y, x) / stddev_pop(x)) - 25.0) AS score FROM f GROUP BY feature)
SELECT feature, round(score, 6) AS score, score > 1e-5 AS selected FROM s""",
)
def _(spark, sf_dir):
    """Each feature alone, where the solution is the shrunken slope."""
    rows = table(spark, sf_dir, "supplier")
    key, balance = F.col("s_suppkey"), F.col("s_acctbal").cast("double")
    wide = rows.select(
        key.alias(ID), balance.alias("balance"), (key * 7919 % 10007).cast("double").alias("mixed"), (key % 7).cast("double").alias("week"),
        (balance / 10 + key * 31 % 17).alias("target"),
    )
    features = wide.select(ID, "balance", "mixed", "week").unpivot([ID], ["balance", "mixed", "week"], "feature", "value")
    out = None
    for name in ("balance", "mixed", "week"):
        part = trees.l1_selector(features.filter(F.col("feature") == name), wide.select(ID, "target"), alpha=25.0, task_type="regression")
        out = part if out is None else out.union(part)
    return out.select("feature", F.round("score", 6).alias("score"), "selected")


@query("l1_selector_real_target")
def _(spark, sf_dir):
    return trees.l1_selector(*order_features(spark, sf_dir), task_type="regression")


@query("tree_importance")
def _(spark, sf_dir):
    return trees.tree_importance(*embedding_features(spark, sf_dir), n_estimators=20, depth=8)


@query("boruta")
def _(spark, sf_dir):
    return trees.boruta(*line_features(spark, sf_dir), n_estimators=10)


@query("boruta_planted", "SELECT * FROM (VALUES ('copy', true), ('noise', false)) AS t(feature, selected) WHERE EXISTS (SELECT 1 FROM orders)")
def _(spark, sf_dir):
    """A copy of the class is kept, a hash of the key is not."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", ID)
    label = (F.col("o_orderstatus") == "O").cast("int")
    wide = orders.select(ID, label.cast("double").alias("copy"), F.pmod(F.xxhash64(ID), F.lit(1000)).cast("double").alias("noise"))
    targets = orders.select(ID, label.alias("target"))
    mask = trees.boruta(wide.unpivot([ID], ["copy", "noise"], "feature", "value"), targets, n_estimators=10)
    return mask.select("feature", "selected")


@query("subsampled_selector")
def _(spark, sf_dir):
    fitted = sel.SubsampledSelector("select_k_best", 0.5, k=10).fit(*embedding_features(spark, sf_dir))
    return fitted.get_support()


@query("subsampling_sweep")
def _(spark, sf_dir):
    return sel.subsampling_sweep(
        *embedding_features(spark, sf_dir), ratios=(0.2, 0.5, 1.0), base_selector="anova", k=10
    )


@query(
    "custom_score_top_k",
    f"""{EMB}, s AS (SELECT feature, max(value) - min(value) AS score FROM data GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, feature) AS r FROM s)
SELECT feature, round(score, 6) AS score, r <= 5 AS selected FROM r""",
)
def _(spark, sf_dir):
    def spread(features, targets):
        return features.groupBy("feature").agg((F.max("value") - F.min("value")).alias("score"))

    out = sel.select_k_best(*embedding_features(spark, sf_dir), k=5, score_func=spread)
    return out.select("feature", F.round("score", 6).alias("score"), "selected")


@query(
    "masked_features",
    f"""{EMB}, v AS (SELECT feature FROM data GROUP BY 1 HAVING var_pop(value) > 0.0155)
SELECT vec_id AS sequence_id, feature, round(value, 6) AS value FROM data SEMI JOIN v USING (feature)""",
)
def _(spark, sf_dir):
    features, _targets = embedding_features(spark, sf_dir)
    mask, _info = sel.with_fallback(sel.variance_threshold(features, threshold=0.0155))
    return sel.apply_mask(features, mask).select(ID, "feature", F.round("value", 6).alias("value"))


_STABILITY = """folds AS (SELECT unnest(range(0, 4))::INTEGER AS fold),
scores AS (SELECT feature, fold, abs(corr(value, y)) AS s FROM data JOIN folds ON vec_id % 4 <> fold GROUP BY 1, 2),
picked AS (SELECT fold, feature FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY s DESC, feature) AS r
  FROM scores) WHERE r <= 15)"""


def fold_selections(spark, sf_dir):
    """(fold, feature): the 15 best absolute correlations on each train part."""
    from tidemark.operators.compare import top_per_group

    features, targets = embedding_features(spark, sf_dir)
    folds = targets.select(ID, (F.col(ID) % 4).cast("int").alias("fold"))
    roles = splits.fold_roles(folds, 4).filter("role = 'train'").select(ID, "fold")
    data = sel.labelled(features, targets).join(roles, ID)
    scores = data.groupBy("feature", "fold").agg(F.abs(F.corr("value", F.col("y").cast("double"))).alias("s"))
    return top_per_group(scores, ["fold"], [F.desc("s"), F.asc("feature")], 15).select("fold", "feature")


@query(
    "selection_frequency",
    f"""{EMB}, {_STABILITY} SELECT feature, count(*) AS n_folds FROM picked GROUP BY 1
ORDER BY n_folds DESC, feature LIMIT 10""",
)
def _(spark, sf_dir):
    from tidemark.operators.compare import selection_frequency

    return selection_frequency(fold_selections(spark, sf_dir), 10)


@query(
    "selection_stability",
    f"""{EMB}, {_STABILITY}, pairs AS (SELECT a.fold AS f1, b.fold AS f2, count(*) AS common FROM picked a
JOIN picked b ON a.feature = b.feature AND a.fold < b.fold GROUP BY 1, 2),
sizes AS (SELECT fold, count(*) AS n FROM picked GROUP BY 1),
every AS (SELECT a.fold AS f1, b.fold AS f2, a.n AS n1, b.n AS n2 FROM sizes a JOIN sizes b ON a.fold < b.fold)
SELECT round(avg(coalesce(common, 0) / (n1 + n2 - coalesce(common, 0))), 6) AS jaccard
FROM every LEFT JOIN pairs USING (f1, f2)""",
)
def _(spark, sf_dir):
    from tidemark.operators.compare import selection_stability

    return selection_stability(fold_selections(spark, sf_dir)).select(F.round("jaccard", 6).alias("jaccard"))


# --- folds ---------------------------------------------------------------------------------------


def order_targets(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias(ID),
        F.col("o_orderstatus").alias("target"),
        F.col("o_custkey").alias("subject_id"),
        "o_orderdate",
    )


@query("stratified_folds_by_key", """WITH r AS (SELECT o_orderkey, o_orderstatus,
row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS p FROM orders),
c AS (SELECT o_orderstatus, coalesce(sum(count(*)) OVER (ORDER BY o_orderstatus ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM orders GROUP BY 1)
SELECT o_orderkey AS sequence_id, ((p + s) % 5)::INTEGER AS fold FROM r JOIN c USING (o_orderstatus)""")
def _(spark, sf_dir):
    return splits.stratified_k_fold(order_targets(spark, sf_dir), 5, seed=None)


@query(
    "stratified_fold_sizes",
    """SELECT fold::INTEGER AS fold, target, n_rows FROM (SELECT fold, o_orderstatus AS target, count(*) AS n_rows FROM
(SELECT o_orderstatus, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 + s) % 5 AS fold
 FROM orders JOIN (SELECT o_orderstatus, coalesce(sum(count(*)) OVER (ORDER BY o_orderstatus
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM orders GROUP BY 1) USING (o_orderstatus)) GROUP BY 1, 2)""",
)
def _(spark, sf_dir):
    targets = order_targets(spark, sf_dir)
    folds = splits.stratified_k_fold(targets, 5, seed=42)
    return folds.join(targets, ID).groupBy("fold", "target").agg(F.count("*").alias("n_rows"))


@query("shuffled_folds_sizes", """SELECT (unnest(range(0, 5)))::INTEGER AS fold,
(SELECT count(*) FROM orders) // 5 + CASE WHEN unnest(range(0, 5)) < (SELECT count(*) FROM orders) % 5 THEN 1 ELSE 0 END AS n_rows""")
def _(spark, sf_dir):
    folds = splits.k_fold(order_targets(spark, sf_dir), 5, seed=7)
    return folds.groupBy("fold").agg(F.count("*").alias("n_rows"))


@query(
    "group_folds_keep_groups",
    "SELECT count(DISTINCT o_custkey) AS n_groups, count(DISTINCT o_custkey) AS n_pairs, count(*) AS n_rows FROM orders",
)
def _(spark, sf_dir):
    targets = order_targets(spark, sf_dir)
    folds = splits.group_k_fold(targets, 5, splits.group_column(targets))
    rows = folds.join(targets, ID)
    return rows.agg(
        F.countDistinct("subject_id").alias("n_groups"),
        F.countDistinct("subject_id", "fold").alias("n_pairs"),
        F.count("*").alias("n_rows"),
    )


@query(
    "group_folds_balanced",
    """WITH c AS (SELECT o_custkey AS g, o_orderstatus AS target, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT target, sum(n)::BIGINT AS n_rows, 5::BIGINT AS n_folds, count(DISTINCT g)::BIGINT AS n_groups, true AS whole, true AS even FROM c GROUP BY target""",
)
def _(spark, sf_dir):
    """Per class: its rows, folds and groups, whether no group is in two folds, and whether each fold's part of the class is
    within the class's largest group of a fifth."""
    targets = order_targets(spark, sf_dir)
    rows = splits.group_k_fold(targets, 5, "subject_id", target="target").join(targets, ID)
    # All that follows is of these counts.
    counts = cut_lineage(rows.groupBy("subject_id", "target", "fold").agg(F.count("*").alias("n")))
    groups = counts.groupBy("subject_id").agg(F.max("fold").alias("last"), F.min("fold").alias("first"))
    split = groups.agg(F.count_if(F.col("last") > F.col("first")).alias("split"))
    cells = counts.groupBy("target", "fold").agg(F.sum("n").alias("n"))
    largest = counts.groupBy("target", "subject_id").agg(F.sum("n").alias("n")).groupBy("target").agg(F.max("n").alias("largest"), F.count("*").alias("n_groups"))
    off = F.max(F.abs(F.col("n") - F.col("total") / 5))
    totals = cells.groupBy("target").agg(F.sum("n").alias("total"), F.count("*").alias("n_folds"))
    worst = cells.join(totals, "target").groupBy("target", "total", "n_folds").agg(off.alias("off")).join(largest, "target")
    whole = F.lit(split.first()["split"] == 0)
    return worst.select("target", F.col("total").alias("n_rows"), "n_folds", "n_groups", whole.alias("whole"), (F.col("off") <= F.col("largest")).alias("even"))


_ORDERED = """WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS p,
count(*) OVER () AS n FROM orders)"""


@query(
    "purged_blocked_folds",
    f"""{_ORDERED}, f AS (SELECT unnest(range(0, 5))::INTEGER AS fold),
s AS (SELECT *, fold * (n // 5) AS a, CASE WHEN fold = 4 THEN n ELSE (fold + 1) * (n // 5) END AS b FROM r, f)
SELECT o_orderkey AS sequence_id, fold, CASE WHEN p >= a AND p < b THEN 'test' ELSE 'train' END AS role
FROM s WHERE (p >= a AND p < b) OR p < a - 7 OR p >= b + 7""",
)
def _(spark, sf_dir):
    return splits.purged_blocked_splits(order_targets(spark, sf_dir), 5, 7, ["o_orderdate", ID])


@query(
    "contiguous_chunks",
    """SELECT o_orderkey AS sequence_id, (ntile(7) OVER (ORDER BY o_orderdate, o_orderkey) - 1)::INTEGER AS fold FROM orders""",
)
def _(spark, sf_dir):
    return splits.blocked_folds(order_targets(spark, sf_dir), 7, ["o_orderdate", ID])


@query(
    "stratified_time_blocks",
    """SELECT o_orderkey AS sequence_id,
(ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) - 1)::INTEGER AS fold FROM orders""",
)
def _(spark, sf_dir):
    return splits.blocked_folds(order_targets(spark, sf_dir), 4, ["o_orderdate", ID], target="target")


@query(
    "expanding_time_splits",
    f"""{_ORDERED}, f AS (SELECT unnest(range(0, 3))::INTEGER AS fold),
s AS (SELECT *, n - (3 - fold) * (n // 4) AS a FROM r, f)
SELECT o_orderkey AS sequence_id, fold, CASE WHEN p < a THEN 'train' ELSE 'test' END AS role FROM s WHERE p < a + n // 4""",
)
def _(spark, sf_dir):
    return splits.expanding_splits(order_targets(spark, sf_dir), 3, ["o_orderdate", ID])


@query(
    "chronological_holdout",
    f"""{_ORDERED} SELECT o_orderkey AS sequence_id, CASE WHEN p < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS role
FROM r""",
)
def _(spark, sf_dir):
    return splits.holdout(order_targets(spark, sf_dir), 0.2, order=["o_orderdate", ID])


@query(
    "stratified_holdout_sizes",
    """SELECT o_orderstatus AS target, floor(count(*) * 0.7::DOUBLE)::BIGINT AS n_train FROM orders GROUP BY 1""",
)
def _(spark, sf_dir):
    targets = order_targets(spark, sf_dir)
    roles = splits.holdout(targets, 0.3, target="target").filter("role = 'train'")
    return roles.join(targets, ID).groupBy("target").agg(F.count("*").alias("n_train"))


@query(
    "repeated_fold_sizes",
    """SELECT (unnest(range(0, 3)))::INTEGER AS repeat, (SELECT count(*) FROM orders) AS n_rows,
(SELECT count(*) FROM orders) AS n_ids""",
)
def _(spark, sf_dir):
    folds = splits.repeated_stratified_k_fold(order_targets(spark, sf_dir), 4, (1, 2, 3))
    return folds.groupBy("repeat").agg(F.count("*").alias("n_rows"), F.countDistinct(ID).alias("n_ids"))


@query(
    "fold_class_balance",
    """WITH f AS (SELECT unnest(range(0, 3))::INTEGER AS fold), t AS (SELECT vec_id, label FROM embeddings),
r AS (SELECT fold, CASE WHEN vec_id % 3 = fold THEN 'test' ELSE 'train' END AS role, label FROM t, f)
SELECT fold, role, count(*) AS n_rows, count(*) FILTER (label > 0) AS positives, count(*) FILTER (label <= 0) AS negatives,
count(*) FILTER (label > 0) = 0 OR count(*) FILTER (label <= 0) = 0 AS single_class FROM r GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    _features, targets = embedding_features(spark, sf_dir)
    folds = targets.select(ID, (F.col(ID) % 3).cast("int").alias("fold"))
    return splits.fold_balance(splits.fold_roles(folds, 3), targets)
