"""Queries that write the tables out as raw files and ingest them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.windowing import segment_time_series
from tidemark.plans.feature_queries import scratch_folder
from tidemark.plans.registry import digits, query, rounded, rounded_sql, table
from tidemark.plans.window_queries import TYPE_CODES
from tidemark.sources import ingest
from tidemark.sources.tables import load_dataset, null_counts, read_pair, write_pair

ORDER = ["ts", "event_id"]
WINDOW = 50


def staged(df: DataFrame, order: list[str], columns: dict[str, Column], path: str, **options) -> str:
    """Part files whose names follow the given order, as CSV with a header."""
    rows = df.repartitionByRange(4, *order).sortWithinPartitions(*order)
    rows.select(*[c.alias(n) for n, c in columns.items()]).write.csv(path, header=True, **options)
    return path


def staged_lines(df: DataFrame, order: list[str], line: Column, path: str) -> str:
    rows = df.repartitionByRange(3, *order).sortWithinPartitions(*order)
    rows.select(line.alias("value")).write.text(path)
    return path


_P = """WITH pos AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS p, count(*) OVER () AS n FROM events),
win AS (SELECT p // 50 AS sequence_id, (p % 50)::INTEGER AS step, * FROM pos WHERE p // 50 < n // 50)"""


@query(
    "ingest_machine_log",
    """WITH pos AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS p, count(*) OVER () AS n FROM events),
win AS (SELECT p // 50 AS sequence_id, (p % 50)::INTEGER AS step, * FROM pos WHERE p // 50 < n // 50),
last AS (SELECT sequence_id, (event_type = 'error')::INTEGER AS target FROM win WHERE step = 49)
SELECT sequence_id, step, CASE event_type WHEN 'click' THEN 0.0 WHEN 'error' THEN 1.0 WHEN 'purchase' THEN 2.0 END::DOUBLE AS kind,
value AS torque, target FROM win JOIN last USING (sequence_id)""",
)
def _(spark, sf_dir):
    kind = F.create_map(*[F.lit(v) for v in ("click", "L", "error", "M", "purchase", "H")])[F.col("event_type")]
    columns = {"UDI": F.col("event_id"), "Product ID": F.col("user_id"), "Type": F.coalesce(kind, F.lit("?"))}
    columns |= {c: F.col("value") for c in ingest.MACHINE_SIGNALS[1:]}
    columns |= {c: F.lit(0) for c in ingest.LEAK_COLUMNS}
    columns["Machine failure"] = (F.col("event_type") == "error").cast("int")
    path = staged(table(spark, sf_dir, "events"), ["event_id"], columns, f"{scratch_folder(spark)}/log.csv")
    sequences, targets = ingest.ingest_machine_log(spark, path, WINDOW)
    rows = sequences.select("sequence_id", "step", F.col("Type").alias("kind"), F.col("`Torque [Nm]`").alias("torque"))
    return rows.join(targets, "sequence_id")


@query(
    "ingest_channel_log",
    f"""{_P}, last AS (SELECT sequence_id, (user_id % 4)::INTEGER AS target FROM win WHERE step = 49)
SELECT sequence_id, step, CASE WHEN event_type = 'view' THEN 0.0 ELSE value END AS x1, value + 16 AS x16, target
FROM win JOIN last USING (sequence_id)""",
)
def _(spark, sf_dir):
    first = F.when(F.col("event_type") == "view", "nan").otherwise(F.col("value").cast("string"))
    columns = {"y": F.col("user_id") % 4, "X1": first} | {f"X{i}": F.col("value") + i for i in range(2, 17)}
    path = staged(table(spark, sf_dir, "events"), ORDER, columns, f"{scratch_folder(spark)}/eeg.csv")
    sequences, targets = ingest.ingest_eeg(spark, path, WINDOW, label_strategy="last")
    return sequences.select("sequence_id", "step", F.col("X1").alias("x1"), F.col("X16").alias("x16")).join(targets, "sequence_id")


@query(
    "ingest_building_log",
    rounded_sql(
        f"""{_P} SELECT sequence_id, avg(CASE WHEN event_type = 'view' THEN 0.0 ELSE value END) AS target, sum(value) AS lights FROM win GROUP BY 1""",
        ["sequence_id"],
        digits(["target", "lights"], 5),
    ),
)
def _(spark, sf_dir):
    messy = F.when(F.col("event_type") == "view", "n/a").otherwise(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")))
    columns = {"Appliances": messy} | {c: F.col("value") for c in ingest.ENERGY_SIGNALS}
    path = staged(table(spark, sf_dir, "events"), ORDER, columns, f"{scratch_folder(spark)}/energy.csv")
    sequences, targets = ingest.ingest_energy(spark, path, WINDOW)
    sums = sequences.groupBy("sequence_id").agg(F.sum("lights").alias("lights"))
    return rounded(targets.join(sums, "sequence_id"), ["sequence_id"], digits(["target", "lights"], 5))


@query(
    "ingest_air_quality_log",
    rounded_sql(
        f"""{_P}, filled AS (SELECT event_id, coalesce(
  last_value(v IGNORE NULLS) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(v IGNORE NULLS) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS y
  FROM (SELECT event_id, p, CASE WHEN event_type <> 'view' THEN value END AS v FROM pos))
SELECT sequence_id, avg(y) AS target, sum((event_type = 'click')::INTEGER) AS clicks FROM win JOIN filled USING (event_id) GROUP BY 1""",
        ["sequence_id"],
        digits(["target", "clicks"], 5),
    ),
)
def _(spark, sf_dir):
    level = F.when(F.col("event_type") != "view", F.col("value").cast("string")).otherwise("NA")
    columns = {"pm2.5": level, "cbwd": F.col("event_type")} | {c: F.col("value") for c in ingest.AIR_SIGNALS}
    path = staged(table(spark, sf_dir, "events"), ORDER, columns, f"{scratch_folder(spark)}/air.csv")
    sequences, targets = ingest.ingest_air_quality(spark, path, WINDOW)
    clicks = sequences.groupBy("sequence_id").agg(F.sum("cbwd_click").alias("clicks"))
    return rounded(targets.join(clicks, "sequence_id"), ["sequence_id"], digits(["target", "clicks"], 5))


@query(
    "ingest_activity_matrix",
    """WITH e AS (SELECT *, CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END AS part FROM embeddings),
ids AS (SELECT *, row_number() OVER (ORDER BY part, vec_id) - 1 AS sequence_id FROM e)
SELECT sequence_id, (i - 1)::INTEGER AS step, embedding[i]::DOUBLE AS first, 2 * embedding[i]::DOUBLE AS second, label::INTEGER AS target,
(vec_id % 7)::INTEGER AS subject_id FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM ids)""",
)
def _(spark, sf_dir):
    folder = f"{scratch_folder(spark)}/activity"
    vectors = table(spark, sf_dir, "embeddings")
    for split, part in (("train", vectors.filter("vec_id % 5 <> 0")), ("test", vectors.filter("vec_id % 5 = 0"))):
        for signal, scale in (("first", 1.0), ("second", 2.0)):
            line = F.array_join(F.transform("embedding", lambda v: (v.cast("double") * scale).cast("string")), "  ")
            staged_lines(part, ["vec_id"], line, f"{folder}/{split}/Inertial Signals/{signal}_{split}.txt")
        staged_lines(part, ["vec_id"], F.col("label").cast("string"), f"{folder}/{split}/y_{split}.txt")
        staged_lines(part, ["vec_id"], (F.col("vec_id") % 7).cast("string"), f"{folder}/{split}/subject_{split}.txt")
    sequences, targets = ingest.ingest_activity(spark, folder, ["first", "second"])
    return sequences.join(targets.select("sequence_id", "target", "subject_id"), "sequence_id")


@query(
    "ingest_sparse_batches",
    """WITH src AS (SELECT *, (1 + o_orderkey % 3)::INTEGER AS batch FROM orders),
ids AS (SELECT *, row_number() OVER (ORDER BY batch, o_orderkey) - 1 AS sequence_id FROM src)
SELECT sequence_id, s::INTEGER AS step, CASE s WHEN 0 THEN o_totalprice ELSE o_custkey::DOUBLE END AS sensor_0,
CASE s WHEN 1 THEN 2 * o_totalprice ELSE 0.0 END::DOUBLE AS sensor_15, length(o_orderpriority)::INTEGER AS target, batch
FROM ids CROSS JOIN (SELECT unnest(range(0, 2)) AS s)""",
)
def _(spark, sf_dir):
    folder = f"{scratch_folder(spark)}/gas"
    orders = table(spark, sf_dir, "orders")
    line = F.concat(
        F.length("o_orderpriority").cast("string"), F.lit(";1.5 1:"), F.col("o_totalprice").cast("string"),
        F.lit(" 17:"), F.col("o_custkey").cast("string"), F.lit(" 32:"), (2 * F.col("o_totalprice")).cast("string"),
    )
    for batch in (1, 2, 3):
        part = orders.filter(1 + F.col("o_orderkey") % 3 == batch)
        staged_lines(part, ["o_orderkey"], line, f"{folder}/batch{batch}.dat")
    sequences, targets = ingest.ingest_gas_sensors(spark, folder, width=32, steps=2)
    out = sequences.join(targets, "sequence_id")
    return out.select("sequence_id", "step", "sensor_0", "sensor_15", "target", "batch")


@query(
    "delimited_scan_options",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_totalprice END AS price,
o_custkey::DOUBLE * 1000 AS units FROM orders""",
)
def _(spark, sf_dir):
    columns = {
        "o_orderkey": F.col("o_orderkey"),
        "price": F.when(F.col("o_orderstatus") == "O", "missing").otherwise(F.col("o_totalprice").cast("string")),
        "units": F.format_number(F.col("o_custkey") * 1000, 0),
    }
    path = staged(table(spark, sf_dir, "orders"), ["o_orderkey"], columns, f"{scratch_folder(spark)}/tabs.csv", sep="\t")
    rows = ingest.read_delimited(
        spark, path, sep="\t", encoding="ISO-8859-1", null_values=["missing"], thousands=",", numeric=["price", "units"]
    )
    return rows.withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


@query("whitespace_scan", "SELECT s_suppkey::DOUBLE AS _c0, s_acctbal AS _c1 FROM supplier")
def _(spark, sf_dir):
    line = F.concat_ws("   ", F.col("s_suppkey").cast("string"), F.col("s_acctbal").cast("string"))
    path = staged_lines(table(spark, sf_dir, "supplier"), ["s_suppkey"], line, f"{scratch_folder(spark)}/blank.txt")
    return ingest.read_delimited(spark, path, sep=r"\s+", header=False, numeric=["_c0", "_c1"])


@query(
    "numeric_matrix_scan",
    f"""SELECT row_number() OVER (ORDER BY event_id) - 1 AS "row", coalesce(CASE event_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in TYPE_CODES.items() if k != "view")} END, 0)::DOUBLE AS kind, value FROM events""",
)
def _(spark, sf_dir):
    codes = {k: float(v) for k, v in TYPE_CODES.items() if k != "view"}
    columns = {"id": F.col("event_id"), "kind": F.col("event_type"), "value": F.col("value")}
    path = staged(table(spark, sf_dir, "events"), ["event_id"], columns, f"{scratch_folder(spark)}/matrix.csv")
    return ingest.numeric_matrix(spark, path, ["id"], {"kind": codes})


@query(
    "load_by_name",
    """WITH pos AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS p, count(*) OVER () AS n FROM events),
votes AS (SELECT p // 200 AS sequence_id, (user_id % 4)::INTEGER AS y, count(*) AS c FROM pos WHERE p // 200 < n // 200 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY c DESC, y) AS r FROM votes)
SELECT sequence_id, y AS target FROM ranked WHERE r = 1""",
)
def _(spark, sf_dir):
    folder = scratch_folder(spark)
    columns = {"y": F.col("user_id") % 4} | {f"X{i}": F.col("value") for i in range(1, 17)}
    path = staged(table(spark, sf_dir, "events"), ORDER, columns, f"{folder}/eeg.csv")
    load_dataset(spark, "beed", path, f"{folder}/stored")
    # Stored by now: the raw file is not asked for.
    return load_dataset(spark, "beed", None, f"{folder}/stored")[1]


@query("stored_pair_null_audit", f"{_P} SELECT 'x' AS \"column\", count(*) FILTER (event_type = 'view') AS n_null FROM win")
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = events.withColumn("x", F.when(F.col("event_type") != "view", F.col("value")))
    folder = scratch_folder(spark)
    sequences, targets = segment_time_series(rows, WINDOW, None, ORDER, ["x"], "user_id", "last")
    write_pair(sequences, targets, folder)
    return null_counts(read_pair(spark, folder)[0]).filter(F.col("column") == "x").select("column", "n_null")
