"""Raw files to sequence and target tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.functions.expr import fill_missing, one_hot, parse_number, parse_thousands, recode
from tidemark.operators.position import prefix_sums, running_last, with_position
from tidemark.operators.windowing import segment_time_series
from tidemark.session import require_small

# Machine log: failure causes that give the target away, and the signals.
# Column names and codes of the public files.
LEAK_COLUMNS = ("TWF", "HDF", "PWF", "OSF", "RNF")
MACHINE_SIGNALS = (
    "Type",
    "Air temperature [K]",
    "Process temperature [K]",
    "Rotational speed [rpm]",
    "Torque [Nm]",
    "Tool wear [min]",
)
MACHINE_TYPES = {"L": 0, "M": 1, "H": 2}
# Building log: sensor columns.
ENERGY_SIGNALS = (
    "lights", "T1", "RH_1", "T2", "RH_2", "T3", "RH_3", "T4", "RH_4", "T5", "RH_5", "T6", "RH_6", "T7", "RH_7",
    "T8", "RH_8", "T9", "RH_9", "T_out", "Press_mm_hg", "RH_out", "Windspeed", "Visibility", "Tdewpoint",
)
# Air quality log: weather columns.
AIR_SIGNALS = ("DEWP", "TEMP", "PRES", "Iws", "Is", "Ir")
# Activity recordings: one file per signal.
ACTIVITY_SIGNALS = (
    "body_acc_x",
    "body_acc_y",
    "body_acc_z",
    "body_gyro_x",
    "body_gyro_y",
    "body_gyro_z",
    "total_acc_x",
    "total_acc_y",
    "total_acc_z",
)


def _ordered(df: DataFrame) -> DataFrame:
    """Add the columns that order the rows of text files: block start, then reading order."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__line"),
    )


def with_row_index(df: DataFrame, index: str = "time") -> DataFrame:
    """0-based row number, files in path order, without pulling a file into one task."""
    rows = with_position(_ordered(df), ["__file"], ["__block", "__line"], "__p")
    files = _ordered(df).groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    # One row per file.
    starts = prefix_sums(files, [], ["__file"], {"__rows": F.col("__n")})
    rows = rows.join(starts.select("__file", "__rows_before"), "__file")
    rows = rows.withColumn(index, F.col("__rows_before") + F.col("__p"))
    return rows.drop("__block", "__line", "__p", "__rows_before", "__file")


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    header: bool = True,
    encoding: str = "UTF-8",
    null_values: Sequence[str] = (),
    thousands: str | None = None,
    numeric: Sequence[str] = (),
) -> DataFrame:
    """Delimited text as strings; `sep` may be the pattern `\\s+`. `numeric` columns become doubles."""
    if sep == r"\s+":
        lines = spark.read.option("encoding", encoding).text(path)
        parts = F.split(F.trim("value"), r"\s+")
        head = spark.read.option("encoding", encoding).text(path).select(parts.alias("p")).first()["p"]
        names = head if header else [f"_c{i}" for i in range(len(head))]
        rows = lines.select(parts.alias("p")).filter(F.size("p") == len(names))
        if header:
            rows = rows.filter(F.col("p") != F.array(*[F.lit(h) for h in head]))
        df = rows.select(*[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(names)])
    else:
        df = spark.read.csv(path, sep=sep, header=header, encoding=encoding)
    if null_values:
        df = df.withColumns(
            {c: F.when(~F.col(f"`{c}`").isin(list(null_values)), F.col(f"`{c}`")) for c in df.columns}
        )
    parse = (lambda c: parse_thousands(c, thousands)) if thousands else (lambda c: parse_number(c, None))
    return df.withColumns({c: parse(F.col(f"`{c}`")) for c in numeric})


def ingest_machine_log(
    spark: SparkSession,
    path: str,
    window_size: int = 200,
    stride: int | None = None,
    label_strategy: str = "last",
    windowed: bool = True,
):
    """Machine log: leak columns dropped, type recoded; (sequences, targets) or the long table."""
    raw = spark.read.csv(path, header=True).drop(*LEAK_COLUMNS, "Product ID")
    rows = raw.select(
        F.col("UDI").cast("int").alias("time"),
        recode("Type", MACHINE_TYPES).cast("double").alias("Type"),
        *[F.col(f"`{c}`").cast("double").alias(c) for c in MACHINE_SIGNALS[1:]],
        F.col("`Machine failure`").cast("int").alias("target"),
    )
    if not windowed:
        return rows.withColumn("id", F.lit(1))
    return segment_time_series(rows, window_size, stride, "time", MACHINE_SIGNALS, "target", label_strategy)


def ingest_eeg(
    spark: SparkSession,
    path: str,
    window_size: int = 200,
    stride: int | None = None,
    label_strategy: str = "majority_vote",
    windowed: bool = True,
):
    """EEG log: row order as time, sixteen channels, missing values 0."""
    channels = [f"X{i}" for i in range(1, 17)]
    rows = with_row_index(spark.read.csv(path, header=True)).select(
        "time", *[fill_missing(F.col(c).try_cast("double")).alias(c) for c in channels], F.col("y").cast("int").alias("target")
    )
    if not windowed:
        return rows.withColumn("id", F.lit(1))
    return segment_time_series(rows, window_size, stride, "time", channels, "target", label_strategy)


def ingest_energy(spark: SparkSession, path: str, window_size: int = 144, stride: int | None = None):
    """Building log: forgiving number parse, mean consumption of the window as target."""
    raw = with_row_index(spark.read.csv(path, header=True))
    rows = raw.select(
        "time", parse_number("Appliances").alias("target"), *[parse_number(c).alias(c) for c in ENERGY_SIGNALS]
    )
    return segment_time_series(rows, window_size, stride, "time", ENERGY_SIGNALS, "target", "mean")


def ingest_air_quality(spark: SparkSession, path: str, window_size: int = 24, stride: int | None = None):
    """Air quality log: target filled forwards then backwards, wind direction one-hot."""
    raw = with_row_index(spark.read.csv(path, header=True))
    raw = raw.withColumn("__pm", F.nanvl(F.col("`pm2.5`").try_cast("double"), F.lit(None)))
    winds = raw.select("cbwd").filter("cbwd IS NOT NULL").distinct()
    require_small(winds, "the list of wind directions")
    names = sorted(r[0] for r in winds.collect())
    rows = running_last(raw, [], ["time"], {"target": "__pm"})
    rows = rows.withColumn("target", F.coalesce("target", F.lit(0.0)))
    rows = one_hot(rows, "cbwd", names).withColumns({c: F.col(c).try_cast("double") for c in AIR_SIGNALS})
    features = [*AIR_SIGNALS, *[f"cbwd_{n}" for n in names]]
    return segment_time_series(rows, window_size, stride, "time", features, "target", "mean")


def ingest_activity(spark: SparkSession, folder: str, signals: Sequence[str] = ACTIVITY_SIGNALS):
    """Recordings with one blank-parted row of values per sequence and one file per signal.

    Files are joined on (split, line); sequence ids run over the train lines, then the test lines.
    """
    def lines(path: str, split: str) -> DataFrame:
        rows = with_row_index(spark.read.text(path).filter(F.trim("value") != ""), "line")
        return rows.select(F.lit(split).alias("split"), "line", F.trim("value").alias("value"))

    sequences, targets = None, None
    for split in ("train", "test"):
        base = f"{folder}/{split}"
        labels = lines(f"{base}/y_{split}.txt", split).select("split", "line", F.col("value").cast("int").alias("target"))
        try:
            people = lines(f"{base}/subject_{split}.txt", split)
            people = people.select("split", "line", F.col("value").cast("int").alias("subject_id"))
            labels = labels.join(people, ["split", "line"]).withColumn("group", F.col("subject_id"))
        except AnalysisException:
            pass
        rows = None
        for signal in signals:
            one = lines(f"{base}/Inertial Signals/{signal}_{split}.txt", split)
            one = one.select(
                "split", "line", F.posexplode(F.split("value", r"\s+")).alias("step", "v")
            ).select("split", "line", "step", F.col("v").cast("double").alias(signal))
            rows = one if rows is None else rows.join(one, ["split", "line", "step"])
        sequences = rows if sequences is None else sequences.unionByName(rows)
        targets = labels if targets is None else targets.unionByName(labels, allowMissingColumns=True)
    n_train = targets.filter("split = 'train'").agg(F.count(F.lit(1)).alias("n")).scalar()
    number = F.when(F.col("split") == "train", F.col("line")).otherwise(F.col("line") + n_train)

    def numbered(df: DataFrame) -> DataFrame:
        return df.withColumn("sequence_id", number).drop("split", "line")

    return numbered(sequences).select("sequence_id", "step", *signals), numbered(targets)


def ingest_gas_sensors(spark: SparkSession, folder: str, width: int = 128, steps: int = 8):
    """Sparse lines `label;concentration idx:value ...`, one file per batch, cut into steps.

    The values of a line are static features laid out as `steps` rows, not a series in time.
    """
    channels = width // steps
    text = spark.read.text(f"{folder}/batch*.dat").filter(F.trim("value") != "")
    number = F.regexp_extract(F.col("_metadata.file_path"), r"batch(\d+)\.dat", 1).cast("int")
    rows = with_row_index(text.withColumn("batch", number), "line")
    rows = with_position(rows, [], ["batch", "line"], "sequence_id")
    parts = F.split(F.trim("value"), r"\s+")
    label = F.split(F.get(parts, F.lit(0)), ";")
    items = F.filter(F.slice(parts, 2, F.size(parts)), lambda p: p.contains(":"))
    pairs = F.map_from_entries(
        F.transform(
            items,
            lambda p: F.struct(F.split(p, ":")[0].cast("int").alias("k"), F.split(p, ":")[1].cast("double").alias("v")),
        )
    )
    rows = rows.select("sequence_id", "batch", F.get(label, F.lit(0)).cast("int").alias("target"), pairs.alias("m"))
    cells = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    values = {
        f"sensor_{c}": F.coalesce(F.col("m")[(F.col("step") * channels + c + 1).cast("int")], F.lit(0.0))
        for c in range(channels)
    }
    sequences = cells.withColumns(values).select("sequence_id", "step", *values)
    return sequences, rows.select("sequence_id", "target", "batch", F.col("batch").alias("group"))


def numeric_matrix(spark: SparkSession, path: str, drop: Sequence[str], codes: Mapping[str, Mapping]) -> DataFrame:
    """CSV as doubles in file order; coded columns map unknown values to 0."""
    raw = with_row_index(spark.read.csv(path, header=True), "row")
    names = [c for c in raw.columns if c not in drop and c != "row"]
    cells = [
        (recode(c, codes[c], 0.0) if c in codes else F.col(f"`{c}`")).cast("double").alias(c) for c in names
    ]
    return raw.select("row", *cells)


# Ingest jobs by dataset name: raw location -> (sequences, targets).
INGEST: dict[str, Callable] = {
    "pred-maintenance": ingest_machine_log,
    "beed": ingest_eeg,
    "har": ingest_activity,
    "appliances-energy": ingest_energy,
    "beijing-pm25": ingest_air_quality,
    "gas-sensor-drift": ingest_gas_sensors,
}
