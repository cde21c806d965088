"""Stored sequence and target pairs, exports and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tidemark.functions.expr import ID_NAMES, STEP_NAMES
from tidemark.sources.ingest import INGEST

SEQUENCES, TARGETS = "time_series.parquet", "targets.parquet"
EXPORTS = ("parquet", "csv")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(location)


def write_pair(sequences: DataFrame, targets: DataFrame, folder: str, mode: str = "overwrite") -> None:
    sequences.write.mode(mode).parquet(f"{folder}/{SEQUENCES}")
    targets.write.mode(mode).parquet(f"{folder}/{TARGETS}")


def read_pair(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/{SEQUENCES}"), spark.read.parquet(f"{folder}/{TARGETS}")


def load_dataset(spark: SparkSession, name: str, raw: str | None = None, processed: str = "") -> tuple[DataFrame, DataFrame]:
    """The stored pair by name or folder; a known dataset that is not stored yet is ingested first."""
    folder = f"{processed}/{name}" if processed else name
    if path_exists(spark, f"{folder}/{SEQUENCES}"):
        return read_pair(spark, folder)
    if name not in INGEST or raw is None:
        raise KeyError(f"unknown dataset {name}")
    write_pair(*INGEST[name](spark, raw), folder)
    return read_pair(spark, folder)


def export_table(df: DataFrame, path: str, extension: str = "parquet") -> None:
    """Parquet, or CSV with a header; nested columns go to CSV as JSON."""
    if extension not in EXPORTS:
        raise ValueError(f"extension must be one of {EXPORTS}, got {extension}")
    if not isinstance(df, DataFrame):
        raise TypeError("a DataFrame is required")
    if extension == "parquet":
        df.write.mode("overwrite").parquet(path)
        return
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").csv(path, header=True)


def null_counts(df: DataFrame) -> DataFrame:
    """(column, n_null, n_nan) of every column, in one pass."""
    def nan(f):
        floating = isinstance(f.dataType, (T.DoubleType, T.FloatType))
        return F.count_if(F.isnan(f"`{f.name}`")) if floating else F.lit(0).cast("bigint")

    cells = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.count_if(F.col(f"`{f.name}`").isNull()).alias("n_null"),
            nan(f).alias("n_nan"),
        )
        for f in df.schema.fields
    ]
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def validate_pair(spark: SparkSession, folder: str) -> bool:
    """Whether both tables exist, have their key columns and no nulls in any column."""
    try:
        sequences, targets = read_pair(spark, folder)
    except AnalysisException:
        return False
    has_keys = any(c in sequences.columns for c in ID_NAMES) and any(c in sequences.columns for c in STEP_NAMES)
    if not has_keys or "target" not in targets.columns:
        return False
    return all(null_counts(t).filter("n_null > 0").isEmpty() for t in (sequences, targets))


def leaked_columns(spark: SparkSession, path: str, suspects: Sequence[str]) -> list[str]:
    """Suspect columns present in a stored table, from its schema alone."""
    return [c for c in spark.read.parquet(path).columns if c in set(suspects)]
