"""Long tables to arrays and matrices and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import id_column, natural_order, select_except, step_column
from tidemark.operators.position import group_sizes
from tidemark.session import MAX_GROUP_ROWS, limit


def _field(name: str):
    return lambda s: s[name]


def sequence_arrays(
    df: DataFrame, ids: str | None = None, step: str | None = None, channels: Sequence[str] | None = None
) -> DataFrame:
    """One row per sequence: `length` and one ordered array per channel.

    A row must hold the whole sequence, so the longest one is measured first.
    """
    ids, step = ids or id_column(df), step or step_column(df)
    channels = channels or select_except(df, [ids, step]).columns
    longest, _rows = group_sizes(df, [ids])
    if longest > limit(df.sparkSession, MAX_GROUP_ROWS):
        raise ValueError(f"a sequence of {longest} steps does not fit one row; keep it long")
    cells = F.struct(F.col(step), *[F.col(c).cast("double").alias(c) for c in channels])
    rows = df.groupBy(ids).agg(F.array_sort(F.collect_list(cells)).alias("__c"))
    return rows.select(
        ids,
        F.size("__c").alias("length"),
        *[F.transform("__c", _field(c)).alias(c) for c in channels],
    )


def require_equal_lengths(arrays: DataFrame) -> int:
    """The common length; raise if the sequences differ."""
    low, high = arrays.agg(F.min("length"), F.max("length")).first()
    if low != high:
        raise ValueError(f"sequence lengths differ: {low} to {high}")
    return low


def horizon_vector(targets: DataFrame) -> DataFrame:
    """(id, target array) from target_<h> columns in number order, an array target, or a scalar."""
    ids = id_column(targets)
    numbered = natural_order(c for c in targets.columns if c.startswith("target_") and c[7:].isdigit())
    if numbered:
        return targets.select(ids, F.array(*[F.col(c).cast("double") for c in numbered]).alias("target"))
    if targets.schema["target"].dataType.typeName() == "array":
        return targets.select(ids, F.col("target").cast("array<double>").alias("target"))
    return targets.select(ids, F.array(F.col("target").cast("double")).alias("target"))


def history_and_horizon(sequences: DataFrame, targets: DataFrame) -> DataFrame:
    """History arrays with their target vectors; raise if either side lacks a partner."""
    ids = id_column(sequences)
    arrays, vectors = sequence_arrays(sequences), horizon_vector(targets)
    keys = sequences.select(ids).distinct()
    left = keys.join(vectors, ids, "left_anti").limit(1).count()
    right = vectors.join(keys, ids, "left_anti").limit(1).count()
    if left or right:
        raise ValueError("sequences and targets do not match")
    return arrays.join(vectors, ids)


def wide_to_long(df: DataFrame, ids: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    columns = select_except(df, ids).columns
    casted = df.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    return casted.unpivot(list(ids), [F.col(f"`{c}`") for c in columns], name, value)


def pivot_matrix(df: DataFrame, row: str, column: str, value: str, names: Sequence) -> DataFrame:
    """Mean of `value` by row and column; the column names are given, so no extra pass finds them."""
    return df.groupBy(row).pivot(column, list(names)).agg(F.avg(value))


def arrays_to_long(df: DataFrame, ids: str, column: str, value: str = "value") -> DataFrame:
    """(id, step, value) from an array column."""
    return df.select(ids, F.posexplode(column).alias("step", value))
