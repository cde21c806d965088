"""Registered queries with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nudge(d: int) -> float:
    """A thousandth of the last digit: keeps exact halves (sums of cents over small counts) from
    rounding up on one side and down on the other."""
    return 1.37 * 10.0 ** -(d + 3)


def rounded(df: DataFrame, keys: Sequence[str], digits: Mapping[str, int]) -> DataFrame:
    """The keys as they are and the named doubles rounded, in this order."""
    return df.select(
        *keys,
        *[F.round(F.col(f"`{c}`").cast("double") + F.lit(_nudge(d)), d).alias(c) for c, d in digits.items()],
    )


def rounded_sql(inner: str, keys: Sequence[str], digits: Mapping[str, int]) -> str:
    """The same projection in SQL; values that round to zero carry no sign."""
    cells = []
    for c, d in digits.items():
        x = f'("{c}"::DOUBLE + {_nudge(d)!r}::DOUBLE)'
        cells.append(f'CASE WHEN abs({x}) < 5e-{d + 1} THEN 0.0::DOUBLE ELSE round({x}, {d}) END AS "{c}"')
    return f"SELECT {', '.join([*keys, *cells])} FROM ({inner}) AS inner_rows"


def digits(names: Sequence[str], d: int = 6) -> dict[str, int]:
    return dict.fromkeys(names, d)
