"""Drift polynomial of a sequence seen as a noisy dynamical system."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.kernels import cubic_drift
from tidemark.operators.features.rows import SequenceRows, sequence_rows


def drift_names(degree: int, bins: int) -> list[str]:
    names = [f"friedrich_coefficients__coeff_{i}__m_{degree}__r_{bins}" for i in range(degree + 1)]
    return [*names, f"max_langevin_fixed_point__m_{degree}__r_{bins}"]


def drift_from_rows(rows: SequenceRows, degree: int = 3, bins: int = 30) -> DataFrame:
    """Values are cut at their quantiles, the mean value and mean next change of each bin are fitted by
    a polynomial. A sequence whose quantiles coincide has no such bins, and null features."""
    pairs = rows.with_columns({"delta": F.lead("x").over(rows.ordered) - F.col("x")})
    pairs = pairs.with_columns({"from": F.when(F.col("delta").isNotNull(), F.col("x"))})
    at = [i / bins for i in range(bins + 1)]
    cut = pairs.with_quantiles("edges", at, "from").own()
    usable = (F.size(F.array_distinct("edges")) == bins + 1) & F.col("from").isNotNull()
    below = F.size(F.filter("edges", lambda e: e < F.col("x")))
    cut = cut.withColumn("bin", F.when(usable, F.greatest(below, F.lit(1))))
    means = cut.groupBy(*rows.keys, "bin").agg(F.avg("x").alias("mx"), F.avg("delta").alias("my"))
    points = F.sort_array(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", F.col("mx").alias("x"), F.col("my").alias("y")))))
    out = means.groupBy(*rows.keys).agg(points.alias("p")).withColumn("c", cubic_drift(F.col("p"), degree))
    return out.select(
        *rows.keys, *[F.nanvl(F.get("c", F.lit(i)), F.lit(None)).alias(n) for i, n in enumerate(drift_names(degree, bins))]
    )


def drift_features(
    df: DataFrame,
    ids=None,
    step=None,
    channels: Sequence[str] | None = None,
    degree: int = 3,
    bins: int = 30,
    max_len: int | None = None,
) -> DataFrame:
    return drift_from_rows(sequence_rows(df, ids, step, channels, max_len, halo=1), degree, bins)
