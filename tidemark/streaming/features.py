"""Features of arriving sequences and of time windows over a sensor stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.features.extractors import extract


def stream_sequence_features(
    sequences: DataFrame,
    output: str,
    checkpoint: str,
    extractor: str | Callable = "statistics_sample",
    trigger: dict | None = None,
    **params,
) -> StreamingQuery:
    """Extract features of each micro-batch of complete sequences.

    Every batch replaces its own `batch` partition, so a batch that is run again after a failure
    leaves no second copy.
    """

    def write(batch: DataFrame, number: int) -> None:
        features = extract(batch, extractor, **params)
        features.write.mode("overwrite").parquet(f"{output}/batch={number}")

    return (
        sequences.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def latest_features(features: DataFrame) -> DataFrame:
    """Stored stream output with one value per (sequence, feature), the one of the last batch."""
    newest = F.max_by("value", "batch").alias("value")
    return features.groupBy("sequence_id", "feature").agg(newest)


def windowed_statistics(
    stream: DataFrame,
    time: str,
    series: Sequence[str],
    channels: Sequence[str],
    length: str,
    slide: str | None = None,
    lateness: str | None = None,
    label: str | None = None,
) -> DataFrame:
    """mean, std, min, max and energy of each channel per series and time window.

    Works on a batch table and on a stream; with `lateness` rows later than that are dropped by the
    watermark and finished windows leave the state.
    """
    rows = stream.withWatermark(time, lateness) if lateness else stream
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in channels:
        x = F.col(c).cast("double")
        aggs += [
            F.avg(x).alias(f"{c}__mean"),
            F.stddev_samp(x).alias(f"{c}__std"),
            F.min(x).alias(f"{c}__min"),
            F.max(x).alias(f"{c}__max"),
            F.sum(x * x).alias(f"{c}__energy"),
        ]
    if label:
        aggs.append(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("target"))
    cut = F.window(time, length, slide or length)
    out = rows.groupBy(*series, cut.alias("w")).agg(*aggs)
    return out.select(*series, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *out.columns[len(series) + 1 :])
