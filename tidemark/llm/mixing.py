"""Mixing sources to target weights: hash-random order, prefix sums by key range and an exact cut, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.common import ROW, bucket_bits, key_number, packed, quoted, unpacked, words_in
from tidemark.session import cut_lineage

# Rows of one source that one range of keys holds on average; only one range of each source is ever sorted.
RANGE_ROWS = 4096


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size) -> the same with target: `share` of all words dealt by weight. The weights go round the
    sources in order of their code points, null last. No target passes `most` times its source; the excess goes to the
    others by weight (one water level for all, found from prefix sums over the sources in the order they fill up)."""
    everything = W.partitionBy()
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sizes.withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[turn % len(weights)])
    rows = rows.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    filling = W.orderBy("full_at", F.col("source").asc_nulls_last())
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    total = F.lit(float(share)) * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    rows = rows.withColumn("level", level).withColumn("place", F.row_number().over(filling))
    # The first source that the level left for it and all later ones does not fill.
    level = F.min_by("level", F.when(F.col("level") <= F.col("full_at"), F.col("place"))).over(everything)
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * level, F.col("cap")))
    return rows.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    source: str = "source",
    text: str = "text",
    key: Sequence[str] = ("doc_id", "text"),
) -> DataFrame:
    """Every row with size, source_size, target, taken (words that the mix takes, repeats counted) and copies (how often
    the row appears in the mix, a cut row counted whole).

    Each source is put in the order of a hash of `key`. Words are summed by source and range of the hash; the prefix sums
    of the ranges give the one range in which the budget of a source ends, and only the rows of that range are put in
    order, so no source is ever sorted or held whole. A budget above the source's size repeats whole epochs first. The
    row at the cut is taken in part, so that the words taken are the rounded target (rows equal in every key column
    share the rest evenly, rounded down).

    Null texts and texts without words have size 0 and are never taken; a null source is a source of its own, the last;
    an empty table gives an empty result; repeated rows count each; columns named as a result's are replaced.
    """
    names = docs.columns
    number = key_number(*[quoted(k) for k in key])
    rows = docs.select(packed(docs), quoted(source).cast("string").alias("source"), number.alias("key"))
    bits = bucket_bits(docs.count(), RANGE_ROWS)
    rows = rows.withColumn("range", F.shiftrightunsigned("key", 60 - bits))
    size = words_in(F.col(ROW).getField(text))

    sums = cut_lineage(rows.withColumn("size", size).groupBy("source", "range").agg(F.sum("size").alias("words")))
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    targets = cut_lineage(targets)

    before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranged = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    cut_at = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))
    ranges = _join(ranged, targets).where(cut_at).select("source", F.col("range").alias("cut_range"), "before", "rest")
    ranges = cut_lineage(ranges)

    # The one range of each source that holds its cut, summed by key and put in order.
    keyed = _join(rows, ranges).where(F.col("range") == F.col("cut_range")).withColumn("size", size)
    keyed = keyed.groupBy("source", "key", "before", "rest").agg(F.sum("size").alias("words"), F.count("*").alias("ties"))
    within = W.partitionBy("source").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    keyed = keyed.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(within), F.lit(0)))
    keyed = keyed.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
    left = F.floor((F.col("rest") - F.col("before")) / F.col("ties")).cast("long")
    cuts = cut_lineage(keyed.select("source", F.col("key").alias("cut_key"), left.alias("left")))

    plan = cut_lineage(_join(targets, cuts, "left"))
    rows = _join(rows, plan).withColumn("size", size)
    part = (
        F.when(F.col("cut_key").isNull() | (F.col("key") > F.col("cut_key")), F.lit(0))
        .when(F.col("key") < F.col("cut_key"), F.col("size"))
        .otherwise(F.least("left", "size"))
        .cast("long")
    )
    rows = rows.withColumn("part", part)
    return unpacked(
        rows,
        names,
        {
            "size": F.col("size"),
            "source_size": F.col("source_size"),
            "target": F.col("target"),
            "taken": F.col("epochs") * F.col("size") + F.col("part"),
            "copies": F.when(F.col("size") > 0, F.col("epochs") + F.when(F.col("part") > 0, 1).otherwise(0)).otherwise(0),
        },
    )


def mixed_rows(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows of the mix: each row of `mix_sources` as often as it has copies, the given columns only."""
    times: Column = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mixed.where("copies > 0").select(*[quoted(c) for c in columns], times.alias("_copy")).drop("_copy")


def _join(rows: DataFrame, by_source: DataFrame, how: str = "inner") -> DataFrame:
    """Join on source, null equal to null; the right side has one row per source and leaves its width to Spark's size check."""
    right = by_source.withColumnRenamed("source", "_source")
    return rows.join(right, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")
