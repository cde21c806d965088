"""Ridge counts of the wavelet transform of sequences of any length.

Waves are a few dozen values long, and a ridge line moves by a step or two, so a block with its halo has the lines that end in
it. The noise at a place is a low quantile of a stretch of a twentieth of the sequence; whether a line stands out of it follows
from two counts over the stretch, which are differences of counts from the beginning of the sequence on:

    values below v before p = those of earlier blocks in lower buckets of values (a table of sums)
                            + those of earlier blocks in v's bucket (from the bucket's values)
                            + those of p's block (from the block's values)
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.kernels import noise_window, ridge_rows, standing_lines
from tidemark.functions.range_order import RangeOrder
from tidemark.operators.features.rows import SequenceRows
from tidemark.session import cut_lineage

# Cut points that a block proposes for the buckets of values, and questions that one copy of a bucket answers.
BLOCK_CUTS, QUESTIONS = 16, 1 << 20


def _block_lines(counts: Sequence[int]):
    """From a block with its halo: the transform at width 1, and the lines that end in the block."""

    @F.pandas_udf("xs array<double>, cuts array<double>, lines array<struct<scale: int, place: long, v: double>>")
    def found(xs: pd.Series, at: pd.Series, first: pd.Series, last: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for x, a, f, e, size in zip(xs, at.tolist(), first.tolist(), last.tolist(), n.tolist()):
            x, lines = np.asarray(x, float), []
            for scale in counts:
                place, v = standing_lines(ridge_rows(x, scale, size))
                own = (place + a >= f) & (place + a <= e)
                lines += [{"scale": scale, "place": p, "v": w} for p, w in zip((place[own] + a).tolist(), v[own].tolist())]
            noise = ridge_rows(x, 1, size)[0][f - a : e - a + 1]
            out.append((noise, np.quantile(noise, np.linspace(0, 1, BLOCK_CUTS + 2)[1:-1]), lines))
        return pd.DataFrame(out, columns=["xs", "cuts", "lines"])

    return found


def _buckets(cuts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Bucket i holds the values above cut i - 1 up to cut i."""
    return np.searchsorted(cuts, values, "left")


def _split(keys: list[str]):
    """A block's values by bucket: how many there are, and where; those equal to their bucket's upper cut are counted, but are
    below no value of the bucket and need not be looked at again."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, cuts = (batch.column(c)[i].values.to_numpy() for c in ("xs", "cuts"))
                bucket = _buckets(cuts, x)
                counts = np.bincount(bucket, minlength=len(cuts) + 1)
                inner = np.flatnonzero(np.append(cuts, np.inf)[bucket] != x)
                order = inner[np.argsort(bucket[inner], kind="stable")]
                edges = np.searchsorted(bucket[order], np.arange(len(cuts) + 2))
                own = batch.select([*keys, "block"]).take(pa.array([i] * len(counts)))
                parts = [order[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                columns = [
                    *own.columns, pa.array(np.arange(len(counts)), pa.int64()), pa.array(counts, pa.int64()),
                    pa.array(parts, pa.list_(pa.int32())), pa.array([x[p] for p in parts], pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "block", "bucket", "c", "places", "values"])

    return split


def _counts_before(blocks: DataFrame, questions: DataFrame, keys: list[str], key_sql: str, size: int) -> DataFrame:
    """questions (keys, line, p, below, sign) -> (keys, line, count): the signed sums of how many values before place p are
    less than `below`. Blocks (keys, block, xs, cuts) hold `size` values each, but for the last."""
    split = cut_lineage(blocks.select(*keys, "block", "xs", "cuts").mapInArrow(_split(keys), f"{key_sql}, block long, bucket long, c long, places array<int>, values array<double>"))
    earlier = Window.partitionBy(*keys, "bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy(*keys, "block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = split.select(*keys, "block", "bucket", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c"))
    sums = sums.select(*keys, "block", "bucket", F.coalesce(F.sum("c").over(lower), F.lit(0)).alias("before"))

    # In the place's own block; a place after the last value belongs to the block it follows.
    asked = questions.withColumn("block", F.floor(F.greatest(F.col("p") - 1, F.lit(0)) / size))
    listed = asked.groupBy(*keys, "block").agg(F.collect_list(F.struct("line", "p", "below", "sign")).alias("q"))
    listed = listed.select(*keys, "block", *[F.col("q")[c].alias(c) for c in ("line", "p", "below", "sign")])
    joined = listed.join(blocks.select(*keys, "block", "xs", "cuts"), [*keys, "block"])
    answer_sql = f"{key_sql}, block long, bucket long, line long, below double, sign long, c long"

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                line, p, below, sign, x, cuts = (batch.column(c)[i].values.to_numpy() for c in ("line", "p", "below", "sign", "xs", "cuts"))
                stop = p - batch.column("block")[i].as_py() * size
                c = RangeOrder(x).count_less(np.zeros(len(stop), np.int64), stop, below)
                own = batch.select([*keys, "block"]).take(pa.array([i] * len(line)))
                columns = [*own.columns, *(pa.array(v) for v in (_buckets(cuts, below).astype(np.int64), line, below, sign, c.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "block", "bucket", "line", "below", "sign", "c"])

    inner = cut_lineage(joined.mapInArrow(inside, answer_sql))
    with_sums = inner.join(sums, [*keys, "block", "bucket"]).select(*keys, "line", (F.col("sign") * (F.col("c") + F.col("before"))).alias("c"))

    # In earlier blocks, among the values of the same bucket; many questions on one bucket are dealt to copies of it.
    asked = inner.where("block > 0").select(*keys, "bucket", "line", "below", "sign", (F.col("block") * size).alias("stop"))
    copies = asked.groupBy(*keys, "bucket").agg(F.ceil(F.count(F.lit(1)) / QUESTIONS).cast("int").alias("copies"))
    asked = asked.join(copies, [*keys, "bucket"]).withColumn("copy", F.pmod(F.xxhash64("line", "sign"), F.col("copies").cast("long")).cast("int"))
    held = split.where(F.size("places") > 0).join(copies, [*keys, "bucket"])
    held = held.select(*keys, "bucket", "block", "places", "values", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    schema = f"{key_sql}, line long, c long"

    def same_bucket(left: pa.Table, right: pa.Table) -> pa.Table:
        line, below, sign, stop = (left.column(c).to_numpy() for c in ("line", "below", "sign", "stop"))
        right = right.sort_by("block")
        starts = np.repeat(right.column("block").to_numpy() * size, pa.compute.list_value_length(right.column("places")).to_numpy())
        place = starts + right.column("places").combine_chunks().flatten().to_numpy()
        c = RangeOrder(right.column("values").combine_chunks().flatten().to_numpy()).count_less(np.zeros(len(stop), np.int64), np.searchsorted(place, stop), below)
        own = [left.column(k) for k in keys]
        return pa.table([*own, pa.array(line), pa.array(sign * c)], names=[*keys, "line", "c"])

    group = [*keys, "bucket", "copy"]
    met = asked.groupBy(*group).cogroup(held.groupBy(*group)).applyInArrow(lambda a, b: same_bucket(a, b) if a.num_rows and b.num_rows else _nothing(a, b, keys), schema)
    return with_sums.union(met).groupBy(*keys, "line").agg(F.sum("c").alias("c"))


def _nothing(left: pa.Table, right: pa.Table, keys: list[str]) -> pa.Table:
    some = left if left.num_columns else right
    fields = [*[(k, some.schema.field(k).type) for k in keys], ("line", pa.int64()), ("c", pa.int64())]
    return pa.schema(fields).empty_table()


def _window(n: Column, place: Column) -> tuple[Column, Column]:
    """The bounds of `noise_window` as columns."""
    width = F.ceil(n / 20)
    half = F.floor(width / 2)
    return F.greatest(place - half, F.lit(0).cast("long")), F.least(place + half + width % 2, n)


def ridge_table(rows: SequenceRows, counts: Sequence[int]) -> DataFrame:
    """(keys, ridges): for each n of `counts` the number of ridge lines over widths 1..n that stand out of the noise; rows carry
    `lo` and `hi`. Sequences that hold values that are not finite have no result."""
    keys = list(rows.keys)
    key_sql = ", ".join(f"`{c}` {t}" for c, t in rows.df.select(*keys).dtypes)
    fine = rows.filter("abs(lo) < double('inf') AND abs(hi) < double('inf')")
    pairs = F.array_sort(F.collect_list(F.struct("position", "x")))
    own = [f(F.when(F.col("own"), F.col("position"))).alias(c) for f, c in ((F.min, "first"), (F.max, "last"))]
    blocks = fine.df.groupBy(*rows.unit).agg(pairs.alias("p"), F.first("n").alias("n"), F.min("position").alias("at"), *own)
    blocks = blocks.withColumn("f", _block_lines(counts)(F.col("p")["x"], "at", "first", "last", "n"))
    blocks = cut_lineage(blocks.select(*keys, "block", F.col("n").cast("long").alias("n"), "f.*"))
    # About as many buckets as blocks: every BLOCK_CUTS-th of the cut points that the blocks propose.
    proposed = blocks.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("cuts"))).alias("c"))
    chosen = F.array_distinct(F.filter("c", lambda _, i: i % BLOCK_CUTS == BLOCK_CUTS // 2))
    cuts = proposed.select(*keys, chosen.alias("cuts"))
    valued = blocks.select(*keys, "block", "xs").join(cuts, keys)

    lines = blocks.select(*keys, "n", F.explode("lines").alias("l")).select(*keys, "n", "l.*")
    start, stop = _window(F.col("n"), F.col("place"))
    number = F.col("place") * (max(counts) + 1) + F.col("scale")
    lines = cut_lineage(lines.select(*keys, "scale", number.alias("line"), F.abs("v").alias("v"), start.alias("start"), stop.alias("stop")))
    # Values below -v, and values up to v: lines are numbered apart for the two.
    above = _next_up("v")
    sides = F.array(*[
        F.struct((2 * F.col("line") + side).alias("line"), p.alias("p"), below.alias("below"), F.lit(sign).cast("long").alias("sign"))
        for side, below in ((0, -F.col("v")), (1, above)) for p, sign in ((F.col("start"), -1), (F.col("stop"), 1))
    ])
    questions = lines.select(*keys, F.explode(sides).alias("q")).select(*keys, "q.*").where("p > 0")
    found = _counts_before(valued, questions, keys, key_sql, rows.block_rows)
    side = F.col("line") % 2
    found = found.groupBy(*keys, F.floor(F.col("line") / 2).alias("line")).agg(
        F.sum(F.when(side == 0, F.col("c"))).alias("less"), F.sum(F.when(side == 1, F.col("c"))).alias("upto")
    )
    # The quantile lies between the values of rank k and k + 1 (from 0) of the window.
    place = 0.1 * (F.col("stop") - F.col("start") - 1)
    judged = lines.join(found, [*keys, "line"]).withColumn("k", F.floor(place)).withColumn("part", place - F.floor(place))
    next_one = F.when(F.col("part") > 0, 1).otherwise(0)
    surely = (F.col("less") <= F.col("k")) & (F.col("upto") >= F.col("k") + 1 + next_one)
    never = (F.col("less") >= F.col("k") + 1 + next_one) | (F.col("upto") <= F.col("k"))
    judged = cut_lineage(judged.withColumn("stands", F.when(surely, F.lit(1)).when(never, F.lit(0))))
    open_ones = _between(judged.where("stands IS NULL"), valued, keys, rows.block_rows)
    stands = judged.where("stands IS NOT NULL").select(*keys, "scale", "stands").union(open_ones)
    sums = stands.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("scale") == n, F.col("stands"))), F.lit(0)).cast("double").alias(f"n{n}") for n in counts])
    every = blocks.select(*keys).distinct().join(sums, keys, "left")
    return every.select(*keys, F.array(*[F.coalesce(f"n{n}", F.lit(0.0)) for n in counts]).alias("ridges"))


def _next_up(value: str) -> Column:
    @F.pandas_udf("double")
    def up(v: pd.Series) -> pd.Series:
        return pd.Series(np.nextafter(v.to_numpy(float), np.inf))

    return up(value)


def _between(lines: DataFrame, blocks: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, scale, stands) of the few lines whose value lies between the two that the quantile is a mean of: these two are
    the greatest below and the least above the value in the window, taken over its blocks."""
    first, last = F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size)
    spread = lines.select("*", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("block"))
    # Which of the two bounds, -v or v, is between them.
    spread = spread.withColumn("edge", F.when(F.col("less") == F.col("k") + 1, -F.col("v")).otherwise(_next_up("v")))
    joined = spread.join(blocks.select(*keys, "block", "xs"), [*keys, "block"])
    a, b = (F.greatest(F.lit(0), F.col(c) - F.col("block") * size) for c in ("start", "stop"))
    cut = F.slice("xs", (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    near = joined.select(*keys, "scale", "line", "v", "part", F.array_max(F.filter(cut, lambda x: x < F.col("edge"))).alias("a"), F.array_min(F.filter(cut, lambda x: x >= F.col("edge"))).alias("b"))
    ends = near.groupBy(*keys, "scale", "line", "v", "part").agg(F.max("a").alias("a"), F.min("b").alias("b"))
    quantile = F.col("a") + (F.col("b") - F.col("a")) * F.col("part")
    return ends.select(*keys, "scale", (F.col("v") >= F.abs(quantile)).cast("int").alias("stands"))
