"""Sequences as positioned rows, ready for window functions.

A sequence that one task can hold is one unit. A longer one is cut into blocks of
fixed length; rows near an edge are copied into the neighbour block (flagged
`own = false`), so lags and leads of up to `halo` steps see what they need, and
every sum over own rows combines across blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import id_column, sanitise, select_except, step_column
from tidemark.operators.position import exact_quantiles, group_sizes, with_position
from tidemark.session import BLOCK_ROWS, MAX_GROUP_ROWS, cut_lineage, limit

# The longest stretch from the first row on that a feature looks at.
MIN_BLOCK = 256
# Rows of one task of whole sequences: hundreds of features make few bytes much work, which sizes in bytes do not show. The
# plan of hundreds of columns costs about a second a task, so tasks are not smaller.
TASK_ROWS = 262_144


@dataclass(frozen=True)
class SequenceRows:
    """Rows (keys, position, n, x[, block, own]); `split` tells whether blocks are used,
    `block_rows` how long they are and `task_rows` how long a sequence one task may hold."""

    df: DataFrame
    keys: tuple[str, ...]
    split: bool
    block_rows: int = 0
    task_rows: int = 0

    @property
    def unit(self) -> list[str]:
        return [*self.keys, "block"] if self.split else list(self.keys)

    @property
    def ordered(self):
        return Window.partitionBy(*self.unit).orderBy("position")

    def own(self) -> DataFrame:
        return self.df.filter("own") if self.split else self.df

    def with_columns(self, columns: Mapping[str, Column]) -> SequenceRows:
        return replace(self, df=self.df.withColumns(dict(columns)))

    def with_stats(self, stats: Mapping[str, Column]) -> SequenceRows:
        """Attach per-sequence aggregates to every row."""
        if not self.split:
            whole = Window.partitionBy(*self.keys)
            return self.with_columns({n: c.over(whole) for n, c in stats.items()})
        table = self.own().groupBy(*self.keys).agg(*[c.alias(n) for n, c in stats.items()])
        return self.attach(table)

    def attach(self, table: DataFrame) -> SequenceRows:
        """Join a table with one row per sequence."""
        if not self.split:
            return replace(self, df=self.df.join(table, list(self.keys), "left"))
        # Spread the per-sequence row over its blocks, so a long sequence is no hot join key.
        blocks = self.own().groupBy(*self.keys).agg(F.max("block").alias("__last"))
        spread = table.join(blocks, list(self.keys)).withColumn(
            "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__last")))
        )
        return replace(self, df=self.df.join(spread.drop("__last"), self.unit, "left"))

    def filter(self, condition: Column | str) -> SequenceRows:
        return replace(self, df=self.df.filter(condition))

    def short(self) -> SequenceRows:
        return self.filter(F.col("n") <= self.task_rows)

    def long(self) -> SequenceRows:
        return self.filter(F.col("n") > self.task_rows)

    def whole_arrays(self) -> DataFrame:
        """(keys, xs): the ordered values of each sequence; only for sequences that fit a task."""
        pairs = F.array_sort(F.collect_list(F.struct("position", "x")))
        return self.own().groupBy(*self.keys).agg(F.transform(pairs, lambda s: s["x"]).alias("xs"))

    def quantile_table(self, name: str, at: Sequence[float], value: str = "x") -> DataFrame:
        """(keys, array of exact quantiles of a column over own rows)."""
        if not self.split:
            return self.df.groupBy(*self.keys).agg(F.percentile(value, F.lit(list(at))).alias(name))
        parts = {f"__q{i}": q for i, q in enumerate(at)}
        table = exact_quantiles(self.own(), list(self.keys), value, parts)
        return table.select(*self.keys, F.array(*parts).alias(name))

    def with_quantiles(self, name: str, at: Sequence[float], value: str = "x") -> SequenceRows:
        """Attach the array of exact quantiles of a column to every row."""
        if not self.split:
            return self.with_stats({name: F.percentile(value, F.lit(list(at)))})
        return self.attach(self.quantile_table(name, at, value))

    def with_running_sum(self, name: str, column: Column) -> SequenceRows:
        """Sum of a column over the sequence up to and including each own row."""
        sofar = self.ordered.rowsBetween(Window.unboundedPreceding, 0)
        if not self.split:
            return self.with_columns({name: F.sum(column).over(sofar)})
        sums = self.own().groupBy(*self.unit).agg(F.sum(column).alias("__s"))
        earlier = Window.partitionBy(*self.keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        carry = sums.select(*self.unit, F.coalesce(F.sum("__s").over(earlier), F.lit(0.0)).alias("__carry"))
        inside = self.with_columns({name: F.sum(F.when(F.col("own"), column)).over(sofar)})
        out = replace(inside, df=inside.df.join(carry, self.unit, "left"))
        return replace(out, df=out.df.withColumn(name, F.col(name) + F.col("__carry")).drop("__carry"))

    def with_runs(self, flags: Mapping[str, Column]) -> SequenceRows:
        """Length, at each row, of the run of true flags that ends there (0 if false)."""
        out = self.with_columns(flags)
        breaks = {f"__brk_{n}": F.when(~F.col(n), F.col("position")) for n in flags}
        sofar = self.ordered.rowsBetween(Window.unboundedPreceding, 0)
        if self.split:
            ends = out.own().groupBy(*self.unit).agg(*[F.max(c).alias(n) for n, c in breaks.items()])
            earlier = (
                Window.partitionBy(*self.keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
            )
            carry = ends.select(
                *self.unit, *[F.max(n).over(earlier).alias(f"{n}_carry") for n in breaks]
            )
            out = replace(out, df=out.df.join(carry, self.unit, "left"))
        runs = {}
        for n, c in breaks.items():
            last = F.max(c).over(sofar)
            if self.split:
                last = F.greatest(last, F.col(f"{n}_carry"))
            name = n.removeprefix("__brk_")
            runs[f"{name}_run"] = F.when(F.col(name), F.col("position") - F.coalesce(last, F.lit(-1))).otherwise(0)
        return out.with_columns(runs)

    def arrays(self, *more: Column) -> DataFrame:
        """One row per unit: `start`, `n` and the ordered values `xs` (at most one block)."""
        pairs = F.array_sort(F.collect_list(F.struct("position", "x")))
        out = self.own().groupBy(*self.unit).agg(
            F.first("n").alias("n"), F.min("position").alias("start"), pairs.alias("__p"), *more
        )
        return out.withColumn("xs", F.transform("__p", lambda s: s["x"])).drop("__p")


def long_values(df: DataFrame, ids: Sequence[str], columns: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Channel columns to rows (ids, kept columns, channel, x)."""
    kept = [*ids, *columns]
    values = [F.col(c).cast("double").alias(c) for c in channels]
    if len(channels) == 1:
        return df.select(
            *kept, F.lit(channels[0]).alias("channel"), F.col(channels[0]).cast("double").alias("x")
        )
    return df.select(*kept, *values).unpivot(kept, list(channels), "channel", "x")


def sequence_rows(
    df: DataFrame,
    ids: Sequence[str] | str | None = None,
    step: Sequence[str] | str | None = None,
    channels: Sequence[str] | None = None,
    max_len: int | None = None,
    halo: int = 64,
) -> SequenceRows:
    """Positioned rows of every (sequence, channel).

    `max_len` states a length the sequences cannot exceed and that their steps run
    0..n-1 (count windows); without it the lengths are measured.
    """
    ids = [id_column(df)] if ids is None else [ids] if isinstance(ids, str) else list(ids)
    order = [step_column(df)] if step is None else [step] if isinstance(step, str) else list(step)
    if channels is None:
        channels = select_except(df, [*ids, *order]).columns
    keys = [*ids, "channel"]
    per_task = limit(df.sparkSession, MAX_GROUP_ROWS)

    def values(rows: DataFrame) -> DataFrame:
        return long_values(rows, ids, order, channels).withColumn("x", F.coalesce("x", F.lit(float("nan"))))

    if max_len is not None and max_len <= per_task:
        rows = values(df).select(*keys, F.col(order[0]).cast("bigint").alias("position"), "x")
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        return SequenceRows(rows.withColumn("n", n), tuple(keys), False)
    largest, total = group_sizes(df, ids)
    if largest <= per_task:
        whole = Window.partitionBy(*keys)
        at_once = df.sparkSession.sparkContext.defaultParallelism
        rounds = max(1, -(-total * len(channels) // (TASK_ROWS * at_once)))
        rows = values(df.repartition(rounds * at_once, *ids)).select(
            *keys,
            (F.row_number().over(whole.orderBy(*order)) - 1).cast("bigint").alias("position"),
            F.count(F.lit(1)).over(whole).alias("n"),
            "x",
        )
        return SequenceRows(rows, tuple(keys), False)
    size = max(limit(df.sparkSession, BLOCK_ROWS), MIN_BLOCK)
    halo = min(halo, size // 2)
    rows = with_position(df.select(*ids, *order, *channels), ids, order, "position", "n", (largest, total))
    rows = long_values(rows, ids, ["position", "n"], channels)
    rows = rows.withColumn("x", F.coalesce("x", F.lit(float("nan"))))
    block, inside = F.floor(F.col("position") / size), F.col("position") % size
    last = F.floor((F.col("n") - 1) / size)
    targets = F.array(
        block,
        F.when((inside < halo) & (block > 0), block - 1),
        F.when((inside >= size - halo) & (block < last), block + 1),
    )
    rows = rows.withColumn("block", F.explode(F.array_compact(targets)))
    rows = rows.withColumn("own", F.col("block") == F.floor(F.col("position") / size))
    # Long rows feed many aggregations: positions are worked out once.
    return SequenceRows(cut_lineage(rows), tuple(keys), True, size, max(per_task, MIN_BLOCK))


def features_long(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, feature, value) with null, NaN and infinities as 0.0."""
    names = [c for c in wide.columns if c not in keys]
    values = wide.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in names])
    out = values.unpivot(list(keys), [F.col(f"`{c}`") for c in names], "feature", "value")
    return out.withColumn("value", sanitise("value"))


def features_wide(long: DataFrame, ids: Sequence[str], names: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per sequence with columns `<channel>__<feature>` for the (channel, feature) names."""
    def cell(channel, feature):
        hit = (F.col("channel") == channel) & (F.col("feature") == feature)
        return F.max(F.when(hit, F.col("value"))).alias(f"{channel}__{feature}")

    return long.groupBy(*ids).agg(*[cell(c, f) for c, f in names])
