"""Positions, ranks, running sums and quantiles inside groups of any size.

Small groups use one window sorted by the order columns. When a group is too
long for one task, the order columns are cut at fixed bounds, every (group,
bucket) is sorted on its own, and the sums of the earlier buckets of the group
are added from a small table. The bounds only decide how the work is split; the
result is exact for any bounds. They are fixed on the driver once, so that every
use of them (and every recomputed task) sees the same buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import MAX_GROUP_ROWS, cut_lineage, limit

_FANOUT = 32


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group and of the table (map-side counted; two numbers reach the driver)."""
    sizes = df.groupBy(*keys).count() if keys else df.agg(F.count("*").alias("count"))
    largest, total = sizes.agg(F.max("count"), F.sum("count")).first()
    return largest or 0, total or 0


def fits_one_task(df: DataFrame, keys: Sequence[str]) -> bool:
    return group_sizes(df, keys)[0] <= limit(df.sparkSession, MAX_GROUP_ROWS)


def _numeric(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("bigint")
    if isinstance(kind, T.IntegralType):
        return F.col(name).cast("bigint")
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    if isinstance(kind, T.BooleanType):
        return F.col(name).cast("bigint")
    raise TypeError(f"order column {name} must be a number, text, date, timestamp or boolean, not {kind}")


# Text is ordered by as many chunks of bytes as fit into a whole number each.
_TEXT_CHUNKS, _CHUNK_BYTES = 4, 7


def _order_numbers(df: DataFrame, order: Sequence[str]) -> tuple[dict[str, Column], dict[str, str]]:
    """Numbers that follow the order columns, and their kinds. They stop after a text column: longer common beginnings
    than the chunks hold share a bucket, so a later column must not divide it."""
    numbers: dict[str, Column] = {}
    kinds: dict[str, str] = {}
    for name in order:
        if isinstance(df.schema[name].dataType, T.StringType):
            raw = F.encode(F.col(name), "UTF-8")
            for i in range(_TEXT_CHUNKS):
                part = F.rpad(F.hex(F.substring(raw, 1 + i * _CHUNK_BYTES, _CHUNK_BYTES)), 2 * _CHUNK_BYTES, "0")
                numbers[f"{name}#{i}"] = F.conv(part, 16, 10).cast("bigint")
                kinds[f"{name}#{i}"] = "bigint"
            break
        numbers[name] = _numeric(df, name)
        kinds[name] = "double" if isinstance(df.schema[name].dataType, T.FractionalType) else "bigint"
    return numbers, kinds


def _bounds(df: DataFrame, columns: Mapping[str, Column], buckets: int) -> dict[str, list]:
    """At most `buckets` cut points per order column. Where the first column has no null and none of its cut points comes
    twice, no value of it has many more rows than two buckets, so the others are not measured and divide nothing."""
    at = F.lit([i / buckets for i in range(1, buckets)])

    def measured(names: Sequence[str]) -> tuple[dict[str, list], bool]:
        cuts = [F.percentile_approx(columns[n], at, 8 * buckets).alias(f"c{i}") for i, n in enumerate(names)]
        row = df.agg(*cuts, F.max(columns[names[0]].isNull()).alias("null")).first()
        return {n: sorted(row[i] or []) for i, n in enumerate(names)}, bool(row["null"])

    first, *others = columns
    cuts, null = measured([first])
    found = cuts[first]
    if others and (null or len(set(found)) < len(found) or any(b != b for b in found)):
        cuts |= measured(others)[0]
    return cuts


def _bounds_literal(bounds: list, kind: str) -> Column:
    # One string literal, folded once to an array, keeps the plan small.
    return F.split(F.lit(",".join(repr(b) for b in bounds)), ",").cast(f"array<{kind}>")


def _count_bounds(x: Column, bounds: list, kind: str, strict: bool) -> Column:
    """How many of the sorted bounds lie below x (strict) or at most at x."""
    if not bounds:
        return F.lit(0)
    inside = (lambda b: b < x) if strict else (lambda b: b <= x)
    # Walk down the bounds with a fan-out, so a row compares a few dozen of them.
    levels, width = [], 1
    while width < len(bounds):
        levels.append(width)
        width *= _FANOUT
    found = F.lit(0)
    for step in reversed(levels or [1]):
        heads = _bounds_literal(bounds[step - 1 :: step], kind)
        part = F.slice(heads, (found / step).cast("int") + 1, F.lit(_FANOUT))
        found = found + F.size(F.filter(part, inside)) * step
    return found


def bucket_codes(df: DataFrame, order: Sequence[str], rows: int) -> dict[str, Column]:
    """Order-preserving bucket columns; a value on a cut point has a bucket of its own,
    which is then split by the next order column."""
    per_task = limit(df.sparkSession, MAX_GROUP_ROWS)
    buckets = max(16, 4 * rows // per_task)
    numeric, kinds = _order_numbers(df, order)
    cuts = _bounds(df, numeric, buckets)
    codes, tied = {}, F.lit(True)
    for level, name in enumerate(cuts):
        x, kind = numeric[name], kinds[name]
        below = _count_bounds(x, cuts[name], kind, True)
        upto = _count_bounds(x, cuts[name], kind, False)
        codes[f"__bucket{level}"] = F.when(tied, F.when(x.isNull(), F.lit(-1)).otherwise(below + upto)).otherwise(F.lit(0))
        tied = tied & (x.isNull() | (upto > below))
    return codes


def _same(left: DataFrame, right: DataFrame, on: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in on])


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """For each entry add `<name>_before`, the sum over the earlier rows of the group, and
    `<name>_total`, the sum over the group. `order` must be unique inside a group. `sizes` are the
    group sizes if the caller has measured them."""
    keys, order = list(keys), list(order)
    kept = [c for c in df.columns]
    largest, rows = sizes or group_sizes(df, keys)
    df = df.withColumns({f"__{n}": c for n, c in sums.items()})
    scratch = [f"__{n}" for n in sums]
    whole = Window.partitionBy(*keys)

    def running(w):
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        return {
            f"{n}_before": F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)) for n in sums
        }

    if largest <= limit(df.sparkSession, MAX_GROUP_ROWS):
        out = df.withColumns(running(whole.orderBy(*order)))
        return out.withColumns({f"{n}_total": F.sum(f"__{n}").over(whole) for n in sums}).drop(*scratch)

    codes = bucket_codes(df, order, rows)
    buckets = list(codes)
    # Sums and rows both read the buckets: written once, so that steps on top of each other do not multiply the work.
    df = cut_lineage(df.withColumns(codes))
    per_bucket = df.groupBy(*keys, *buckets).agg(*[F.sum(c).alias(c) for c in scratch])
    earlier = whole.orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(
        *keys,
        *buckets,
        *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}_carry") for n in sums],
        *[F.sum(f"__{n}").over(whole).alias(f"{n}_total") for n in sums],
    )
    inside = df.withColumns(running(Window.partitionBy(*keys, *buckets).orderBy(*order)))
    return inside.join(carried, _same(inside, carried, keys + buckets)).select(
        *[inside["`" + c.replace("`", "``") + "`"] for c in kept],
        *[(inside[f"{n}_before"] + carried[f"__{n}_carry"]).alias(f"{n}_before") for n in sums],
        *[carried[f"{n}_total"] for n in sums],
    )


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    position: str = "position",
    total: str | None = None,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """0-based position of each row of its group by the order columns (and the group's rows)."""
    sizes = sizes or group_sizes(df, keys)
    if sizes[0] <= limit(df.sparkSession, MAX_GROUP_ROWS):
        whole = Window.partitionBy(*keys)
        out = df.withColumn(position, (F.row_number().over(whole.orderBy(*order)) - 1).cast("bigint"))
        return out.withColumn(total, F.count(F.lit(1)).over(whole)) if total else out
    out = prefix_sums(df, keys, order, {"__row": F.lit(1).cast("bigint")}, sizes)
    out = out.withColumnRenamed("__row_before", position)
    return out.withColumnRenamed("__row_total", total) if total else out.drop("__row_total")


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, split: Column | None = None) -> DataFrame:
    """One row per (group, value): its count `n`, `n_before`, `n_total` and average rank;
    with `split` (0/1) also the counts `n1`, `n1_before`, `n1_total` of the rows flagged 1."""
    counts = [F.count(F.lit(1)).alias("n")]
    sums = {"n": F.col("n")}
    if split is not None:
        counts.append(F.sum(split.cast("bigint")).alias("n1"))
        sums["n1"] = F.col("n1")
    table = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(*counts)
    ranked = prefix_sums(table, keys, [value], sums)
    return ranked.withColumn("avg_rank", F.col("n_before") + (F.col("n") + 1) / 2)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float]
) -> DataFrame:
    """Linearly interpolated quantiles, one column per entry."""
    clean = df.filter(F.col(value).isNotNull())
    if fits_one_task(clean, keys):
        at = list(quantiles.values())
        out = clean.groupBy(*keys).agg(F.percentile(value, F.lit(at)).alias("__q"))
        return out.select(
            *keys, *[F.col("__q")[i].alias(n) for i, n in enumerate(quantiles)]
        )
    ranked = value_ranks(clean, keys, value)
    aggs = []
    for name, q in quantiles.items():
        h = F.lit(q) * (F.col("n_total") - 1)
        lo, hi = F.floor(h), F.ceil(h)

        def at_rank(r):
            inside = (F.col("n_before") <= r) & (r < F.col("n_before") + F.col("n"))
            return F.max(F.when(inside, F.col(value)))

        low, high = at_rank(lo), at_rank(hi)
        aggs.append((low + (high - low) * F.max(h - lo)).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def ntile_of(position: Column, total: Column, k: int) -> Column:
    """0-based tile of a position; the first `total mod k` tiles get one row more."""
    size, rest = F.floor(total / k), total % k
    big = rest * (size + 1)
    return F.when(position < big, F.floor(position / (size + 1))).otherwise(
        rest + F.floor(F.try_divide(position - big, size))
    )


def running_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Forward fill then back fill of each column along the order (new name -> source).

    A missing value takes the last known one, and before the first known one the first.
    The known rows of a group are numbered by a running count, so a fill value is one
    lookup on (group, count); a long run of missing values is a skewed probe side, which
    adaptive execution splits.
    """
    keys = list(keys)
    names = list(columns)
    if fits_one_task(df, keys):
        w = Window.partitionBy(*keys).orderBy(*order)
        earlier = w.rowsBetween(Window.unboundedPreceding, 0)
        # Where nothing is known up to a row, the first known value after it is the group's first.
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.withColumns(
            {
                n: F.coalesce(
                    F.last(c, ignorenulls=True).over(earlier), F.first(c, ignorenulls=True).over(whole)
                )
                for n, c in columns.items()
            }
        )
    known = {n: F.col(columns[n]).isNotNull().cast("bigint") for n in names}
    out = prefix_sums(df, keys, order, known)
    for n in names:
        source = columns[n]
        out = out.withColumn(
            f"__at_{n}", F.greatest(F.col(f"{n}_before") + known[n], F.lit(1).cast("bigint"))
        )
        lookup = out.filter(F.col(source).isNotNull()).select(
            *[F.col(k).alias(f"__k_{k}") for k in keys],
            (F.col(f"{n}_before") + 1).alias("__at"),
            F.col(source).alias(f"__v_{n}"),
        )
        cond = F.col(f"__at_{n}") == F.col("__at")
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        out = (
            out.join(lookup, cond, "left")
            .withColumn(n, F.coalesce(F.col(source), F.col(f"__v_{n}")))
            .drop(f"__at_{n}", "__at", f"__v_{n}", f"{n}_before", f"{n}_total", *[f"__k_{k}" for k in keys])
        )
    return out
