"""Cutting ordered series into count windows.

Every row computes which windows it belongs to and is exploded into them, so the
only wide step is the position of a row in its series. Windows hold at most
`window_size` rows by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expr import select_except
from tidemark.operators.position import group_sizes, prefix_sums, with_position

LABEL_STRATEGIES = ("last", "mean", "any_positive", "majority_vote")


def window_count(n: Column, window: int, stride: int, horizon: int = 0) -> Column:
    """floor((n - W - H) / S) + 1, and 0 for a series shorter than W + H."""
    return F.when(n >= window + horizon, F.floor((n - window - horizon) / stride) + 1).otherwise(F.lit(0))


def _explode_windows(
    df: DataFrame, offset: Column, windows: Column, span: int, stride: int, window: str, step: str
) -> DataFrame:
    """One row per window that covers `offset`; window k covers [k*stride, k*stride + span)."""
    lo = F.greatest(F.lit(0), F.ceil((offset - span + 1) / stride))
    hi = F.least(F.floor(offset / stride), windows - 1)
    df = df.withColumns({"__lo": lo.cast("bigint"), "__hi": hi.cast("bigint"), "__o": offset})
    # `sequence` counts down when its ends are swapped, so rows outside every window go first.
    df = df.filter(F.col("__lo") <= F.col("__hi"))
    df = df.withColumn(window, F.explode(F.sequence("__lo", "__hi")))
    return df.withColumn(step, (F.col("__o") - F.col(window) * stride).cast("int")).drop("__lo", "__hi", "__o")


def _label(column: Column, kind: T.DataType, step: Column, strategy: str) -> Column:
    continuous = isinstance(kind, (T.FractionalType,))
    if strategy == "last":
        return F.max_by(column, step)
    if strategy == "any_positive":
        return F.max(F.when(column > 0, 1).otherwise(0))
    if strategy == "mean" or (strategy == "majority_vote" and continuous):
        return F.avg(F.nanvl(column.cast("double"), F.lit(None)))
    if strategy == "majority_vote":
        return F.mode(column, deterministic=True)
    raise ValueError(f"unknown label strategy {strategy}")


def _check(window_size: int, stride: int, horizon: int | None) -> None:
    if window_size <= 0:
        raise ValueError(f"window_size must be positive, got {window_size}")
    if stride <= 0:
        raise ValueError(f"stride must be positive, got {stride}")
    if horizon is not None and horizon <= 0:
        raise ValueError(f"forecast_horizon must be positive, got {horizon}")


def sequence_offsets(df: DataFrame, series: Sequence[str], counts: dict[str, Column]) -> DataFrame:
    """Per series its window counts and the number of windows of all earlier series; `counts` are
    given in terms of the series length `__n`."""
    total = sum(counts.values(), F.lit(0))
    table = df.groupBy(*series).agg(F.count(F.lit(1)).alias("__n"))
    table = table.withColumns(counts).withColumn("__windows", total)
    ordered = prefix_sums(table, [], list(series), {"__windows_sum": F.col("__windows")})
    return ordered.select(
        *[F.col(s).alias(f"__s_{s}") for s in series],
        *counts,
        F.col("__windows_sum_before").alias("__offset"),
    )


def _numbered(rows: DataFrame, source: DataFrame, series: Sequence[str], counts: dict[str, Column]) -> DataFrame:
    if not series:
        return rows.withColumns({**counts, "__offset": F.lit(0)})
    offsets = sequence_offsets(source, series, counts)
    cond = F.lit(True)
    for s in series:
        cond = cond & F.col(s).eqNullSafe(F.col(f"__s_{s}"))
    # One row per series: broadcast while it is small, split by adaptive execution when a series is long.
    return rows.join(offsets, cond).drop(*[f"__s_{s}" for s in series])


def segment_time_series(
    df: DataFrame,
    window_size: int,
    stride: int | None = None,
    time_col: str | Sequence[str] = "time",
    feature_cols: Sequence[str] | None = None,
    label_col: str | None = None,
    label_strategy: str = "majority_vote",
    group_col: str | None = None,
    forecast_horizon: int | None = None,
    cross_group: bool = False,
) -> tuple[DataFrame, DataFrame | None]:
    """Sliding count windows per series; tumbling when no stride is given.

    Returns the sequence table (`sequence_id`, `step`, features) and, with a label, the
    target table. A window stays inside one `group_col` value; `cross_group=True` runs over
    the whole table in time order instead and takes the group of the last row. Windows are
    numbered densely, series in key order.
    """
    stride = window_size if stride is None else stride
    _check(window_size, stride, forecast_horizon)
    if label_col and label_strategy not in LABEL_STRATEGIES:
        raise ValueError(f"unknown label strategy {label_strategy}")
    order = [time_col] if isinstance(time_col, str) else list(time_col)
    if feature_cols is None:
        feature_cols = select_except(df, [*order, label_col, group_col]).columns
    series = [group_col] if group_col and not cross_group else []
    horizon = forecast_horizon or 0

    used = dict.fromkeys([*series, *order, *feature_cols, *[c for c in (label_col, group_col) if c]])
    source = df.select(*used)
    sizes = group_sizes(source, series)
    if sizes[0] < window_size + horizon:
        raise ValueError(f"no series reaches the required length {window_size + horizon}")
    rows = with_position(source, series, order, "__p", "__n", sizes)
    rows = _numbered(rows, source, series, {"__w": window_count(F.col("__n"), window_size, stride, horizon)})

    windows = _explode_windows(
        rows, F.col("__p"), F.col("__w"), window_size, stride, "__window", "step"
    ).withColumn("sequence_id", F.col("__offset") + F.col("__window"))
    sequences = windows.select("sequence_id", "step", *feature_cols)
    if label_col is None:
        return sequences, None

    group = []
    if group_col:
        last = F.max_by(F.col(group_col), F.col("step"))
        group = [last.alias(g) for g in dict.fromkeys(("group", group_col))]
    if not forecast_horizon:
        kind = df.schema[label_col].dataType
        target = _label(F.col(label_col), kind, F.col("step"), label_strategy).alias("target")
        return sequences, windows.groupBy("sequence_id").agg(target, *group)

    targets = _horizon_targets(
        rows, F.col("__p") - window_size, F.col("__w"), label_col, horizon, stride, F.col("__offset")
    )
    if group:
        targets = targets.join(windows.groupBy("sequence_id").agg(*group), "sequence_id")
    return sequences, targets


def _horizon_targets(
    rows: DataFrame,
    offset: Column,
    windows: Column,
    target_col: str,
    horizon: int,
    stride: int,
    first_id: Column,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """The `horizon` values that follow each window, as an array and as columns target_<h>."""
    future = _explode_windows(rows.filter(offset >= 0), offset, windows, horizon, stride, "__window", "__h")
    future = future.withColumn("sequence_id", first_id + F.col("__window"))
    pairs = F.array_sort(F.collect_list(F.struct("__h", F.col(target_col).cast("double").alias("y"))))
    out = future.groupBy("sequence_id").agg(F.transform(pairs, lambda s: s["y"]).alias("target"), *extra)
    return out.withColumns({f"target_{h}": F.get("target", F.lit(h)) for h in range(horizon)})


def segment_forecasting_series(
    df: DataFrame,
    history_len: int,
    forecast_horizon: int,
    stride: int = 1,
    time_col: str | Sequence[str] = "time",
    feature_cols: Sequence[str] | None = None,
    target_col: str | None = None,
    group_col: str | None = None,
    test_size: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Causal history windows with the next values as target, per series.

    With `test_size` each series is cut at floor(n * (1 - test_size)): targets of train
    windows lie before the cut, targets of test windows at or after it; the history of a test
    window may reach back over the cut. Series shorter than one window are skipped.
    """
    _check(history_len, stride, forecast_horizon)
    if test_size is not None and not 0.0 < test_size < 1.0:
        raise ValueError(f"test_size must lie between 0 and 1, got {test_size}")
    order = [time_col] if isinstance(time_col, str) else list(time_col)
    if not (group_col and group_col in df.columns):
        group_col = next((c for c in ("sequence_id", "id") if c in df.columns), None)
    series = [group_col] if group_col else []
    if feature_cols is None:
        feature_cols = select_except(df, [*order, *series]).columns
    if not feature_cols:
        raise ValueError("no feature columns to segment")
    target_col = target_col or ("target" if "target" in df.columns else feature_cols[0])

    source = df.select(
        *[F.col(s).alias("__series") for s in series],
        *[F.col(c).alias(f"__t{i}") for i, c in enumerate(order)],
        *feature_cols,
        F.col(target_col).cast("double").alias("__y"),
    )
    keys = ["__series"] if series else []
    n, need = F.col("__n"), history_len + forecast_horizon
    sizes = group_sizes(source, keys)
    if sizes[0] < need:
        raise ValueError("no windows for the given lengths")
    rows = with_position(source, keys, [f"__t{i}" for i in range(len(order))], "__p", "__n", sizes)
    if test_size is None:
        counts = {"__train": window_count(n, history_len, stride, forecast_horizon), "__test": F.lit(0)}
    else:
        cut = F.floor(n * F.lit(1.0 - test_size))
        lengths = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(n >= need)
        bad = lengths.filter((cut < need) | (n - cut < forecast_horizon))
        if not bad.isEmpty():
            raise ValueError("a series is too short for the train or test part it must have")
        first = F.greatest(F.lit(0), cut - history_len)
        test = F.when(n >= need, F.floor((n - need - first) / stride) + 1).otherwise(0)
        train = F.when(n >= need, F.floor((cut - need) / stride) + 1).otherwise(0)
        counts = {"__train": train, "__test": test}
    rows = _numbered(rows, source, keys, counts)

    parts = [("all" if test_size is None else "train", F.lit(0), F.col("__train"), F.col("__offset"))]
    if test_size is not None:
        parts.append(("test", first, F.col("__test"), F.col("__offset") + F.col("__train")))
    sequences, targets = [], []
    for split, start, windows, first_id in parts:
        # Rows before the first window of the part have a negative offset and fall out by `lo <= hi`.
        offset = F.col("__p") - start
        past = _explode_windows(rows, offset, windows, history_len, stride, "__window", "step")
        sequences.append(
            past.select((first_id + F.col("__window")).alias("sequence_id"), "step", *feature_cols)
        )
        tags = [F.first(F.lit(split)).alias("split")]
        if keys:
            tags += [F.first("__series").alias(c) for c in ("series_id", "group")]
        else:
            tags += [F.first(F.lit(0)).alias("series_id")]
        targets.append(
            _horizon_targets(
                rows, offset - history_len, windows, "__y", forecast_horizon, stride, first_id, tags
            )
        )
    out, aim = sequences[0], targets[0]
    for s, t in zip(sequences[1:], targets[1:]):
        out, aim = out.unionByName(s), aim.unionByName(t)
    return out, aim


def roll_time_series(
    df: DataFrame,
    column_id: str,
    column_sort: str | Sequence[str],
    max_timeshift: int,
    min_timeshift: int = 0,
    rolling_direction: int = 1,
) -> DataFrame:
    """For every row t of a series the window of up to `max_timeshift` + 1 rows that ends (forward)
    or starts (backward) at t; windows of `min_timeshift` rows or fewer are dropped.

    Adds `shift` (the position of t) and `step`; (id, shift) is the new key.
    """
    if rolling_direction == 0:
        raise ValueError("rolling_direction must not be 0")
    if max_timeshift <= 0 or min_timeshift < 0:
        raise ValueError("max_timeshift must be positive and min_timeshift not negative")
    order = [column_sort] if isinstance(column_sort, str) else list(column_sort)
    rows = with_position(df, [column_id], order, "__p", "__n")
    p, n = F.col("__p"), F.col("__n")
    if rolling_direction > 0:
        first = F.greatest(p, F.lit(min_timeshift).cast("bigint"))
        last = F.least(p + max_timeshift, n - 1)
    else:
        first = F.greatest(p - max_timeshift, F.lit(0).cast("bigint"))
        last = F.least(p, n - 1 - min_timeshift)
    rows = rows.withColumns({"__lo": first, "__hi": last}).filter("__lo <= __hi")
    rows = rows.withColumn("shift", F.explode(F.sequence("__lo", "__hi")))
    t = F.col("shift")
    start = F.greatest(t - max_timeshift, F.lit(0)) if rolling_direction > 0 else t
    return rows.withColumn("step", (p - start).cast("int")).drop("__p", "__n", "__lo", "__hi")


def chunk_key(position: Column, size: int, prefix: str) -> Column:
    """Fixed chunks that keep a partial tail: `<prefix><position div size>`."""
    return F.concat(F.lit(prefix), F.floor(position / size).cast("string"))


def window_overlap(window: Column | int, stride: Column | int) -> dict[str, Column]:
    """Overlap share of neighbouring windows and the windows to purge on each side of a block."""
    window, stride = [F.lit(c) if isinstance(c, int) else c for c in (window, stride)]
    return {
        "overlap": F.greatest(F.lit(0.0), F.lit(1.0) - stride / window),
        "purge": F.greatest(F.lit(0), F.ceil(window / stride) - 1).cast("int"),
    }
