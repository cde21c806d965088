"""Count windows over a stream: the rows of each series are numbered in time order as the watermark passes them."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Rows that are handed on at a time.
OUT_ROWS = 65_536


def _in_order(rows: dict[str, np.ndarray], by: Sequence[str]) -> dict[str, np.ndarray]:
    """The rows sorted by the columns, missing values last."""
    if any(rows[c].dtype == object for c in by):
        order = pd.DataFrame({c: rows[c] for c in by}).sort_values(list(by), kind="stable").index.to_numpy()
    else:
        order = np.lexsort([rows[c] for c in reversed(by)])
    return {c: v[order] for c, v in rows.items()}


def _joined(parts: Sequence[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]} if len(parts) > 1 else parts[0]


def stream_count_windows(
    stream: DataFrame,
    series: Sequence[str],
    time: str,
    window_size: int,
    stride: int | None = None,
    columns: Sequence[str] = (),
    order: Sequence[str] = (),
    lateness: str = "0 seconds",
    closing: str | None = None,
    buckets: int = 1024,
) -> DataFrame:
    """(series, window, step, time, order columns, columns): the rows of every complete count window of each series, once
    each, numbered from 0 as the windows of the whole table in the order of time and the `order` columns.

    A row waits until the watermark (the latest time less `lateness`) has passed it, since an earlier one may still come;
    rows that come later than that are dropped by the stream. What a series keeps is the number of its rows so far, the rows
    that wait, and those of the windows that are still open: fewer than a window and the rows of the lateness. The state is
    Spark's, so a query that is started again goes on where it stopped. Rows flagged by `closing` move the watermark and
    are no data: one with a late enough time ends a finite stream.

    A state holds the series of one of `buckets` hash values, since a call costs more than the rows of most series; the
    number stays the same for the life of a checkpoint.
    """
    stride = window_size if stride is None else stride
    if window_size <= 0 or stride <= 0:
        raise ValueError("window_size and stride must be positive")
    series, kept = list(series), list(dict.fromkeys([time, *order, *columns]))
    flag = F.coalesce(F.col(closing), F.lit(False)) if closing else F.lit(False)
    # Missing keys and closing rows are apart, so that a column of keys is whole or empty.
    holes = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in series], F.when(flag, "c").otherwise(""))
    place = [F.pmod(F.xxhash64(*series), F.lit(buckets)).alias("__bucket"), holes.alias("__holes")]
    rows = stream.withWatermark(time, lateness).select(*series, *kept, flag.alias("__closing"), *place)
    schema = T.StructType([
        *[rows.schema[c] for c in series], T.StructField("window", T.LongType()), T.StructField("step", T.IntegerType()), *[rows.schema[c] for c in kept]
    ])
    state_schema = "series binary"

    def arrived(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
        for f in frames:
            f = f[~f["__closing"].to_numpy(bool)].reset_index(drop=True)
            if len(f):
                # Columns as arrays: of many series with few rows each, frames would cost more than the rows.
                codes = f.groupby(series, sort=False, dropna=False).ngroup().to_numpy()
                order = np.argsort(codes, kind="stable")
                columns = {c: f[c].to_numpy()[order] for c in kept}
                first = np.flatnonzero(np.diff(codes[order], prepend=-1))
                for low, high in zip(first, [*first[1:], len(f)]):
                    key = tuple(None if pd.isna(v) else v for v in (f[c].iloc[order[low]] for c in series))
                    yield key, {c: v[low:high] for c, v in columns.items()}

    def finished(held: list, mark: int) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
        """The windows of a series that are complete now, with their numbers; `held` goes on."""
        position, window, open_rows, waiting = held
        micros = waiting[time].astype("datetime64[us]").astype("int64")
        ready = int(np.searchsorted(micros, mark * 1000, "right"))
        if ready:
            begin = position - (0 if open_rows is None else len(open_rows[time]))
            passed = {c: v[:ready] for c, v in waiting.items()}
            open_rows = _joined([p for p in (open_rows, passed) if p is not None and len(p[time])])
            waiting, position = {c: v[ready:] for c, v in waiting.items()}, position + ready
            end = (position - window_size) // stride + 1
            for at in range(window, end, max(1, OUT_ROWS // window_size)):
                numbers = np.arange(at, min(end, at + max(1, OUT_ROWS // window_size)))
                places = ((numbers[:, None] * stride - begin) + np.arange(window_size)).ravel()
                yield numbers, {c: v[places] for c, v in open_rows.items()}
            window = max(window, end)
            # Rows before the next window are done with; with strides longer than a window it may begin later than they end.
            done = max(0, min(window * stride, position) - begin)
            held[:] = position, window, {c: v[done:] for c, v in open_rows.items()}, waiting

    def table(found: list) -> pd.DataFrame:
        sizes = [len(numbers) * window_size for _key, numbers, _rows in found]
        out = {}
        for i, name in enumerate(series):
            values = [key[i] for key, _numbers, _rows in found]
            out[name] = pd.Series(values, dtype=object if values[0] is None else None).repeat(sizes).reset_index(drop=True)
        numbers = np.concatenate([n for _key, n, _rows in found])
        out["window"], out["step"] = np.repeat(numbers, window_size), np.tile(np.arange(window_size, dtype=np.int32), len(numbers))
        return pd.DataFrame(out | _joined([rows for _key, _numbers, rows in found]))

    def advance(_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # For each series the number of its rows, its next window, the rows of open windows and those that wait.
        each = pickle.loads(state.get[0]) if state.exists else {}
        fresh: dict[tuple, list] = {}
        for key, part in [] if state.hasTimedOut else arrived(frames):
            fresh.setdefault(key, []).append(part)
        for key, parts in fresh.items():
            held = each.setdefault(key, [0, 0, None, None])
            held[3] = _in_order(_joined([p for p in [held[3], *parts] if p is not None and len(p[time])]), [time, *order])
        if not each:
            return
        mark, found, size = state.getCurrentWatermarkMs(), [], 0
        for key, held in each.items():
            for numbers, windows in finished(held, mark):
                found.append((key, numbers, windows))
                size += len(numbers) * window_size
                if size >= OUT_ROWS:
                    yield table(found)
                    found, size = [], 0
        if found:
            yield table(found)
        state.update((pickle.dumps(each),))
        late = [held[3][time][0] for held in each.values() if len(held[3][time])]
        if late:
            micros = int(min(late).astype("datetime64[us]").astype("int64"))
            state.setTimeoutTimestamp(max(-(-micros // 1000), mark + 1))

    return rows.groupBy("__bucket", "__holes").applyInPandasWithState(advance, schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)
