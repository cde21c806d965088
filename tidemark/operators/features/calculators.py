"""Calculators by name with parameter sets: each set gives one or several results per sequence."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import ratio
from tidemark.operators.features.rows import sequence_rows

def _x() -> Column:
    return F.col("x")


def _earlier(lag: int) -> Column:
    return F.col(f"__lag{lag}")


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


# Name -> function of the parameters -> the results. Earlier values are columns __lag<k>, the mean is __mu; quantiles are
# named by their share, since they take a pass of their own.
CALCULATORS: dict[str, Callable[..., list]] = {
    "length": lambda: [F.count(F.lit(1))],
    "mean": lambda: [F.avg(_x())],
    "maximum": lambda: [F.max(_x())],
    "minimum": lambda: [F.min(_x())],
    "sum_values": lambda: [F.sum(_x())],
    "variance": lambda: [F.var_pop(_x())],
    "standard_deviation": lambda: [F.stddev_pop(_x())],
    "abs_energy": lambda: [F.sum(_x() * _x())],
    "root_mean_square": lambda: [F.sqrt(F.avg(_x() * _x()))],
    "median": lambda: [0.5],
    "quantile": lambda q: [float(q)],
    "quantiles": lambda qs: [float(q) for q in qs],
    "extremes": lambda: [F.min(_x()), F.max(_x())],
    "moments": lambda orders: [F.avg(F.pow(_x(), F.lit(float(k)))) for k in orders],
    "count_above": lambda t: [_share(_x() >= t)],
    "count_below": lambda t: [_share(_x() <= t)],
    "range_count": lambda min, max: [F.count_if((_x() >= min) & (_x() < max))],
    "mean_abs_change": lambda: [F.avg(F.abs(_x() - _earlier(1)))],
    "absolute_sum_of_changes": lambda: [F.sum(F.abs(_x() - _earlier(1)))],
    "autocorrelation": lambda lag: [
        ratio(F.avg((_x() - F.col("__mu")) * (_earlier(lag) - F.col("__mu"))), F.var_pop(_x()))
    ],
    "c3": lambda lag: [F.avg(_x() * _earlier(lag) * _earlier(2 * lag))],
}
LAGS: dict[str, Callable[..., list[int]]] = {
    "mean_abs_change": lambda: [1],
    "absolute_sum_of_changes": lambda: [1],
    "autocorrelation": lambda lag: [lag],
    "c3": lambda lag: [lag, 2 * lag],
}


def merge_domains(domains: Mapping[str, Mapping[str, object]]) -> dict[str, object]:
    """One calculator list of several domains; of definitions with one name the first stays."""
    out: dict[str, object] = {}
    for calculators in domains.values():
        for name, parameters in calculators.items():
            out.setdefault(name, parameters)
    return out


def _expanded(calculators: Mapping[str, object]) -> Iterable[tuple[str, str, dict]]:
    """(name, result name, parameters): a list of dictionaries gives one result name for each, the keys in order; other
    values of a list are the one parameter."""
    for name, sets in calculators.items():
        if name not in CALCULATORS:
            raise KeyError(f"unknown calculator {name}")
        if sets is None:
            yield name, name, {}
            continue
        for one in sets:
            if isinstance(one, Mapping):
                yield name, "__".join([name, *(f"{k}_{v}" for k, v in sorted(one.items()))]), dict(one)
            else:
                only = CALCULATORS[name].__code__.co_varnames[0]
                yield name, f"{name}__param_{one}", {only: one}


def calculate(
    df: DataFrame,
    calculators: Mapping[str, object],
    ids: Sequence[str] | str | None = None,
    step: Sequence[str] | str | None = None,
    channels: Sequence[str] | None = None,
    max_len: int | None = None,
) -> DataFrame:
    """(ids, channel, one column per result). A calculator with several results numbers them from 0. Results that are not
    defined for a sequence, such as a lag beyond its length, are 0."""
    wanted = [(name, label, p) for name, label, p in _expanded(calculators)]
    lags = sorted({k for name, _, p in wanted for k in LAGS.get(name, lambda **_: [])(**p)})
    results: list[tuple[str, Column | float]] = []
    for name, label, p in wanted:
        found = CALCULATORS[name](**p)
        results += [(label if len(found) == 1 else f"{label}__{i}", r) for i, r in enumerate(found)]
    rows = sequence_rows(df, ids, step, channels, max_len, halo=max([1, *lags]))
    rows = rows.with_stats({"__mu": F.avg(_x())})
    rows = rows.with_columns({f"__lag{k}": F.lag("x", k).over(rows.ordered) for k in lags})
    shares = sorted({r for _, r in results if isinstance(r, float)})
    if shares:
        rows = rows.with_quantiles("__q", shares)
    aggregates = []
    for label, r in results:
        column = F.max(F.col("__q")[shares.index(r)]) if isinstance(r, float) else r
        column = column.cast("double")
        aggregates.append(F.coalesce(F.nanvl(column, F.lit(None)), F.lit(0.0)).alias(label))
    return rows.own().groupBy(*rows.keys).agg(*aggregates)
