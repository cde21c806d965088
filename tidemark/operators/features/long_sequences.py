"""Features of sequences that no single task may hold, from the blocks of their rows.

Sums, counts and segment spectra add up over blocks. The full spectrum, phrases,
template matches, ridge lines and the unit-root test have modules of their own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.operators.features.rows import SequenceRows

SEGMENT, HOP = 256, 128


def mean_density(rows: SequenceRows) -> DataFrame:
    """(keys, density): periodograms of half-overlapping segments, averaged."""
    p = F.col("position")
    last = F.floor((F.col("n") - SEGMENT) / HOP)
    segment = F.explode(F.array(F.floor(p / HOP), F.floor(p / HOP) - 1))
    cut = rows.own().withColumns({"last": last, "segment": segment}).filter("segment BETWEEN 0 AND last")
    ordered = F.array_sort(F.collect_list(F.struct("position", "x")))
    parts = cut.groupBy(*rows.keys, "segment").agg(F.transform(ordered, lambda s: s["x"]).alias("xs"))
    powers = parts.select(*rows.keys, F.posexplode(K.segment_density(F.col("xs"))).alias("f", "power"))
    means = powers.groupBy(*rows.keys, "f").agg(F.avg("power").alias("power"))
    by_frequency = F.array_sort(F.collect_list(F.struct("f", "power")))
    return means.groupBy(*rows.keys).agg(F.transform(by_frequency, lambda s: s["power"]).alias("density"))


def autocovariance_table(rows: SequenceRows, lags: int) -> DataFrame:
    """(keys, covariances): mean products of centred values 0..lags apart; rows carry `mu`."""
    d = F.col("x") - F.col("mu")
    lagged = rows.with_columns({f"__l{k}": F.lag("x", k).over(rows.ordered) for k in range(1, lags + 1)})
    sums = [F.avg(d * d)] + [F.avg(d * (F.col(f"__l{k}") - F.col("mu"))) for k in range(1, lags + 1)]
    return lagged.own().groupBy(*rows.keys).agg(F.array(*sums).alias("covariances"))


def regression_table(rows: SequenceRows, order: int) -> DataFrame:
    """(keys, coefficients): constant and coefficients of the least-squares autoregression."""
    w = rows.ordered
    # Centred values keep the products well scaled; the constant is shifted back.
    terms = {f"__t{k}": F.lag("x", k).over(w) - F.col("mu") for k in range(1, order + 1)}
    full = rows.with_columns(terms | {"__y": F.col("x") - F.col("mu")}).own().filter(F.col("position") >= order)
    columns = [F.lit(1.0), *[F.col(c) for c in terms], F.col("__y")]
    products = F.array(*[F.avg(a * b) for a in columns for b in columns])
    out = full.groupBy(*rows.keys).agg(products.alias("p"), F.first("mu").alias("mu"))
    out = out.withColumn("c", K.normal_equations(F.col("p"), order))
    rest = F.aggregate(F.slice("c", 2, order), F.lit(1.0), lambda a, v: a - v)
    constant = F.get("c", F.lit(0)) + F.col("mu") * rest
    return out.select(*rows.keys, F.concat(F.array(constant), F.slice("c", 2, order)).alias("coefficients"))


def order_pattern(values: Sequence[Column]) -> Column:
    """Number that stands for the rank order of the values, ties by place."""
    code = F.lit(0)
    for i, a in enumerate(values):
        rank = F.lit(0)
        for j, b in enumerate(values):
            if j != i:
                rank = rank + ((b <= a) if j < i else (b < a)).cast("int")
        code = code + rank * len(values) ** i
    return code


def order_entropy_table(rows: SequenceRows, dimensions: Sequence[int]) -> DataFrame:
    """(keys, entropies): entropy of the order patterns of each dimension."""
    w = rows.ordered
    most = max(dimensions)
    lagged = rows.with_columns({f"__l{k}": F.lag("x", k).over(w) for k in range(1, most)}).own()
    values = [F.col("x"), *[F.col(f"__l{k}") for k in range(1, most)]]
    codes = F.array(
        *[
            F.struct(F.lit(d).alias("d"), F.when(F.col("position") >= d - 1, order_pattern(values[d - 1 :: -1])).alias("code"))
            for d in dimensions
        ]
    )
    each = lagged.select(*rows.keys, F.explode(codes).alias("c")).select(*rows.keys, "c.*").filter("code IS NOT NULL")
    counts = each.groupBy(*rows.keys, "d", "code").agg(F.count(F.lit(1)).alias("c"))
    # -sum(c/t ln(c/t)) = ln(t) - sum(c ln c) / t.
    c = F.col("c").cast("double")
    entropy = F.log(F.sum(c)) - F.sum(c * F.log(c)) / F.sum(c)
    by_dimension = counts.groupBy(*rows.keys, "d").agg(entropy.alias("e"))
    cells = [F.max(F.when(F.col("d") == d, F.col("e"))) for d in dimensions]
    return by_dimension.groupBy(*rows.keys).agg(F.array(*cells).alias("entropies"))


def decay_lag_table(rows: SequenceRows) -> DataFrame:
    """(keys, lag): first lag at which the autocorrelation has fallen to 1/e, null if there is none.

    Shifts are worked through in doubling ranges of block distances, and only for the sequences that
    have not fallen yet; rows carry `mu`.
    """
    keys, size = list(rows.keys), rows.block_rows
    centred = rows.with_columns({"x": F.col("x") - F.col("mu")})
    blocks = centred.arrays().select(*keys, "block", "n", F.col("xs").alias("a"))
    x = F.col("x")
    totals = centred.own().groupBy(*keys).agg(F.sum(x * x).alias("total"), F.max("n").alias("n"))
    longest = totals.agg(F.max("n")).first()[0] or 0
    found, first, reach = None, 0, 1
    while True:
        # Block distances first..reach give every shift up to reach * size.
        distance = F.explode(F.sequence(F.lit(first), F.lit(reach))).alias("distance")
        left = blocks.select(*keys, "block", "a", distance)
        left = left.withColumn("other", F.col("block") + F.col("distance"))
        if found is not None:
            left = left.join(found.select(*keys), keys, "left_anti")
        right = blocks.select(*keys, F.col("block").alias("other"), F.col("a").alias("b"))
        pairs = left.join(right, [*keys, "other"])
        shifts = pairs.select(
            *keys, "distance", F.size("a").alias("__a"), F.posexplode(K.block_products(F.col("a"), F.col("b"))).alias("i", "s")
        )
        # Blocks but the last of a sequence are full, so places differ by distance * size.
        lag = F.col("distance") * size + F.col("i") - (F.col("__a") - 1)
        shifts = shifts.withColumn("lag", lag).filter((F.col("lag") > first * size) & (F.col("lag") <= reach * size))
        sums = shifts.groupBy(*keys, "lag").agg(F.sum("s").alias("s")).join(totals, keys)
        fallen = sums.filter((F.col("lag") < F.col("n")) & (F.col("s") <= F.col("total") / math.e))
        part = fallen.groupBy(*keys).agg(F.min("lag").cast("double").alias("lag"))
        found = part if found is None else found.unionByName(part)
        if reach * size >= longest:
            break
        open_ones = totals.filter(F.col("n") > reach * size).join(found.select(*keys), keys, "left_anti")
        if open_ones.isEmpty():
            break
        # The last distance also holds shifts of the next range.
        first, reach = reach, 2 * reach
    return found
