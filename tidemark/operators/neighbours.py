"""Mutual information of two real quantities from the distances to their nearest neighbours, exact at any size.

Points of a feature are put in order of the feature and cut into blocks with a margin. Around a point its block is searched
outwards on both sides until the next point is further off in the feature alone than the k-th neighbour found so far. A point
whose search leaves the margin knows a bound on its distance; it is measured again in every block within that bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.position import prefix_sums, with_position
from tidemark.operators.splits import seeded_hash
from tidemark.session import BLOCK_ROWS, cut_lineage, limit

ID = "sequence_id"
# Points that are measured against a block at a time.
STEP_POINTS = 256


def digamma(c: Column) -> Column:
    """Digamma of a positive number: recurrence up to 10, then the asymptotic series."""
    x = c.cast("double")
    shifted = F.lit(0.0)
    for i in range(10):
        shifted = shifted + 1 / (x + i)
    y = x + 10
    y2 = y * y
    series = F.log(y) - 1 / (2 * y) - 1 / (12 * y2) + 1 / (120 * y2 * y2) - 1 / (252 * y2 * y2 * y2)
    return series - shifted


def interval_counts(spans: DataFrame) -> DataFrame:
    """For each (feature, x, r): `m`, the points of the feature strictly inside (x - r, x + r), and
    `rows`, all its points. Interval ends are merged with the values; at equal places an upper end
    (kind 0) comes before the point (1) and a lower end (2) after it."""
    hist = spans.groupBy("feature", F.col("x").alias("at")).agg(F.count(F.lit(1)).alias("c"))
    hist = hist.withColumn("kind", F.lit(1))
    upper = spans.groupBy("feature", (F.col("x") + F.col("r")).alias("at")).agg(F.lit(0).cast("bigint").alias("c"))
    lower = spans.groupBy("feature", (F.col("x") - F.col("r")).alias("at")).agg(F.lit(0).cast("bigint").alias("c"))
    merged = hist.unionByName(upper.withColumn("kind", F.lit(0))).unionByName(lower.withColumn("kind", F.lit(2)))
    counted = prefix_sums(merged, ["feature"], ["at", "kind"], {"c": F.col("c")})
    counted = counted.select("feature", "at", "kind", F.col("c_before").alias("below"), F.col("c_total").alias("rows"))

    def side(kind: int, name: str) -> DataFrame:
        part = counted.filter(F.col("kind") == kind)
        return part.select("feature", F.col("at").alias(name), F.col("below").alias(f"{name}_below"), *(["rows"] if kind == 0 else []))

    out = spans.withColumns({"hi": F.col("x") + F.col("r"), "lo": F.col("x") - F.col("r")})
    out = out.join(side(0, "hi"), ["feature", "hi"]).join(side(2, "lo"), ["feature", "lo"])
    return out.withColumn("m", F.greatest(F.col("hi_below") - F.col("lo_below"), F.lit(1)))


def nearest_in_order(x: np.ndarray, y: np.ndarray, own: np.ndarray, k: int, first: bool, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """x ascending -> for the places `own` (the distance to the k-th nearest other point in the greater of both differences,
    and whether that is certain). `first` and `last` tell whether nothing comes before and after these points."""
    n = len(x)
    best = np.full((len(own), k), np.inf)
    sure = np.ones(len(own), bool)
    active, step = np.arange(len(own)), 1
    while len(active):
        at, kth = own[active], best[active, -1]
        going = np.zeros(len(active), bool)
        found = np.full((len(active), 2), np.inf)
        for side, (place, open_end) in enumerate(((at - step, not first), (at + step, not last))):
            there = (place >= 0) & (place < n)
            other = np.clip(place, 0, n - 1)
            far = np.abs(x[other] - x[at])
            # Points further on are at least as far off in x.
            near = there & (far < kth)
            found[near, side] = np.maximum(far, np.abs(y[other] - y[at]))[near]
            going |= near
            if open_end:
                # Beyond the margin there may be nearer ones, unless its last point is too far already.
                end = 0 if side == 0 else n - 1
                left = ~there & (np.abs(x[end] - x[at]) < kth)
                sure[active[left]] = False
        best[active] = np.sort(np.concatenate((best[active], found), axis=1), axis=1)[:, :k]
        active, step = active[going], step + 1
    return best[:, -1], sure


def kth_distances(points: DataFrame, k: int, margin: int | None = None) -> DataFrame:
    """(feature, x, y, id) -> the same with n, the points of the feature, and r, the distance to the k-th nearest other point
    (of all, if there are fewer) by the greater of both differences; features of one point are left out."""
    spark = points.sparkSession
    size = max(limit(spark, BLOCK_ROWS), 256)
    rows = cut_lineage(with_position(points, ["feature"], ["x", "y", "id"], "p", "n"))
    block, inside = F.floor(F.col("p") / size), F.col("p") % size
    # In spread data the k-th neighbour is some sqrt(k n) places off.
    reach = F.lit(margin) if margin is not None else F.least(F.lit(size), (8 * F.sqrt(k * F.col("n").cast("double"))).cast("long") + k)
    last = F.floor((F.col("n") - 1) / size)
    targets = F.array(block, F.when((inside < reach) & (block > 0), block - 1), F.when((inside >= size - reach) & (block < last), block + 1))
    cut = rows.withColumn("block", F.explode(F.array_compact(targets)))
    kind = dict(points.dtypes)["feature"]
    schema = f"feature {kind}, block long, p long, n long, x double, y double, r double, sure boolean"

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("p")
        p, x, y = (table.column(c).to_numpy() for c in ("p", "x", "y"))
        number, n = table.column("block")[0].as_py(), table.column("n")[0].as_py()
        own = np.flatnonzero(p // size == number)
        r, sure = nearest_in_order(x, y, own, min(k, n - 1), p[0] == 0, p[-1] == n - 1)
        kept = table.select(["feature", "block", "p", "n", "x", "y"]).take(pa.array(own))
        return kept.append_column("r", pa.array(r)).append_column("sure", pa.array(sure))

    found = cut_lineage(cut.where("n > 1").groupBy("feature", "block").applyInArrow(search, schema))
    again = found.where("NOT sure")
    if again.isEmpty():
        return found.select("feature", "n", "x", "y", "r")
    ends = found.groupBy("feature", "block").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    asked = again.select("feature", "p", "n", "x", "y", "r").join(ends.withColumnRenamed("feature", "f"), (F.col("feature") == F.col("f")) & (F.col("low") <= F.col("x") + F.col("r")) & (F.col("high") >= F.col("x") - F.col("r")))
    near_schema = f"feature {kind}, p long, near array<double>"

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        kept, near = [], []
        if left.num_rows and right.num_rows:
            p, x, y, n = (left.column(c).to_numpy() for c in ("p", "x", "y", "n"))
            q, u, v = (right.column(c).to_numpy() for c in ("other_p", "other_x", "other_y"))
            for at in range(0, len(p), STEP_POINTS):
                some = slice(at, at + STEP_POINTS)
                far = np.maximum(np.abs(x[some, None] - u), np.abs(y[some, None] - v))
                far[p[some, None] == q] = np.inf
                near += list(np.partition(far, k - 1, axis=1)[:, :k] if far.shape[1] > k else far)
            kept = list(range(len(p)))
        some = left.select(["feature", "p"]).take(pa.array(kept, pa.int64()))
        return some.append_column("near", pa.array(near, pa.list_(pa.float64())))

    others = found.select(*[F.col(c).alias(f"other_{c}") for c in ("feature", "block", "p", "x", "y")])
    met = asked.groupBy("feature", "block").cogroup(others.groupBy("other_feature", "other_block")).applyInArrow(measure, near_schema)
    # Each block gives its k nearest; the k-th of all of them counts.
    kth = F.element_at(F.array_sort(F.flatten(F.collect_list("near"))), F.least(F.lit(k), F.max("n") - 1).cast("int"))
    settled = met.join(again.select("feature", "p", "n"), ["feature", "p"]).groupBy("feature", "p").agg(kth.alias("exact"))
    out = found.join(settled, ["feature", "p"], "left")
    return out.select("feature", "n", "x", "y", F.coalesce("exact", "r").alias("r"))


def real_mutual_information(
    features: DataFrame, targets: DataFrame, neighbours: int = 3, seed: int = 42, jitter: bool = True, margin: int | None = None
) -> DataFrame:
    """(feature, score): nearest-neighbour estimate (nats) of the mutual information of each real feature and a real target.

    With the distance r to the k-th neighbour in the greater of both differences, and the points that are nearer than r in the
    feature alone (nx) and in the target alone (ny), the estimate is digamma(n) + digamma(k) - mean(digamma(nx) + digamma(ny)),
    each point counted as its own. Both are scaled by their deviation; equal values are parted by a seeded jitter. `features`
    are (sequence_id, feature, value) without nulls, `targets` (sequence_id, target)."""
    y = F.col("target").cast("double")
    targets = targets.select(ID, y.alias("y")).where("y IS NOT NULL")
    data = features.join(targets, ID)
    sd = lambda c: F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0)
    scales = data.groupBy("feature").agg(sd("value").alias("sx"), sd("y").alias("sy"), F.avg(F.abs("value")).alias("ax"), F.avg(F.abs("y")).alias("ay"))
    data = data.join(scales, "feature")

    def scaled(column: str, of: str, own_seed: int) -> Column:
        value = F.col(column) / F.col(f"s{of}")
        size = F.greatest(F.lit(1.0), F.col(f"a{of}") / F.col(f"s{of}"))
        keys = (ID, "feature") if of == "x" else (ID,)
        return value + (seeded_hash(own_seed, *keys) / F.lit(2.0**63) * 1e-10 * size if jitter else F.lit(0.0))

    points = data.select("feature", F.col(ID).alias("id"), scaled("value", "x", seed).alias("x"), scaled("y", "y", seed + 1).alias("y"))
    spans = cut_lineage(kth_distances(points, neighbours, margin))
    # Strictly nearer than r, with room for the rounding of the ends: the k-th neighbour itself must stay outside.
    eps = 4 * 2.0**-52
    mean = F.lit(0.0)
    parts = None
    for c in ("x", "y"):
        room = F.col("r") - eps * (F.abs(F.col(c)) + F.col("r"))
        counted = interval_counts(spans.select("feature", F.col(c).alias("x"), room.alias("r")))
        part = counted.groupBy("feature").agg(F.avg(digamma(F.col("m"))).alias(f"mean_{c}"))
        parts = part if parts is None else parts.join(part, "feature")
        mean = mean + F.col(f"mean_{c}")
    sizes = spans.groupBy("feature").agg(F.first("n").alias("n"))
    k = F.least(F.lit(neighbours).cast("long"), F.col("n") - 1)
    score = F.greatest(digamma(F.col("n")) + digamma(k) - mean, F.lit(0.0))
    every = features.select("feature").distinct().join(sizes, "feature", "left").join(parts, "feature", "left")
    return every.select("feature", F.coalesce(score, F.lit(0.0)).alias("score"))
