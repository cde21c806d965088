"""Sample and approximate entropy of sequences of any length: templates meet in a grid of cells as wide as the radius."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.matches import TILE, matches
from tidemark.operators.features.rows import SequenceRows
from tidemark.session import cut_lineage

# Cells are this much wider than the radius, so that rounding never puts two templates within it two cells apart.
WIDER = 1 + 1e-9


def entropy_table(rows: SequenceRows, shares: Sequence[float], sample_share: float = 0.2, tile: int = TILE) -> DataFrame:
    """(keys, sample, approximate): sample entropy (two steps against three, radius `sample_share` deviations) and
    approximate entropy (two steps, a radius for each share), each as an array; rows carry `mu`, `sd`, `lo` and `hi`.

    Templates of three values are counted where they are equal. For each radius they go to the cell of their first two values;
    a cell's templates are packed into tiles, and a tile meets the tiles of its own and the eight cells around it. Only counts
    come back. The last template has two values; it is compared with all others as they are read. Sequences that hold values
    that are not finite have no result."""
    keys = list(rows.keys)
    w = rows.ordered
    rows = rows.filter("abs(lo) < double('inf') AND abs(hi) < double('inf')")
    rows = rows.with_columns({"y": F.lead("x", 1).over(w), "z": F.lead("x", 2).over(w)})
    last = rows.own().where("position = n - 2").select(*keys, F.col("x").alias("last_x"), F.col("y").alias("last_y"))
    own = rows.attach(last).own().where("position <= n - 3")
    # From here on equal templates are one, with a weight.
    whole = [F.first(c).alias(c) for c in ("n", "mu", "sd", "last_x", "last_y")]
    own = own.groupBy(*keys, "x", "y", "z").agg(F.count(F.lit(1)).alias("w"), *whole)
    radii = sorted({sample_share, *shares})
    radius = F.explode(F.array(*[F.struct(F.lit(i).alias("r"), (F.lit(float(s)) * F.col("sd")).alias("radius")) for i, s in enumerate(radii)]))
    own = own.select("*", radius.alias("__r")).select("*", "__r.*").drop("__r")
    cell = lambda c: F.coalesce(F.floor(F.try_divide(F.col(c) - F.col("mu"), F.col("radius") * WIDER)), F.lit(0)).cast("long")
    own = own.withColumns({"cx": cell("x"), "cy": cell("y")})

    place = [*keys, "r", "cx", "cy"]
    crowded = own.groupBy(*place).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > tile)
    crowded = crowded.select(*place, F.ceil(F.col("c") / tile).cast("long").alias("tiles"))
    own = own.join(crowded, place, "left")
    own = own.withColumn("tile", F.pmod(F.xxhash64("x", "y", "z"), F.coalesce("tiles", F.lit(1).cast("long"))))
    rows_of = F.collect_list(F.struct("x", "y", "z", "w"))
    same = [F.first(c).alias(c) for c in ("n", "radius", "last_x", "last_y")]
    tiles = own.groupBy(*place, "tile").agg(rows_of.alias("t"), *same)
    tiles = cut_lineage(tiles.select(*place, "tile", "n", "radius", "last_x", "last_y", *[F.col("t")[c].alias(c) for c in ("x", "y", "z", "w")]))

    around = F.explode(F.array(*[F.struct((F.col("cx") + i).alias("nx"), (F.col("cy") + j).alias("ny")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    asked = tiles.select(*place, "tile", "radius", "x", "y", "z", around.alias("at")).select("*", "at.*").drop("at")
    there = tiles.select(*keys, "r", F.col("cx").alias("nx"), F.col("cy").alias("ny"), *[F.col(c).alias(f"o{c}") for c in ("x", "y", "z", "w")])
    pairs = asked.join(there, [*keys, "r", "nx", "ny"])

    name = [*place, "tile"]
    name_sql = ", ".join(f"`{c}` {t}" for c, t in tiles.select(*name).dtypes)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The counts of each asking tile, summed over rows that follow each other."""
        for batch in batches:
            names = list(zip(*[batch.column(c).to_pylist() for c in name]))
            held, two, three = [], [], []
            for i, own_name in enumerate(names):
                value = lambda c: batch.column(c)[i].values.to_numpy()  # noqa: B023, E731
                a, b = matches([value(c) for c in "xyz"], [value(f"o{c}") for c in "xyz"], value("ow"), batch.column("radius")[i].as_py())
                if held and names[held[-1]] == own_name:
                    two[-1], three[-1] = two[-1] + a, three[-1] + b
                else:
                    held.append(i)
                    two.append(a)
                    three.append(b)
            some = batch.select(name).take(pa.array(held, pa.int64()))
            counts = [pa.array(c, pa.list_(pa.int64())) for c in (two, three)]
            yield pa.RecordBatch.from_arrays([*some.columns, *counts], names=[*name, "two", "three"])

    counts = pairs.select(*name, "radius", *"xyz", "ox", "oy", "oz", "ow").mapInArrow(counted, f"{name_sql}, two array<long>, three array<long>")
    add = lambda c: F.aggregate(F.slice(c, 2, F.size(c)), F.get(c, F.lit(0)), lambda a, v: F.zip_with(a, v, lambda p, q: p + q))
    # A tile has a row from each cell around it and each task that met them.
    counts = counts.groupBy(*name).agg(F.collect_list("two").alias("twos"), F.collect_list("three").alias("threes"))
    counts = counts.select(*name, add("twos").alias("two"), add("threes").alias("three")).join(tiles, name)

    @F.pandas_udf("close long, closer long, logs2 double, logs3 double, last long")
    def shared(two: pd.Series, three: pd.Series, x: pd.Series, y: pd.Series, w: pd.Series, n: pd.Series, radius: pd.Series, lx: pd.Series, ly: pd.Series) -> pd.DataFrame:
        out = []
        for c2, c3, a, b, k, m, r, p, q in zip(*(s.tolist() for s in (two, three, x, y, w, n, radius, lx, ly))):
            c2, c3, a, b, k = (np.asarray(v) for v in (c2, c3, a, b, k))
            with_last = (np.abs(a - p) <= r) & (np.abs(b - q) <= r)
            logs2, logs3 = (k * np.log((c2 + with_last) / (m - 1))).sum(), (k * np.log(c3 / (m - 2))).sum()
            out.append((int((k * (c2 - 1)).sum()), int((k * (c3 - 1)).sum()), float(logs2), float(logs3), int(k[with_last].sum())))
        return pd.DataFrame(out, columns=["close", "closer", "logs2", "logs3", "last"])

    sums = counts.select(*keys, "r", "n", shared("two", "three", "x", "y", "w", "n", "radius", "last_x", "last_y").alias("s")).select(*keys, "r", "n", "s.*")
    sums = sums.groupBy(*keys, "r").agg(F.first("n").alias("n"), *[F.sum(c).alias(c) for c in ("close", "closer", "logs2", "logs3", "last")])
    m = F.col("n")
    phi2 = (F.col("logs2") + F.log((F.col("last") + 1) / (m - 1))) / (m - 1)
    # No match in three steps: infinite; none in two either: undefined.
    a, b = F.col("closer").cast("double"), F.col("close").cast("double")
    sample = F.when(a > 0, -F.log(a / b)).when(b > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    sums = sums.select(*keys, "r", sample.alias("sample"), F.abs(phi2 - F.col("logs3") / (m - 2)).alias("approximate"))
    at = lambda c, s: F.max(F.when(F.col("r") == radii.index(s), F.col(c)))
    return sums.groupBy(*keys).agg(F.array(at("sample", sample_share)).alias("sample"), F.array(*[at("approximate", s) for s in shares]).alias("approximate"))
