"""Pairs that two orders of the same rows put the other way round, for groups of any size."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.position import group_sizes, with_position
from tidemark.session import BLOCK_ROWS, MAX_GROUP_ROWS, cut_lineage, limit


def weighted_inversions(y: np.ndarray, c: np.ndarray) -> float:
    """Sum of c[i] * c[j] over the pairs i < j with y[i] > y[j]."""
    rank, c, total = np.unique(y, return_inverse=True)[1], c.astype(float), 0.0
    for bit in reversed(range(int(rank.max()).bit_length())):
        # The rows are in order of the bits above this one, and as they came among equals.
        one = (rank >> bit & 1).astype(bool)
        first = np.flatnonzero(np.diff(rank >> (bit + 1), prepend=-1))
        greater = np.concatenate(([0.0], np.cumsum(np.where(one, c, 0.0))))
        before = greater[:-1] - np.repeat(greater[first], np.diff(first, append=len(rank)))
        total += float((before[~one] * c[~one]).sum())
        order = np.argsort(rank >> bit, kind="stable")
        rank, c = rank[order], c[order]
    return total


def _counted(parts: DataFrame, keys: Sequence[str], tasks: int) -> DataFrame:
    """Inversions of `b` in the order of `a` (then of `b`) inside each (keys, kind, part)."""
    by = [*keys, "kind", "part"]

    def count(table: pa.Table) -> pa.Table:
        a, b, c = (table.column(n).to_numpy() for n in "abc")
        order = np.lexsort((b, a))
        return table.select(keys).slice(0, 1).append_column("pairs", pa.array([weighted_inversions(b[order], c[order])]))

    kinds = dict(parts.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "pairs double"])
    # As many tasks as there are parts to count, not as their bytes would give.
    return parts.repartition(tasks, *by).groupBy(*by).applyInArrow(count, schema)


def inverted_pairs(rows: DataFrame, keys: Sequence[str], a: str, b: str, count: str) -> DataFrame:
    """(keys, pairs): the pairs of each group with a smaller `a` and a greater `b`, by the products of their counts. Every
    (keys, a, b) is one row of a written table.

    The rows are cut into blocks along `a` and into bands along `b`. A pair is in one block, or in one band of two blocks, or
    in two of both; the last are the pairs of the cells of block and band, a smaller table of the same kind."""
    keys = list(keys)
    sizes = group_sizes(rows, keys)
    spark, plain = rows.sparkSession, rows.select(*keys, F.col(a).alias("a"), F.col(b).alias("b"), F.col(count).alias("c"))
    if sizes[0] <= limit(spark, MAX_GROUP_ROWS):
        parts = plain.select(*keys, F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("part"), "a", "b", "c")
        return _counted(parts, keys, max(8, min(512, sizes[1] // limit(spark, BLOCK_ROWS)))).groupBy(*keys).agg(F.sum("pairs").alias("pairs"))
    # Ties of one column are in order of the other, so that only inverted pairs are inverted in both places.
    placed = cut_lineage(with_position(plain, keys, ["a", "b"], "p", sizes=sizes))
    placed = with_position(placed, keys, ["b", "a"], "q", sizes=sizes)
    # At most a quarter as many cells as rows.
    size = max(limit(spark, BLOCK_ROWS), 2 * math.isqrt(sizes[0]))
    block, band = F.floor(F.col("p") / size), F.floor(F.col("q") / size)
    placed = cut_lineage(placed.select(*keys, "p", "q", "c", block.alias("block"), band.alias("band")))
    inside = placed.select(*keys, F.lit(0).alias("kind"), F.col("block").alias("part"), F.col("p").alias("a"), F.col("q").alias("b"), "c")
    across = placed.select(*keys, F.lit(1).alias("kind"), F.col("band").alias("part"), F.col("block").alias("a"), F.col("q").alias("b"), "c")
    cells = cut_lineage(placed.groupBy(*keys, "block", "band").agg(F.sum("c").alias("c")))
    found = _counted(inside.unionByName(across), keys, max(8, min(512, 2 * sizes[1] // size)))
    found = found.unionByName(inverted_pairs(cells, keys, "block", "band", "c"))
    return found.groupBy(*keys).agg(F.sum("pairs").alias("pairs"))
