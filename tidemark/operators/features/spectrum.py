"""Moments of the Fourier spectrum of sequences of any length: a transform in four steps over columns and rows.

A transform of any length n is a convolution with a chirp, done with transforms of a power of two M >= 2n - 1. For these the
positions form a matrix: its columns are transformed, turned by a factor for each cell, and its rows are transformed. A task
holds a few columns or a few rows; between the steps the matrix is dealt anew in pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.kernels import moments_of_sums
from tidemark.operators.features.rows import SequenceRows


class _Plan:
    """Shape of the matrix for length n: `high` rows and `wide` columns, in column groups of `columns` and row groups of
    `rows`, each of about `cells` cells."""

    def __init__(self, n: int, cells: int) -> None:
        bits = max(2, (2 * n - 2).bit_length())
        self.n, self.size = n, 1 << bits
        self.high, self.wide = 1 << bits // 2, 1 << bits - bits // 2
        self.columns = max(1, min(self.wide, cells // self.high))
        self.rows = max(1, min(self.high, cells // self.wide))

    def chirp(self, t: np.ndarray) -> np.ndarray:
        """exp(i pi t^2 / n), the square reduced as a whole number first."""
        square = t.astype(np.uint64) ** np.uint64(2) % np.uint64(2 * self.n)
        return np.exp(1j * np.pi * square.astype(float) / self.n)

    def turn(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        return np.exp(-2j * np.pi * np.multiply.outer(rows, columns) / self.size)

    def places(self, group: int) -> np.ndarray:
        """Position of each cell of a column group."""
        return np.add.outer(np.arange(self.high) * self.wide, group * self.columns + np.arange(self.columns))


def _pieces(table: pa.Table, keys: list[str], names: dict[str, list], schema: pa.Schema) -> pa.Table:
    """A table of the given columns, with the keys and n of the group in every row."""
    times = len(next(iter(names.values())))
    own = {c: table.column(c).combine_chunks().take(pa.array([0] * times)) for c in [*keys, "n"]}
    return pa.table({c: own[c] if c in own else pa.array(names[c], schema.field(c).type) for c in schema.names})


def _cells(data: bytes, height: int) -> np.ndarray:
    return np.frombuffer(data, complex).reshape(height, -1)


def spectrum_moment_table(rows: SequenceRows) -> DataFrame:
    """(keys, moments): centroid, variance, skew and kurtosis of the absolute Fourier spectrum. Lengths up to 2^32 - 1."""
    keys = list(rows.keys)
    cells = 1 << max(10, rows.block_rows.bit_length() + 1)
    own = rows.own().select(*keys, F.col("n").cast("long").alias("n"), "position", "x")
    bits = F.greatest(F.lit(2), F.length(F.bin(2 * F.col("n") - 2)))
    wide = F.expr("shiftleft(1L, bits - bits div 2)")
    columns = F.expr(f"greatest(1L, least(wide, {cells} div shiftleft(1L, bits div 2)))")
    own = own.withColumn("bits", bits.cast("int")).withColumn("wide", wide).withColumn("columns", columns)
    own = own.withColumn("part", F.expr("(position % wide) div columns")).select(*keys, "n", "part", "position", "x")

    key_sql = ", ".join(f"`{c}` {t}" for c, t in rows.df.select(*keys).dtypes)
    dealt_sql = f"{key_sql}, n long, part long, piece long, a binary, b binary"
    turned_sql = f"{key_sql}, n long, part long, piece long, a binary"
    sums_sql = f"{key_sql}, n long, s0 double, s1 double, s2 double, s3 double, s4 double"

    def schema(table: pa.Table, more: list[tuple[str, pa.DataType]]) -> pa.Schema:
        return pa.schema([*[(c, table.schema.field(c).type) for c in keys], ("n", pa.int64()), *more])

    def columns_step(table: pa.Table) -> pa.Table:
        """Transforms of the columns of the chirped values and of the chirp, cut into row groups."""
        plan = _Plan(table.column("n")[0].as_py(), cells)
        part = table.column("part")[0].as_py()
        position = table.column("position").to_numpy()
        a = np.zeros((plan.high, plan.columns), complex)
        a[position // plan.wide, position % plan.wide - part * plan.columns] = table.column("x").to_numpy() * plan.chirp(position).conj()
        places = plan.places(part)
        b = np.zeros(places.shape, complex)
        b[places < plan.n] = plan.chirp(places[places < plan.n])
        back = plan.size - places
        b[back < plan.n] = plan.chirp(back[back < plan.n])
        turn = plan.turn(np.arange(plan.high), part * plan.columns + np.arange(plan.columns))
        a, b = (np.fft.fft(m, axis=0) * turn for m in (a, b))
        groups = range(plan.high // plan.rows)
        cut = lambda m: [m[g * plan.rows : (g + 1) * plan.rows].tobytes() for g in groups]
        made = {"part": [part] * len(groups), "piece": list(groups), "a": cut(a), "b": cut(b)}
        return _pieces(table, keys, made, schema(table, [("part", pa.int64()), ("piece", pa.int64()), ("a", pa.binary()), ("b", pa.binary())]))

    def rows_step(table: pa.Table) -> pa.Table:
        """Both transforms of the rows end here; their product goes back through rows, cut into column groups."""
        plan = _Plan(table.column("n")[0].as_py(), cells)
        piece = table.column("piece")[0].as_py()
        table = table.sort_by("part")
        a, b = (np.concatenate([_cells(x, plan.rows) for x in table.column(c).to_pylist()], axis=1) for c in ("a", "b"))
        product = np.fft.ifft(np.fft.fft(a, axis=1) * np.fft.fft(b, axis=1), axis=1)
        product *= plan.turn(piece * plan.rows + np.arange(plan.rows), np.arange(plan.wide)).conj()
        groups = range(plan.wide // plan.columns)
        cut = [np.ascontiguousarray(product[:, g * plan.columns : (g + 1) * plan.columns]).tobytes() for g in groups]
        made = {"part": list(groups), "piece": [piece] * len(groups), "a": cut}
        return _pieces(table, keys, made, schema(table, [("part", pa.int64()), ("piece", pa.int64()), ("a", pa.binary())]))

    def sums_step(table: pa.Table) -> pa.Table:
        """The convolution at the places of a column group, whose size is that of the spectrum; sums with powers of the place."""
        plan = _Plan(table.column("n")[0].as_py(), cells)
        part = table.column("part")[0].as_py()
        table = table.sort_by("piece")
        spectrum = np.abs(np.fft.ifft(np.concatenate([_cells(x, plan.rows) for x in table.column("a").to_pylist()]), axis=0))
        places = plan.places(part)
        inside = places <= plan.n // 2
        k, size = places[inside].astype(float), spectrum[inside]
        made = {f"s{p}": [float((size * k**p).sum())] for p in range(5)}
        return _pieces(table, keys, made, schema(table, [(f"s{p}", pa.float64()) for p in range(5)]))

    dealt = own.groupBy(*keys, "part").applyInArrow(columns_step, dealt_sql)
    turned = dealt.groupBy(*keys, "piece").applyInArrow(rows_step, turned_sql)
    sums = turned.groupBy(*keys, "part").applyInArrow(sums_step, sums_sql)
    whole = sums.groupBy(*keys).agg(F.array(*[F.sum(f"s{p}") for p in range(5)]).alias("sums"))
    return whole.select(*keys, moments_of_sums(F.col("sums")).alias("moments"))
