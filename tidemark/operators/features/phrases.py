"""Phrase complexity of sequences of any length: one ordered pass that keeps the state of the parse only."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.phrases import PhraseParse
from tidemark.operators.features.rows import SequenceRows


def _equal_width(bins: Sequence[int]):
    """Symbols of equal-width bins between the extremes of the sequence, for each number of bins."""

    @F.pandas_udf("array<struct<symbols: int, code: binary>>")
    def coded(xs: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        out = []
        for x, a, b in zip(xs, low, high):
            x = np.asarray(x, float)
            edges = [np.linspace(a, b, n + 1)[1:] for n in bins]
            out.append([{"symbols": n, "code": np.searchsorted(e, x).astype(np.uint8).tobytes()} for n, e in zip(bins, edges)])
        return pd.Series(out)

    return coded


def _two_sided(threshold: float):
    @F.pandas_udf("array<struct<symbols: int, code: binary>>")
    def coded(xs: pd.Series) -> pd.Series:
        return pd.Series([[{"symbols": 2, "code": (np.asarray(x, float) > threshold).astype(np.uint8).tobytes()}] for x in xs])

    return coded


def _parsed(blocks: DataFrame, keys: list[str], codes: Column) -> DataFrame:
    """(keys, symbols, n, phrases) from blocks (keys, block, n, xs): blocks are coded where they are; the codes of one
    sequence and number of symbols then pass through one task in order, and only the tree of phrases is kept."""
    coded = blocks.select(*keys, "block", "n", F.explode(codes).alias("c")).select(*keys, "block", "n", "c.*")
    parts = [*keys, "symbols"]
    coded = coded.repartition(*parts).sortWithinPartitions(*parts, "block").select(*parts, "n", "code")
    kinds = dict(coded.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*parts, "n"]) + ", phrases long"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, row = None, None, None

        def ended() -> pa.RecordBatch:
            columns = [*row.columns[:-1], pa.array([state.count], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=[*parts, "n", "phrases"])

        for batch in batches:
            names = list(zip(*[batch.column(c).to_pylist() for c in parts]))
            for i, name in enumerate(names):
                if name != own:
                    if state is not None:
                        yield ended()
                    own, state, row = name, PhraseParse(name[-1]), batch.slice(i, 1)
                state.feed(batch.column("code")[i].as_py())
        if state is not None:
            yield ended()

    return coded.mapInArrow(parse, schema)


def phrase_table(rows: SequenceRows, bins: Sequence[int]) -> DataFrame:
    """(keys, complexities): phrases over length for each number of equal-width bins; rows carry the extremes `lo` and `hi`.
    Sequences with values that are not finite have none."""
    keys = list(rows.keys)
    blocks = rows.arrays(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    blocks = blocks.where("abs(lo) < double('inf') AND abs(hi) < double('inf')")
    parsed = _parsed(blocks, keys, _equal_width(bins)(F.col("xs"), F.col("lo"), F.col("hi")))
    cells = [F.max(F.when(F.col("symbols") == b, F.col("phrases") / F.col("n"))) for b in bins]
    return parsed.groupBy(*keys).agg(F.array(*cells).alias("complexities"))


def threshold_phrase_table(rows: SequenceRows, threshold: float) -> DataFrame:
    """(keys, complexity): the same over the two symbols above and not above a threshold; rows carry `lo` and `hi`."""
    keys = list(rows.keys)
    blocks = rows.arrays(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    blocks = blocks.where("abs(lo) < double('inf') AND abs(hi) < double('inf')")
    parsed = _parsed(blocks, keys, _two_sided(threshold)(F.col("xs")))
    return parsed.select(*keys, (F.col("phrases") / F.col("n")).alias("complexity"))
