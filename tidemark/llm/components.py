"""Connected components of an edge table, by alternating star steps on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import Scratch, cut_lineage

# Edges that one task folds at once.
LOCAL_EDGES = 1 << 14


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star step, then one small-star step: every node is hung onto smaller and smaller neighbours."""
    arcs = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = arcs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = arcs.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(least.select("a", F.col("m").alias("b"))).distinct()


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges (a, b) of one task."""
    parts = [np.stack([batch.column(c).to_numpy() for c in ("a", "b")]) for batch in batches]
    nodes, places = np.unique(np.concatenate([np.empty((2, 0), np.int64), *parts], axis=1), return_inverse=True)
    a, b = places.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "root"])


def components(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """(a, b) pairs of longs -> (node, root): root is the smallest node reachable from node. Every node of an edge is in
    the result. Up to `local` edges are folded in one task. More stay in tables, of which each replaces the one before; the
    driver sees their count and a checksum, and rounds of star steps go on until nothing changes."""
    with Scratch(edges.sparkSession) as scratch:
        edges = scratch.cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
        mark = None
        while True:
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if now[0] <= local:
                return cut_lineage(edges.coalesce(1).mapInArrow(_folded, "node long, root long"))
            if now == mark:
                break
            mark, edges = now, scratch.cut(_stars(edges), edges)
        roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
        return cut_lineage(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots))
