"""Hard-negative mining by a vertical scan: blocks of vectors are read dimension by dimension, largest of the anchor's first;
what the other dimensions can still add bounds every candidate, and the candidates that are out leave the bitmap."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.common import quoted
from tidemark.session import cut_lineage

# Anchors that are broadcast at a time, on average; more anchors take more scans.
ANCHORS = 4096
# Dimensions read before the bitmap is looked at again: few at first, when each of them says most.
STEPS = (4, 4, 8)


@dataclass
class Columns:
    """A block of vectors by dimension, with what each dimension reaches from and to."""

    ids: np.ndarray
    labels: np.ndarray
    dims: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, kind: type) -> Columns:
        flat = batch.column("v").flatten().to_numpy().astype(kind)
        dims = np.ascontiguousarray(flat.reshape(batch.num_rows, -1).T)
        labels = batch.column("label").to_numpy(zero_copy_only=False)
        return cls(batch.column("id").to_numpy(), labels, dims, dims.min(1), dims.max(1))

    def scan(self, anchor: np.ndarray, bitmap: np.ndarray, useful) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the candidates of the bitmap that `useful(lowest, highest)` keeps to the end."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        reach = np.stack((anchor * self.low, anchor * self.high))[:, order]
        # What the dimensions from each one on add at least and at most.
        rest_low = np.append(np.cumsum(reach.min(0)[::-1])[::-1], 0)
        rest_high = np.append(np.cumsum(reach.max(0)[::-1])[::-1], 0)
        places = np.flatnonzero(bitmap)
        partial, at, step = np.zeros(len(places), self.dims.dtype), 0, 0
        while at < len(order) and len(places):
            dims = order[at : at + STEPS[min(step, len(STEPS) - 1)]]
            whole = 2 * len(places) > bitmap.size
            partial = partial + (anchor[dims] @ self.dims[dims])[places] if whole else partial + anchor[dims] @ self.dims[np.ix_(dims, places)]
            at, step = at + len(dims), step + 1
            stay = useful(partial + rest_low[at], partial + rest_high[at])
            places, partial = places[stay], partial[stay]
        return places, partial


class Best:
    """The k highest scores so far, ties by id."""

    def __init__(self, k: int, kind: type):
        self.k, self.scores, self.ids = k, np.empty(0, kind), np.empty(0, np.int64)

    @property
    def least(self) -> float:
        return self.scores[-1] if len(self.scores) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]

    def threshold(self, lowest: np.ndarray) -> float:
        """What a score must reach to be among the k, given candidates that score so much at least."""
        if len(lowest) < self.k or not self.k:
            return self.least
        return max(self.least, np.partition(lowest, len(lowest) - self.k)[len(lowest) - self.k])


def _positives(block: Columns, anchor: np.ndarray, own_id: int, label, best: Best) -> None:
    places, scores = block.scan(anchor, (block.labels == label) & (block.ids != own_id), lambda low, high: high >= best.threshold(low))
    best.add(scores, block.ids[places])


def _negatives(block: Columns, anchor: np.ndarray, label, windows: list[tuple[float, float, Best]]) -> None:
    """Windows: lowest and highest score, and the best in between."""

    def useful(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(low), bool)
        for least, most, best in windows:
            inside = low[(low >= least) & (high <= most)]
            stay |= (high >= max(least, best.threshold(inside))) & (low <= most)
        return stay

    places, scores = block.scan(anchor, block.labels != label, useful)
    ids = block.ids[places]
    for least, most, best in windows:
        inside = (scores >= least) & (scores <= most)
        best.add(scores[inside], ids[inside])


def integer_vectors(vector: Column, scale: int = 256) -> Column:
    """Each component x as floor(scale * x); null where the vector or a component is null or not finite, or there is none."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & fine & (F.size(vector) > 0), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _usable(rows: DataFrame, scale: int, vec_id: str, vector: str, label: str) -> tuple[DataFrame, type]:
    """(id, label, v) of the rows that take part, one an id, and the number type in which their scores are exact."""
    v = integer_vectors(quoted(vector), scale)
    own = rows.select(quoted(vec_id).cast("long").alias("id"), quoted(label).alias("label"), v.alias("v"))
    own = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    own = cut_lineage(own.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v"))
    highest = F.array_max(F.transform("v", F.abs))
    sizes = own.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.max(highest).alias("most"), F.min(F.array_min("v")).alias("least")).orderBy(F.desc("n"), "size").first()
    if sizes is None:
        return own, float
    bound = sizes["size"] * max(sizes["most"], -sizes["least"]) ** 2
    if bound >= 1 << 62:
        raise ValueError("scores of these vectors do not fit into 64 bits; give a smaller scale")
    return own.where(F.size("v") == sizes["size"]), np.float64 if bound < 1 << 52 else np.int64


def mine_hard_negatives(
    rows: DataFrame,
    *,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    band: tuple[int, int] = (30, 90),
    scale: int = 256,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    anchors: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row whose id is divisible by
    `every` and each of its `positives` highest-scoring other rows of the same label, the `negatives` highest-scoring rows of
    another label whose score lies between band[0] and band[1] per cent of the positive's, both included. A score is the inner
    product of the integer vectors floor(scale * x); equal scores by ascending id.

    Anchors are broadcast in parts of about `anchors`. Each part scans all rows twice, first for the positives, then for the
    negatives in their windows; a task takes its rows in blocks, turns a block into columns, and reads these in each anchor's
    order of descending magnitude. After a few columns the least and most that the others can add (from the block's range of
    each) bound every candidate; who can neither reach the k-th best lower bound nor a window leaves the bitmap. A task
    returns the best of its blocks only: `positives` rows an anchor, then `negatives` rows an anchor and positive.

    Rows with a null id or label, a null or empty vector, a null or non-finite component, or another length than most take
    no part; of rows that share an id the one with the least label and vector counts; equal vectors tie; fewer candidates
    give fewer rows; an empty table gives an empty result; other columns are left out. Scores beyond 62 bits raise.
    """
    spark = rows.sparkSession
    own, kind = _usable(rows, scale, vec_id, vector, label)
    own = own.select("id", "label", "v")
    asked = own.where(F.col("id") % every == 0)
    parts = max(1, -(-asked.count() // anchors))
    low, high = band
    found = []
    for part in range(parts):
        some = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).collect()
        queries = spark.sparkContext.broadcast([(r["id"], r["label"], np.array(r["v"], kind)) for r in some])

        def find_positives(batches: Iterator[pa.RecordBatch], queries=queries) -> Iterator[pa.RecordBatch]:
            best = [Best(positives, kind) for _ in queries.value]
            for batch in batches:
                if batch.num_rows:
                    block = Columns.of(batch, kind)
                    for (own_id, own_label, v), b in zip(queries.value, best):
                        _positives(block, v, own_id, own_label, b)
            times = [len(b.ids) for b in best]
            anchor = np.repeat(np.array([q[0] for q in queries.value], np.int64), times)
            columns = [anchor, *(np.concatenate([getattr(b, c) for b in best] or [np.empty(0)]).astype(np.int64) for c in ("ids", "scores"))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "positive_id", "positive_score"])

        first = own.mapInArrow(find_positives, "anchor_id long, positive_id long, positive_score long")
        rank = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
        # At most `positives` rows for each anchor of the part.
        chosen: dict[int, list[tuple[int, int]]] = {}
        for r in first.withColumn("rank", rank).where(F.col("rank") <= positives).orderBy("anchor_id", "rank").collect():
            chosen.setdefault(r["anchor_id"], []).append((r["positive_id"], r["positive_score"]))
        pairs = spark.sparkContext.broadcast(chosen)

        def find_negatives(batches: Iterator[pa.RecordBatch], queries=queries, pairs=pairs) -> Iterator[pa.RecordBatch]:
            # The least and greatest whole scores within the band.
            windows = {a: [(-(-low * s // 100), high * s // 100, Best(negatives, kind)) for _, s in own_pairs] for a, own_pairs in pairs.value.items()}
            for batch in batches:
                if batch.num_rows:
                    block = Columns.of(batch, kind)
                    for own_id, own_label, v in queries.value:
                        if some := [w for w in windows.get(own_id, ()) if w[0] <= w[1]]:
                            _negatives(block, v, own_label, some)
            out = [
                (np.full(len(b.ids), a), np.full(len(b.ids), p), np.full(len(b.ids), s), b.ids, b.scores.astype(np.int64))
                for a, own_windows in windows.items()
                for (p, s), (_, _, b) in zip(pairs.value[a], own_windows)
            ]
            columns = [np.concatenate(c).astype(np.int64) for c in zip(*out)] or [np.empty(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

        last = own.mapInArrow(find_negatives, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
        rank = F.row_number().over(W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
        last = last.withColumn("rank", rank).where(F.col("rank") <= negatives)
        found.append(cut_lineage(last.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")))
    whole = found[0]
    for f in found[1:]:
        whole = whole.union(f)
    return whole
