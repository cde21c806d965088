"""Extremely randomised trees, grown level by level: cut points are drawn, so a level needs the ranges of the values in each
node and then sums on both sides of the cuts, never an order of the values. All trees grow in the same passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Numbers of one table of ranges or sums (8 bytes each): a level with more nodes takes several passes. Tasks that add up first.
CELLS, ADDERS = 1 << 20, 16
# Gains below this part of a root's impurity are none.
LEAST_GAIN = 1e-12


@dataclass
class Tree:
    """Nodes by number: feature (-1: a leaf), cut, number of the left child (the right one follows), and the sums of its rows."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    child: list[int] = field(default_factory=lambda: [-1])
    sums: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0)])

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature), np.array(self.cut), np.array(self.child)


def leaves_of(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The leaf that each row comes to."""
    feature, cut, child = tree
    at = np.zeros(len(x), np.int64)
    going = np.flatnonzero(feature[at] >= 0)
    while len(going):
        node = at[going]
        at[going] = child[node] + (x[going, feature[node]] > cut[node])
        going = going[feature[at[going]] >= 0]
    return at


@dataclass
class Forest:
    trees: list[Tree]
    classes: int
    importances: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Rows by class shares, or by the mean of each target."""
        out = 0.0
        for tree in self.trees:
            sums = np.stack(tree.sums)[leaves_of(x, tree.arrays())]
            out = out + (sums / sums.sum(1, keepdims=True) if self.classes else sums[:, 1 : 1 + (sums.shape[1] - 1) // 2] / sums[:, :1])
        return out / len(self.trees)


def _combined(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray], join: Callable) -> np.ndarray | None:
    """What `part` makes of all batches, joined in the tasks, then in a few, then in one."""

    def packed(total) -> Iterator[pa.RecordBatch]:
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["t"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x, y = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("x", "y"))
                own = part(x, y)
                total = own if total is None else join(total, own)
        yield from packed(total)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column("t"):
                own = np.frombuffer(data.as_py())
                total = own if total is None else join(total, own)
        yield from packed(total)

    found = rows.mapInArrow(first, "t binary").repartition(ADDERS).mapInArrow(again, "t binary").repartition(1).mapInArrow(again, "t binary").first()
    return None if found is None else np.frombuffer(found["t"])


def _impurity(sums: np.ndarray, classes: int) -> np.ndarray:
    """Rows times impurity from the sums of the last axis: Gini of class counts, or squared deviations of all targets."""
    if classes:
        n = sums.sum(-1)
        return n - (sums**2).sum(-1) / np.maximum(n, 1e-300)
    n, wide = sums[..., 0], (sums.shape[-1] - 1) // 2
    return (sums[..., 1 + wide :] - sums[..., 1 : 1 + wide] ** 2 / np.maximum(n, 1e-300)[..., None]).sum(-1)


def fit_extra_trees(
    rows: DataFrame, classes: int = 0, trees: int = 50, seed: int = 42, depth: int | None = None, min_rows: int = 1, drawn: int | None = None, cells: int = CELLS
) -> Forest:
    """(features vector, label) -> the forest. `label` is a class 0 .. classes - 1, or with classes=0 a number or an array of
    numbers, whose squared deviations are added up, so that one tree serves several horizons.

    Each node draws `drawn` features (the root of their number for classes, else all) and for each a cut between the least and
    the greatest value of its rows, by a seed of its own; the cut with the greatest fall in impurity is taken. Every row of a
    pass finds its node in all trees; tables of more than `cells` numbers are made in several passes. A node is a leaf when its
    rows are alike, fewer than two times `min_rows`, at the depth, or without a cut that leaves `min_rows` on both sides."""
    label = F.col("label")
    kind = dict(rows.dtypes)["label"]
    y = label.cast("array<double>") if kind.startswith("array") else F.array(label.cast("double"))
    rows = rows.select(vector_to_array("features").alias("x"), y.alias("y"))
    size, wide = rows.select(F.size("x"), F.size("y")).first()
    stats = classes or 1 + 2 * wide
    m = min(size, drawn or (max(1, round(size**0.5)) if classes else size))

    def own_sums(y: np.ndarray) -> np.ndarray:
        if classes:
            return np.eye(classes)[y[:, 0].astype(int)]
        return np.concatenate((np.ones((len(y), 1)), y, y * y), axis=1)

    root = _combined(rows, lambda x, y: own_sums(y).sum(0), np.add)
    forest = [Tree(sums=[root]) for _ in range(trees)]
    whole = float(_impurity(root, classes))
    gains = np.zeros((trees, size))
    active = [(t, 0) for t in range(trees)] if whole > 0 else []
    level = 0
    while active and (depth is None or level < depth):
        following: list[tuple[int, int]] = []
        step = max(1, cells // (2 * m * max(stats, 2)))
        for at in range(0, len(active), step):
            following += _grown(rows, forest, active[at : at + step], m, size, stats, classes, seed, min_rows, whole, gains, own_sums)
        active, level = following, level + 1
    total = gains.sum(1, keepdims=True)
    return Forest(forest, classes, (gains / np.where(total > 0, total, 1)).mean(0))


def _grown(rows, forest, nodes, m, size, stats, classes, seed, min_rows, whole, gains, own_sums) -> list[tuple[int, int]]:
    """Split the nodes where that helps; the children that may be split again."""
    draws = [np.random.default_rng((seed, t, node)) for t, node in nodes]
    chosen = np.stack([r.choice(size, m, replace=False) for r in draws])
    share = np.stack([r.random(m) for r in draws])
    shapes = {t: forest[t].arrays() for t in dict.fromkeys(t for t, _ in nodes)}
    number = {t: np.full(len(shapes[t][0]), -1) for t in shapes}
    for i, (t, node) in enumerate(nodes):
        number[t][node] = i
    places = list(shapes.items())
    count = len(nodes)

    def found(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each tree the rows in one of the nodes, and which."""
        for t, shape in places:
            which = number[t][leaves_of(x, shape)]
            inside = np.flatnonzero(which >= 0)
            if len(inside):
                yield inside, which[inside]

    def ranges(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.full((2, count, m), np.inf)
        for inside, which in found(x):
            values = x[inside[:, None], chosen[which]]
            np.minimum.at(out[0], which, values)
            np.minimum.at(out[1], which, -values)
        return out.ravel()

    low, high = _combined(rows, ranges, np.minimum).reshape(2, count, m) * np.array([1, -1])[:, None, None]
    cuts = low + share * (high - low)
    cuts = np.where(cuts < high, cuts, low)

    def left_sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out, own = np.zeros((count, m, stats)), own_sums(y)
        for inside, which in found(x):
            left = x[inside[:, None], chosen[which]] <= cuts[which]
            np.add.at(out, which, left[:, :, None] * own[inside][:, None, :])
        return out.ravel()

    left = _combined(rows, left_sums, np.add).reshape(count, m, stats)
    following = []
    for i, (t, node) in enumerate(nodes):
        tree = forest[t]
        here = tree.sums[node]
        right = here - left[i]
        n = lambda s: s.sum(-1) if classes else s[..., 0]
        gain = _impurity(here, classes) - _impurity(left[i], classes) - _impurity(right, classes)
        gain = np.where((low[i] < high[i]) & (n(left[i]) >= min_rows) & (n(right) >= min_rows), gain, -np.inf)
        best = int(gain.argmax())
        if not gain[best] > -np.inf:
            continue
        gains[t, chosen[i, best]] += max(0.0, float(gain[best]))
        child = len(tree.feature)
        tree.feature[node], tree.cut[node], tree.child[node] = int(chosen[i, best]), float(cuts[i, best]), child
        for sums in (left[i, best], right[best]):
            tree.feature.append(-1)
            tree.cut.append(0.0)
            tree.child.append(-1)
            tree.sums.append(sums)
            if n(sums) >= 2 * min_rows and _impurity(sums, classes) > LEAST_GAIN * whole:
                following.append((t, len(tree.feature) - 1))
    return following
