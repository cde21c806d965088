"""Random forests grown in two parts. The upper levels of all trees come from histograms that are added up over the rows, a pass
a level, until the rows of a node fit one task; from there a task grows the whole subtree of its node. So a full tree takes a few
passes and one shuffle, and neither the rows nor the trees pass through the driver. Cuts lie between quantile bins."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.random_trees import ADDERS, CELLS
from tidemark.session import cut_lineage

ID = "sequence_id"
# Bins of a feature, as many as Spark's own trees have, and values that stand for a batch.
BINS, SUMMARY = 32, 256
# Rows from which a task grows a subtree on its own.
PIECE_ROWS = 1 << 17
# Poisson(1) up to where doubles end.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


@dataclass
class Nodes:
    """Nodes by number: feature (-1: a leaf), last bin of the left side, left child (the right one follows), class shares or mean."""

    feature: np.ndarray
    bin: np.ndarray
    child: np.ndarray
    value: np.ndarray

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The leaf that each row comes to."""
        at = np.zeros(len(codes), np.int64)
        going = np.flatnonzero(self.feature[at] >= 0)
        while len(going):
            node = at[going]
            at[going] = self.child[node] + (codes[going, self.feature[node]] > self.bin[node])
            going = going[self.feature[at[going]] >= 0]
        return at


@dataclass(frozen=True)
class Growth:
    """What a tree is grown by: classes (0: a real label), features drawn at a node, fewest rows of a side, least gain."""

    classes: int
    drawn: int
    min_rows: int
    least: float
    seed: int

    @property
    def stats(self) -> int:
        return self.classes or 3

    def sums(self, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Sums a row adds to its cells: its weight in its class, or its weight, label and squared label."""
        if self.classes:
            return np.eye(self.classes)[y.astype(int)] * w[:, None]
        return np.stack((w, w * y, w * y * y), axis=1)

    def rows(self, sums: np.ndarray) -> np.ndarray:
        return sums.sum(-1) if self.classes else sums[..., 0]

    def purity(self, sums: np.ndarray) -> np.ndarray:
        """What a cut makes greater: the fall in rows times impurity is the sum of both sides' less the node's own."""
        top = (sums**2).sum(-1) if self.classes else sums[..., 1] ** 2
        return top / np.maximum(self.rows(sums), 1e-300)

    def impure(self, sums: np.ndarray) -> np.ndarray:
        whole = self.rows(sums) if self.classes else sums[..., 2]
        return (whole - self.purity(sums) > self.least) & (self.rows(sums) >= 2 * self.min_rows)

    def values(self, sums: np.ndarray) -> np.ndarray:
        n = np.maximum(self.rows(sums), 1e-300)[..., None]
        return sums / n if self.classes else sums[..., 1:2] / n

    def draw(self, nodes: int, wide: int, *place: int) -> np.ndarray:
        if self.drawn >= wide:
            return np.tile(np.arange(wide), (nodes, 1))
        shuffled = np.random.default_rng((self.seed, *place)).random((nodes, wide))
        return np.argpartition(shuffled, self.drawn - 1, axis=1)[:, : self.drawn]

    def histogram(self, codes: np.ndarray, own: np.ndarray, at: np.ndarray, drawn: np.ndarray) -> np.ndarray:
        """Sums by node, drawn feature and bin; `at` is the place of each row's node in `drawn`."""
        nodes, m = drawn.shape
        cell = (at[:, None] * m + np.arange(m)) * BINS + codes[np.arange(len(codes))[:, None], drawn[at]]
        size = nodes * m * BINS
        out = np.empty((size, self.stats))
        for s in range(self.stats):
            out[:, s] = np.bincount(cell.ravel(), np.repeat(own[:, s], m), size)
        return out.reshape(nodes, m, BINS, self.stats)

    def best(self, cells: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per node the gain (none: -1) of the best cut, the place of its feature, its bin, and the sums on its left."""
        left = cells.cumsum(axis=2)[:, :, :-1]
        right = here[:, None, None] - left
        gain = self.purity(left) + self.purity(right) - self.purity(here)[:, None, None]
        fewest = np.minimum(self.rows(left), self.rows(right))
        gain = np.where((fewest >= max(self.min_rows, 0.5)) & (gain > self.least), gain, -1.0).reshape(len(cells), -1)
        pick = gain.argmax(1)
        place, cut = np.divmod(pick, BINS - 1)
        each = np.arange(len(cells))
        return gain[each, pick], place, cut, left[each, place, cut]


def grow(codes: np.ndarray, y: np.ndarray, w: np.ndarray, how: Growth, depth: int, place: tuple[int, ...]) -> tuple[Nodes, np.ndarray]:
    """The tree of these rows, and the gains of the features."""
    wide = codes.shape[1]
    own = how.sums(y, w)
    parts = {"feature": [], "bin": [], "child": []}
    sums = own.sum(0)[None]
    values, gains, made = [how.values(sums)], np.zeros(wide), 1
    # All nodes of a level with their numbers; rows of settled nodes leave.
    feature, cut, child = (np.full(1, v) for v in (-1, 0, -1))
    active = np.flatnonzero(how.impure(sums))
    at = np.zeros(len(codes), np.int64) if len(active) else None
    level = 0
    while len(active) and level < depth:
        drawn = how.draw(len(active), wide, *place, level)
        order = np.argsort(at, kind="stable")
        codes, own, at = codes[order], own[order], at[order]
        step = max(1, CELLS // (drawn.shape[1] * BINS * how.stats))
        found = []
        for low in range(0, len(active), step):
            some = slice(*np.searchsorted(at, (low, low + step)))
            cells = how.histogram(codes[some], own[some], at[some] - low, drawn[low : low + step])
            found.append(how.best(cells, sums[active[low : low + step]]))
        gain, slot, bins, left = (np.concatenate(c) for c in zip(*found))
        split = np.flatnonzero(gain > 0)
        chosen = drawn[split, slot[split]]
        np.add.at(gains, chosen, gain[split])
        feature[active[split]], cut[active[split]] = chosen, bins[split]
        child[active[split]] = made + 2 * np.arange(len(split))
        for name, column in (("feature", feature), ("bin", cut), ("child", child)):
            parts[name].append(column)
        # The children are the next level: left and right in turn.
        rank = np.full(len(active), -1)
        rank[split] = np.arange(len(split))
        here = sums[active[split]]
        sums = np.stack((left[split], here - left[split]), axis=1).reshape(-1, how.stats)
        made += len(sums)
        values.append(how.values(sums))
        feature, cut, child = np.full(len(sums), -1), np.zeros(len(sums), int), np.full(len(sums), -1)
        active = np.flatnonzero(how.impure(sums))
        kept = rank[at] >= 0
        codes, own, at = codes[kept], own[kept], at[kept]
        to = rank[at]
        side = codes[np.arange(len(codes)), chosen[to]] > bins[split][to] if len(codes) else np.zeros(0, bool)
        number = np.full(len(sums), -1)
        number[active] = np.arange(len(active))
        at = number[2 * to + side]
        kept = at >= 0
        codes, own, at, level = codes[kept], own[kept], at[kept], level + 1
    for name, column in (("feature", feature), ("bin", cut), ("child", child)):
        parts[name].append(column)
    return Nodes(*[np.concatenate(parts[c]).astype(np.int32) for c in parts], np.concatenate(values)), gains


def bag(hashes: np.ndarray, tree: int, trees: int) -> np.ndarray:
    """How often each row is in the sample of a tree: Poisson(1), from the hash of the row; a single tree takes each once."""
    if trees == 1:
        return np.ones(len(hashes))
    with np.errstate(over="ignore"):
        z = hashes.view(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(_POISSON, ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / 2.0**53, side="right").astype(float)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _codes(column) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.uint8).reshape(len(parts), -1)


def bin_cuts(rows: DataFrame) -> list[np.ndarray]:
    """For each feature at most BINS - 1 ascending cuts: between all its values if they are few, else near its quantiles."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.sort(_matrix(batch.column("x"), batch.num_rows), axis=0)
            out: tuple[list, list, list] = ([], [], [])
            for i in range(x.shape[1]):
                v, n = np.unique(x[:, i], return_counts=True)
                if len(v) > SUMMARY:
                    v = x[((np.arange(SUMMARY) + 0.5) / SUMMARY * len(x)).astype(int), i]
                    n = np.full(SUMMARY, len(x) / SUMMARY)
                out[0].append(i), out[1].append(v), out[2].append(n.astype(float))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int32()), *[pa.array(c, pa.list_(pa.float64())) for c in out[1:]]], names=["i", "v", "n"]
            )

    def merged(table: pa.Table) -> pa.Table:
        v, back = np.unique(table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        n = np.bincount(back, table.column("n").combine_chunks().flatten().to_numpy(zero_copy_only=False))
        if len(v) > BINS:
            upto = np.cumsum(n) / n.sum()
            at = np.unique(np.searchsorted(upto, np.arange(1, BINS) / BINS))
            at = at[at < len(v) - 1]
        else:
            at = np.arange(len(v) - 1)
        # A cut is the greatest value on its left.
        return pa.table({"i": table.column("i").slice(0, 1), "cuts": pa.array([v[at]], pa.list_(pa.float64()))})

    x = rows.select(vector_to_array("features").alias("x"))
    found = x.mapInArrow(summary, "i int, v array<double>, n array<double>").groupBy("i").applyInArrow(merged, "i int, cuts array<double>")
    return [np.array(r["cuts"], float) for r in sorted(found.collect())]


def encoded(rows: DataFrame, cuts: list[np.ndarray], *columns: str) -> DataFrame:
    """The columns and `codes`, a byte a feature."""
    kept = rows.select(*columns, vector_to_array("features").alias("x"))
    schema = ", ".join([*[f"`{c}` {t}" for c, t in kept.dtypes if c != "x"], "codes binary"])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"), batch.num_rows)
                bins = np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], axis=1).astype(np.uint8)
                own = [batch.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*own, pa.array([r.tobytes() for r in bins], pa.binary())], names=[*columns, "codes"])

    return kept.mapInArrow(code, schema)


def _summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of what `part` makes of all batches: in the tasks, then in a few, then in one."""

    def added(arrays: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = None
        for own in arrays:
            total = own.copy() if total is None else np.add(total, own, out=total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["t"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added(part(b) for b in batches if b.num_rows)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added(np.frombuffer(data.as_py()) for b in batches for data in b.column("t"))

    few = rows.mapInArrow(first, "t binary").repartition(ADDERS).mapInArrow(again, "t binary")
    return np.frombuffer(few.repartition(1).mapInArrow(again, "t binary").first()["t"])


class _Top:
    """The upper nodes of one tree while they grow."""

    def __init__(self, sums: np.ndarray):
        self.feature, self.bin, self.child, self.level, self.sums = [-1], [0], [-1], [0], [sums]

    def split(self, node: int, feature: int, cut: int, left: np.ndarray) -> range:
        self.feature[node], self.bin[node], self.child[node] = feature, cut, len(self.feature)
        for sums in (left, self.sums[node] - left):
            self.feature.append(-1), self.bin.append(0), self.child.append(-1)
            self.level.append(self.level[node] + 1), self.sums.append(sums)
        return range(self.child[node], self.child[node] + 2)

    def nodes(self, how: Growth) -> Nodes:
        return Nodes(*[np.array(c) for c in (self.feature, self.bin, self.child)], how.values(np.stack(self.sums)))


def _upper_levels(rows: DataFrame, how: Growth, trees: int, wide: int, depth: int, piece_rows: int, gains: np.ndarray) -> list[_Top]:
    """Trees down to the nodes that one task can hold, or that need no further cut."""

    def weighed(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        codes, y = _codes(batch.column("codes")), batch.column("label").to_numpy()
        hashes = batch.column("h").to_numpy()
        for t in range(trees):
            w = bag(hashes, t, trees)
            inside = np.flatnonzero(w)
            yield t, codes[inside], y[inside], w[inside]

    def roots(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([how.sums(y, w).sum(0) for _t, _codes_, y, w in weighed(batch)]).ravel()

    tops = [_Top(s) for s in _summed(rows, roots).reshape(trees, how.stats)]

    def large(t: int, node: int) -> bool:
        sums = tops[t].sums[node]
        return bool(how.rows(sums) > piece_rows and how.impure(sums) and tops[t].level[node] < depth)

    active = [(t, 0) for t in range(trees) if large(t, 0)]
    step = max(1, CELLS // (min(how.drawn, wide) * BINS * how.stats))
    while active:
        following: list[tuple[int, int]] = []
        for low in range(0, len(active), step):
            some = active[low : low + step]
            drawn = np.concatenate([how.draw(1, wide, t, node) for t, node in some])
            shapes = {t: tops[t].nodes(how) for t in dict.fromkeys(t for t, _ in some)}
            number = {t: np.full(len(s.feature), -1) for t, s in shapes.items()}
            for i, (t, node) in enumerate(some):
                number[t][node] = i

            def cells(batch: pa.RecordBatch, drawn=drawn, shapes=shapes, number=number) -> np.ndarray:
                out = np.zeros((*drawn.shape, BINS, how.stats))
                for t, codes, y, w in weighed(batch):
                    if t in shapes:
                        at = number[t][shapes[t].leaves(codes)]
                        met = np.flatnonzero(at >= 0)
                        mine = np.flatnonzero(np.bincount(at[met], minlength=len(drawn)))
                        place = np.searchsorted(mine, at[met])
                        out[mine] += how.histogram(codes[met], how.sums(y[met], w[met]), place, drawn[mine])
                return out.ravel()

            table = _summed(rows, cells).reshape(*drawn.shape, BINS, how.stats)
            gain, slot, cut, left = how.best(table, np.stack([tops[t].sums[node] for t, node in some]))
            for i, (t, node) in enumerate(some):
                if gain[i] > 0:
                    feature = int(drawn[i, slot[i]])
                    gains[t, feature] += gain[i]
                    following += [(t, c) for c in tops[t].split(node, feature, int(cut[i]), left[i]) if large(t, c)]
        active = following
    return tops


def drawn_features(rule: str, wide: int, trees: int, classes: bool) -> int:
    """How many features a node draws, by the names that Spark's trees know."""
    if rule == "auto":
        rule = "all" if trees == 1 else "sqrt" if classes else "onethird"
    named = {"all": wide, "sqrt": math.ceil(math.sqrt(wide)), "log2": max(1, math.ceil(math.log2(wide))), "onethird": math.ceil(wide / 3)}
    if rule in named:
        return named[rule]
    number = float(rule)
    return min(wide, max(1, int(number) if rule.isdigit() else math.ceil(number * wide)))


@dataclass
class RandomForest:
    """Trees on bootstrap samples; a node takes the best cut of the features it draws. Fits (id, features, label) rows."""

    classification: bool
    trees: int = 100
    seed: int = 42
    depth: int = 30
    min_rows: int = 1
    features: str = "auto"
    piece_rows: int = PIECE_ROWS

    def fit(self, train: DataFrame) -> RandomForestModel:
        cuts = bin_cuts(train)
        wide, trees, depth = len(cuts), self.trees, self.depth
        hashed = train.select(F.xxhash64(F.lit(self.seed), ID).alias("h"), F.col("label").cast("double"), "features")
        rows = cut_lineage(encoded(hashed, cuts, "h", "label"))
        n, top_label, mean, spread = rows.agg(F.count(F.lit(1)), F.max("label"), F.avg("label"), F.var_pop("label")).first()
        classes = int(top_label) + 1 if self.classification else 0
        drawn = drawn_features(self.features, wide, trees, self.classification)
        # Differences below the rounding of the sums are none.
        how = Growth(classes, drawn, self.min_rows, 1e-9 if classes else 1e-12 * max(n * spread, 1e-300), self.seed)
        if not classes:
            # Sums of squares lose least around the mean.
            rows = rows.withColumn("label", F.col("label") - F.lit(mean))
        gains = np.zeros((trees, wide))
        tops = _upper_levels(rows, how, trees, wide, depth, self.piece_rows, gains)
        shapes = [t.nodes(how) for t in tops]
        levels = [np.array(t.level) for t in tops]
        # Leaves that no task has to grow are nodes of their own.
        done = [
            (s.feature < 0) & ~np.array([how.impure(x) and how.rows(x) <= self.piece_rows for x in t.sums]) for s, t in zip(shapes, tops)
        ]

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                codes, hashes = _codes(batch.column("codes")), batch.column("h").to_numpy()
                for t, shape in enumerate(shapes):
                    w, at = bag(hashes, t, trees), shape.leaves(codes)
                    kept = np.flatnonzero((w > 0) & ~done[t][at])
                    if len(kept):
                        own = batch.take(pa.array(kept))
                        fields = [pa.array(np.full(len(kept), t, np.int32)), pa.array(at[kept].astype(np.int32)), pa.array(w[kept])]
                        yield pa.RecordBatch.from_arrays([*fields, own.column("h"), own.column("label"), own.column("codes")], names=["tree", "piece", "w", "h", "label", "codes"])

        schema = "tree int, piece int, feature binary, bin binary, child binary, value binary, gains array<double>"

        def packed(tree: int, piece: int, nodes: Nodes, own: np.ndarray) -> pa.Table:
            fields = [nodes.feature.astype(np.int32), nodes.bin.astype(np.int32), nodes.child.astype(np.int32), nodes.value]
            data = [pa.array([a.tobytes()], pa.binary()) for a in fields]
            keys = [pa.array([k], pa.int32()) for k in (tree, piece)]
            return pa.Table.from_arrays([*keys, *data, pa.array([own], pa.list_(pa.float64()))], names=["tree", "piece", "feature", "bin", "child", "value", "gains"])

        def grown(table: pa.Table) -> pa.Table:
            # In one order whatever the shuffle brought first, so that sums of reals agree from run to run.
            table = table.sort_by([("h", "ascending"), ("label", "ascending")])
            t, piece = table.column("tree")[0].as_py(), table.column("piece")[0].as_py()
            y, w = table.column("label").to_numpy(), table.column("w").to_numpy()
            return packed(t, piece, *grow(_codes(table.column("codes")), y, w, how, depth - int(levels[t][piece]), (t, piece)))

        pieces = sum(int(((s.feature < 0) & ~d).sum()) for s, d in zip(shapes, done))
        cut = rows.mapInArrow(dealt, "tree int, piece int, w double, h long, label double, codes binary")
        subtrees = cut_lineage(cut.repartition(_parts(pieces), "tree", "piece").groupBy("tree", "piece").applyInArrow(grown, schema))
        single = [
            packed(t, int(p), Nodes(*(np.array([v]) for v in (-1, 0, -1)), s.value[p : p + 1]), np.zeros(wide)).to_pylist()[0]
            for t, (s, d) in enumerate(zip(shapes, done)) for p in np.flatnonzero(d)
        ]
        if single:
            subtrees = subtrees.unionByName(train.sparkSession.createDataFrame(single, schema))
        return RandomForestModel(cuts, shapes, classes, 0.0 if classes else mean, subtrees, n, len(single) + pieces, gains)


def _parts(pieces: int) -> int:
    return max(8, min(2 * pieces, 512))


@dataclass
class RandomForestModel:
    """Upper nodes, and a written table of the subtrees below them."""

    cuts: list[np.ndarray]
    tops: list[Nodes]
    classes: int
    mean: float
    subtrees: DataFrame
    n_train: int
    pieces: int
    gains: np.ndarray

    def importances(self) -> np.ndarray:
        """Share of each feature in the gains of a tree, averaged over the trees."""
        each = self.subtrees.select("tree", F.posexplode("gains").alias("i", "g")).groupBy("tree", "i").agg(F.sum("g").alias("g"))
        gains = self.gains.copy()
        for r in each.collect():
            gains[r["tree"], r["i"]] += r["g"]
        total = gains.sum(1, keepdims=True)
        share = (gains / np.where(total > 0, total, 1)).sum(0)
        return share / (share.sum() or 1.0)

    def transform(self, rows: DataFrame) -> DataFrame:
        """The rows with `prediction`, and class shares as `probabilities` or the predictions of the single trees as `each`.
        Rows have different ids."""
        kind = dict(rows.dtypes)[ID]
        test = encoded(rows, self.cuts, ID)
        tops, classes, mean = self.tops, self.classes, self.mean

        # Many rows for few trees: a subtree is sent to several tasks.
        copies = max(1, math.ceil(rows.count() / max(self.n_train, PIECE_ROWS)))

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                codes = _codes(batch.column("codes"))
                part = np.arange(len(codes), dtype=np.int32) % copies
                for t, shape in enumerate(tops):
                    keys = [np.full(len(codes), t, np.int32), shape.leaves(codes).astype(np.int32), part]
                    yield pa.RecordBatch.from_arrays([batch.column(ID), *map(pa.array, keys), batch.column("codes")], names=[ID, "tree", "piece", "part", "codes"])

        def voted(left: pa.Table, right: pa.Table) -> pa.Table:
            out = None
            if left.num_rows and right.num_rows:
                feature, cut, child = (np.frombuffer(right.column(c)[0].as_py(), np.int32) for c in ("feature", "bin", "child"))
                value = np.frombuffer(right.column("value")[0].as_py()).reshape(len(feature), -1)
                nodes = Nodes(feature, cut, child, value)
                out = list(value[nodes.leaves(_codes(left.column("codes")))] + mean)
            some = left.select([ID, "tree"]).slice(0, left.num_rows if out else 0)
            return some.append_column("out", pa.array(out or [], pa.list_(pa.float64())))

        keys = ["tree", "piece", "part"]
        copied = self.subtrees.select("tree", "piece", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("part"), "feature", "bin", "child", "value")
        parts = _parts(self.pieces * copies)
        sent = test.mapInArrow(routed, f"`{ID}` {kind}, tree int, piece int, part int, codes binary").repartition(parts, *keys)
        votes = sent.groupBy(*keys).cogroup(copied.repartition(parts, *keys).groupBy(*keys)).applyInArrow(voted, f"`{ID}` {kind}, tree int, out array<double>")
        # Added up in the order of the trees, so that runs agree to the last digit.
        each = F.array_sort(F.collect_list(F.struct("tree", "out")))
        votes = votes.groupBy(ID).agg(F.transform(each, lambda s: s["out"]).alias("__outs"))
        zeros = F.array_repeat(F.lit(0.0), classes or 1)
        total = F.aggregate("__outs", zeros, lambda a, o: F.zip_with(a, o, lambda x, y: x + y))
        shares = F.transform(total, lambda x: x / F.size("__outs"))
        if classes:
            votes = votes.select(ID, shares.alias("probabilities"))
            best = (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("double")
            votes = votes.withColumn("prediction", best)
        else:
            votes = votes.select(ID, shares[0].alias("prediction"), F.transform("__outs", lambda o: o[0]).alias("each"))
        return rows.join(votes, ID)
