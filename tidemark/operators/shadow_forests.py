"""Forests on features and their shuffled copies. All rows are held as blocks of codes, a byte a value: a code says between
which cuts of its feature a value lies. Cuts come from the counts of all values, copies are dealt by a permutation of all
ranks, and the trees of a forest grow level by level in the same passes over the blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import sanitise
from tidemark.operators.position import prefix_sums
from tidemark.operators.random_trees import LEAST_GAIN, Tree, _impurity
from tidemark.session import Scratch

# Cells of a block, and blocks of a table: with more cells blocks grow. Cuts of a feature, and codes between and on them.
BLOCK_CELLS, MOST_BLOCKS = 1 << 18, 1 << 11
CUTS = 32
CODES, ABSENT = 2 * (CUTS + 1) + 1, 255
# Numbers of one table of sums (8 bytes each): a level with more nodes takes several passes. Tables the driver adds up itself.
CELLS, ADDERS = 1 << 18, 16
# The depth of Spark's forests where none is given.
DEPTH = 5

_POISSON = np.searchsorted(np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1), dtype=float) for k in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def seeds(*numbers: int) -> np.random.SeedSequence:
    return np.random.SeedSequence([x % (1 << 64) for x in numbers])


def _sorted_blocks(table: pa.Table, size: int) -> pa.Table:
    """The rows of one bucket, by id: labels (place -1) and cells, as one row of label and value arrays. Missing cells are NaN."""
    table = table.combine_chunks()
    table = table.take(pc.sort_indices(table, sort_keys=[("id", "ascending"), ("place", "ascending"), ("value", "ascending")]))
    ids, place, value = table.column("id"), table.column("place").to_numpy(), table.column("value").to_numpy(zero_copy_only=False)
    own = np.zeros(len(place), np.int64)
    if len(place) > 1:
        own[1:] = np.cumsum(pc.not_equal(ids.slice(1), ids.slice(0, len(place) - 1)).to_numpy(zero_copy_only=False))
    label, cell = place < 0, place >= 0
    x = np.full((size, own[-1] + 1), np.nan)
    x[place[cell], own[cell]] = value[cell]
    has = np.zeros(own[-1] + 1, bool)
    has[own[cell]] = True
    asked = np.unique(own[label])
    seen = ~np.isnan(x[:, asked]).all(1) if len(asked) else np.zeros(size, bool)
    rows = own[label & ~np.isnan(value) & has[own]]
    y = value[label & ~np.isnan(value) & has[own]]
    bucket = table.column("bucket")[0].as_py()
    return pa.table({
        "bucket": pa.array([bucket], pa.int64()), "n": pa.array([len(rows)], pa.int64()), "y": pa.array([y.tobytes()], pa.binary()),
        "x": pa.array([np.ascontiguousarray(x[:, rows]).tobytes()], pa.binary()), "seen": pa.array([seen.tobytes()], pa.binary()),
    })


def _arrays(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Labels and values (features by rows) of a block."""
    return np.frombuffer(row["y"]), np.frombuffer(row["x"]).reshape(-1, row["n"])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def value_cuts(raw: DataFrame, size: int) -> list[np.ndarray]:
    """For each feature the values at which a share of 1 / CUTS of all rows ends, exactly; all values where they are few; and 0,
    which missing cells get."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            for i, values in enumerate(_arrays(row)[1]):
                found, n = np.unique(values[~np.isnan(values)] + 0.0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), i, np.int32)), pa.array(found), pa.array(n)], names=["place", "value", "n"])

    counts = raw.mapInArrow(counted, "place int, value double, n long").groupBy("place", "value").agg(F.sum("n").alias("n"))
    with Scratch(raw.sparkSession) as scratch:
        counts = scratch.cut(counts)
        few = counts.groupBy("place").agg(F.count("*").alias("values")).where(F.col("values") <= CUTS).select("place")
        few = [r["place"] for r in few.collect()]
        ranked = prefix_sums(counts, ["place"], ["value"], {"n": F.col("n")})
        share = lambda n: F.least(F.floor(n * CUTS / F.col("n_total")), F.lit(CUTS - 1))
        inside = share(F.col("n_before")) < share(F.col("n_before") + F.col("n"))
        cuts: list[list[float]] = [[0.0] for _ in range(size)]
        for r in ranked.where(inside | F.col("place").isin(few)).select("place", "value").collect():
            cuts[r["place"]].append(r["value"])
    return [np.unique(c) for c in cuts]


def codes_of(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """A value on a cut has a code of its own, between those of the values below and above it."""
    out = np.full(x.shape, ABSENT, np.uint8)
    for row, values, at in zip(out, x, cuts):
        known = ~np.isnan(values)
        row[known] = np.searchsorted(at, values[known], "left") + np.searchsorted(at, values[known], "right")
    return out


def dealt(rank: np.ndarray, n: int, key: np.ndarray) -> np.ndarray:
    """Where a permutation of 0 .. n - 1 takes the ranks: Feistel rounds with the keys, again where they leave the range."""
    half = np.uint64(max(1, (max(n - 1, 0).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = rank.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in key:
            z = right + k
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


@dataclass
class Blocks:
    """(block, n, y, x) rows of codes; how many cells each block has of each feature, and what the trees need to know."""

    table: DataFrame
    present: np.ndarray
    seen: np.ndarray
    cuts: list[np.ndarray]
    classes: int
    shift: float


def coded_blocks(scratch: Scratch, features: DataFrame, labels: DataFrame, names: Sequence[str], classes: int, id_col: str) -> Blocks:
    """features (id, feature, value) of all ids in labels (id, label) as blocks; ids without a label only count as seen."""
    spark, size = features.sparkSession, len(names)
    # The names are size-checked where they are listed.
    places = spark.createDataFrame(list(enumerate(names)), "place int, feature string")
    cells = features.join(F.broadcast(places), "feature").select(F.col(id_col).alias("id"), "place", sanitise("value").alias("value"))
    rows = cells.union(labels.select(id_col, F.lit(-1), F.coalesce(F.col("label"), F.lit(float("nan"))))).where("id IS NOT NULL")
    total = features.count()
    buckets = max(1, min(MOST_BLOCKS, -(-total // BLOCK_CELLS)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets))).repartition(buckets, "bucket")
    kinds = "bucket long, n long, y binary, x binary, seen binary"
    raw = scratch.cut(rows.groupBy("bucket").applyInArrow(lambda t: _sorted_blocks(t, size), kinds))
    told = sorted(raw.select("bucket", "n", "seen").collect())
    seen = np.array([np.frombuffer(r["seen"], bool) for r in told]).reshape(len(told), size).any(0)
    number = {r["bucket"]: i for i, r in enumerate(r for r in told if r["n"])}
    filled = raw.where("n > 0")
    cuts = value_cuts(filled, size)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            y, x = _arrays(row)
            x = codes_of(x, cuts)
            held = (x != ABSENT).sum(1)
            values = [number[row["bucket"]], row["n"], y.tobytes(), x.tobytes(), held.tobytes(), float(y.sum())]
            yield pa.RecordBatch.from_pylist([dict(zip(("block", "n", "y", "x", "held", "total"), values))], schema=form)

    form = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("y", pa.binary()), ("x", pa.binary()), ("held", pa.binary()), ("total", pa.float64())])
    table = scratch.cut(filled.mapInArrow(coded, "block long, n long, y binary, x binary, held binary, total double"), raw)
    told = sorted(table.select("block", "n", "held", "total").collect())
    present = np.array([np.frombuffer(r["held"], np.int64) for r in told], np.int64).reshape(len(told), size)
    n = np.array([r["n"] for r in told], np.int64)
    shift = 0.0 if classes or not len(n) else sum(r["total"] for r in told) / n.sum()
    return Blocks(table.select("block", "n", "y", "x"), present, seen, cuts, classes, shift)


def with_shadows(blocks: Blocks, live: Sequence[int], seed: int) -> DataFrame:
    """Blocks of the features in `live`, and after them of their shadows: the values of a feature dealt to other rows that have it."""
    live = list(live)
    starts = np.cumsum(blocks.present, axis=0) - blocks.present
    totals = blocks.present.sum(0)
    keys = {f: seeds(seed, f).generate_state(8, np.uint64) for f in live}
    count = len(live)
    zero = [int(codes_of(np.zeros((1, 1)), [blocks.cuts[f]])[0, 0]) for f in live]
    form = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("y", pa.binary()), ("x", pa.binary()), ("held", pa.binary()), ("at", pa.binary())])
    kinds = "block long, n long, y binary, x binary, held binary, at binary"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            x = np.frombuffer(row["x"], np.uint8).reshape(-1, row["n"])[live]
            yield pa.RecordBatch.from_pylist([{"block": row["block"], "n": row["n"], "y": row["y"], "x": x.tobytes()}], schema=form)
            goal, at, code = [], [], []
            for i, f in enumerate(live):
                known = x[i][x[i] != ABSENT]
                to = dealt(starts[row["block"], f] + np.arange(len(known)), int(totals[f]), keys[f])
                block = np.searchsorted(starts[:, f], to, "right") - 1
                goal.append(block * count + i)
                at.append((to - starts[block, f]).astype(np.uint32))
                code.append(known)
            goal, at, code = (np.concatenate(c) for c in (goal, at, code))
            order = np.argsort(goal, kind="stable")
            goal, at, code = goal[order], at[order], code[order]
            own = goal // count
            blocks_to, first = np.unique(own, return_index=True)
            ends = [*first[1:].tolist(), len(own)]
            held = [np.bincount(goal[a:b] % count, minlength=count).tobytes() for a, b in zip(first.tolist(), ends)]
            parts = [
                pa.array(blocks_to, pa.int64()), pa.nulls(len(ends), pa.int64()), pa.nulls(len(ends), pa.binary()),
                pa.array([code[a:b].tobytes() for a, b in zip(first.tolist(), ends)], pa.binary()),
                pa.array(held, pa.binary()), pa.array([at[a:b].tobytes() for a, b in zip(first.tolist(), ends)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(parts, schema=form)

    def gathered(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["y"] is not None)
        x = np.frombuffer(own["x"], np.uint8).reshape(count, own["n"])
        absent = x == ABSENT
        out = np.repeat(np.array(zero, np.uint8)[:, None], own["n"], axis=1)
        places = [np.flatnonzero(~a) for a in absent]
        for r in rows:
            if r["y"] is not None:
                continue
            held = np.cumsum([0, *np.frombuffer(r["held"], np.int64)])
            at, code = np.frombuffer(r["at"], np.uint32), np.frombuffer(r["x"], np.uint8)
            for i in range(count):
                out[i, places[i][at[held[i] : held[i + 1]]]] = code[held[i] : held[i + 1]]
        x = np.where(absent, np.array(zero, np.uint8)[:, None], x)
        whole = np.concatenate((x, out)).tobytes()
        return pa.table({"block": pa.array([own["block"]], pa.int64()), "n": pa.array([own["n"]], pa.int64()), "y": pa.array([own["y"]], pa.binary()), "x": pa.array([whole], pa.binary())})

    return blocks.table.mapInArrow(spread, kinds).groupBy("block").applyInArrow(gathered, "block long, n long, y binary, x binary")


def _summed(table: DataFrame, part: Callable[[dict], np.ndarray], many: bool) -> np.ndarray:
    """What `part` makes of all blocks, added up in the tasks, where they are many in a few more, and on the driver."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for row in _each(batches):
            own = part(row)
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["t"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for row in _each(batches):
            own = np.frombuffer(row["t"])
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["t"])

    sums = table.mapInArrow(first, "t binary")
    if many:
        sums = sums.repartition(ADDERS).mapInArrow(again, "t binary")
    return sum(np.frombuffer(r["t"]) for r in sums.collect())


def importances(table: DataFrame, blocks: Blocks, size: int, trees: int, seed: int, depth: int = DEPTH) -> np.ndarray:
    """The share of each feature in what the splits of a random forest take off the impurity. A tree weighs each row by a
    Poisson draw; a node draws the root of the number of features (a third for a real target) and takes their best cut."""
    classes, shift = blocks.classes, blocks.shift
    stats = classes or 3
    m = size if trees == 1 else int(np.ceil(size**0.5 if classes else size / 3.0))
    many = len(blocks.present) > ADDERS
    forest = [Tree() for _ in range(trees)]
    gains = np.zeros((trees, size))

    def grown(nodes: list[tuple[int, int]], level: int) -> list[tuple[int, int]]:
        chosen = np.stack([np.random.default_rng(seeds(seed, t, node)).choice(size, m, replace=False) for t, node in nodes])
        slots: dict[int, np.ndarray] = {t: np.full(len(forest[t].feature), -1) for t, _ in nodes}
        for i, (t, node) in enumerate(nodes):
            slots[t][node] = i
        shapes = {t: tuple(np.array(c) for c in (forest[t].feature, forest[t].cut, forest[t].child)) for t in slots}
        cells = len(nodes) * m * CODES * stats

        def sums(row: dict) -> np.ndarray:
            x, y = np.frombuffer(row["x"], np.uint8).reshape(-1, row["n"]), np.frombuffer(row["y"])
            out = np.zeros(cells)
            for t, (feature, cut, child) in shapes.items():
                draw = np.random.default_rng(seeds(seed, t, 1 << 40, row["block"]))
                weight = _POISSON[draw.integers(0, 1 << 16, row["n"], np.uint16)]
                rows = np.flatnonzero(weight)
                at = np.zeros(len(rows), np.int64)
                for _ in range(level):
                    here = feature[at]
                    at = np.where(here < 0, at, child[at] + (x[here, rows] > cut[at]))
                slot = slots[t][at]
                rows, slot = rows[slot >= 0], slot[slot >= 0]
                w, own = weight[rows].astype(float), y[rows]
                for j in range(m):
                    place = ((slot * m + j) * CODES + x[chosen[slot, j], rows]) * stats
                    if classes:
                        out += np.bincount(place + own.astype(np.int64), w, cells)
                    else:
                        z = own - shift
                        for k, v in enumerate((w, w * z, w * z * z)):
                            out += np.bincount(place + k, v, cells)
            return out

        found = _summed(table, sums, many).reshape(len(nodes), m, CODES, stats)
        following = []
        for i, (t, node) in enumerate(nodes):
            tree = forest[t]
            left = found[i].cumsum(1)[:, :-1]
            here = found[i, 0].sum(0)
            right = here - left
            gain = _impurity(here, classes) - _impurity(left, classes) - _impurity(right, classes)
            n = lambda s: s.sum(-1) if classes else s[..., 0]
            gain = np.where((n(left) > 0.5) & (n(right) > 0.5), gain, -np.inf)
            j, code = np.unravel_index(int(gain.argmax()), gain.shape)
            if not gain[j, code] > LEAST_GAIN * max(float(_impurity(here, classes)), 1e-300):
                continue
            gains[t, chosen[i, j]] += gain[j, code]
            child = len(tree.feature)
            tree.feature[node], tree.cut[node], tree.child[node] = int(chosen[i, j]), float(code), child
            for _ in range(2):
                tree.feature.append(-1)
                tree.cut.append(0.0)
                tree.child.append(-1)
            following += [(t, child), (t, child + 1)]
        return following

    active, level = [(t, 0) for t in range(trees)] if len(blocks.present) else [], 0
    step = max(1, CELLS // (m * CODES * stats))
    while active and level < depth:
        active = [x for at in range(0, len(active), step) for x in grown(active[at : at + step], level)]
        level += 1
    total = gains.sum(1, keepdims=True)
    shares = (gains / np.where(total > 0, total, 1)).mean(0)
    return shares / (shares.sum() or 1.0)
