"""Fold assignments: one row per sequence with its `fold` (0-based), or per (sequence, fold, role)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.position import ntile_of, with_position
from tidemark.session import cut_lineage, require_small

# Moves of groups between folds that one round makes at most.
MOVES = 1000

GROUP_NAMES = ("subject_id", "group", "entity_id", "subject", "patient_id")


def group_column(df: DataFrame) -> str | None:
    """The entity column that keeps related sequences in one fold, if there is one."""
    return next((c for c in GROUP_NAMES if c in df.columns), None)


def seeded_hash(seed: int, *cols: str) -> Column:
    return F.xxhash64(*[F.col(c) for c in cols], F.lit(seed))


def _shuffled(df: DataFrame, keys: Sequence[str], id_col: str, seed: int | None, total: str | None = None):
    """Position inside the keys, in seeded hash order, or in id order without a seed."""
    if seed is None:
        return with_position(df, keys, [id_col], "__p", total)
    hashed = df.withColumn("__hash", seeded_hash(seed, id_col))
    return with_position(hashed, keys, ["__hash", id_col], "__p", total).drop("__hash")


def k_fold(df: DataFrame, k: int, id_col: str = "sequence_id", seed: int | None = 42) -> DataFrame:
    out = _shuffled(df.select(id_col), [], id_col, seed)
    return out.select(id_col, (F.col("__p") % k).cast("int").alias("fold"))


def stratified_k_fold(
    df: DataFrame, k: int, target: str = "target", id_col: str = "sequence_id", seed: int | None = 42
) -> DataFrame:
    """Every class is dealt to the folds in turn, each class where the one before it stopped."""
    out = _shuffled(df.select(id_col, target), [target], id_col, seed)
    sizes = df.groupBy(F.col(target).alias("__class")).agg(F.count(F.lit(1)).alias("__n"))
    # One row per class: the running offset spreads the remainders of the classes.
    before = Window.orderBy("__class").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__shift", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    # Rows without a target are a class of their own.
    out = out.join(sizes, F.col(target).eqNullSafe(F.col("__class")))
    return out.select(id_col, ((F.col("__p") + F.col("__shift")) % k).cast("int").alias("fold"))


def repeated_stratified_k_fold(
    df: DataFrame, k: int, seeds: Sequence[int], target: str = "target", id_col: str = "sequence_id"
) -> DataFrame:
    out = None
    for repeat, seed in enumerate(seeds):
        part = stratified_k_fold(df, k, target, id_col, seed).withColumn("repeat", F.lit(repeat))
        out = part if out is None else out.unionByName(part)
    return out


def group_k_fold(
    df: DataFrame,
    k: int,
    group: str,
    id_col: str = "sequence_id",
    seed: int | None = 42,
    target: str | None = None,
    rounds: int = 50,
) -> DataFrame:
    """All sequences of a group share a fold. Groups are put in order of their commonest class (with `target`) and
    falling size and dealt back and forth over the folds, so fold sizes and class shares stay even; the same rule for
    any number of groups. k shrinks to the number of groups; a single group falls back to single rows. Rows without a
    group are a group of their own.

    With `target` the folds are then balanced on all classes, in at most `rounds` rounds: every group proposes the fold to
    which moving it takes most off the squared deviations of the class shares, and the best MOVES proposals are made one
    after the other as far as they still do. A round sends the
    driver the class counts of the folds and those proposals only."""
    n_groups = df.select(group).distinct().limit(k + 1).count()
    if n_groups < 2:
        return stratified_k_fold(df, k, target, id_col, seed) if target else k_fold(df, k, id_col, seed)
    k = min(k, n_groups)
    by = [F.col(group).alias("__group"), *([F.col(target).alias("__class")] if target else [])]
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    common = F.max_by("__class", F.struct("__n", "__class")) if target else F.lit(0)
    sizes = counts.groupBy("__group").agg(common.alias("__class"), (-F.sum("__n")).alias("__size"))
    sizes = sizes.withColumn("__hash", seeded_hash(seed or 0, "__group"))
    ranked = with_position(sizes, [], [*(["__class"] if target else []), "__size", "__hash"], "__p")
    turn = F.col("__p") % (2 * k)
    folds = ranked.select("__group", F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int").alias("fold"))
    if target:
        folds = _balanced(counts, folds, k, rounds)
    return df.select(id_col, group).join(folds, F.col(group).eqNullSafe(F.col("__group"))).select(id_col, "fold")


def _balanced(counts: DataFrame, folds: DataFrame, k: int, rounds: int) -> DataFrame:
    """(__group, fold) with the groups moved between folds until the class shares no longer come nearer to each other."""
    spark = counts.sparkSession
    classes = counts.groupBy("__class").agg(F.sum("__n").alias("n"))
    require_small(classes, "the list of classes")
    totals = {r["__class"]: r["n"] for r in classes.collect()}
    names = sorted(totals, key=lambda c: (c is None, c))
    if len(names) < 2:
        return folds
    place = spark.createDataFrame([(i, c) for i, c in enumerate(names)], T.StructType([T.StructField("__i", T.IntegerType()), counts.schema["__class"]]))
    placed = counts.join(F.broadcast(place.withColumnRenamed("__class", "__c")), F.col("__class").eqNullSafe(F.col("__c")))
    # A group's classes as places and counts.
    vectors = placed.groupBy("__group").agg(F.collect_list(F.struct("__i", "__n")).alias("v"))
    vectors = vectors.select(F.col("__group").alias("__g"), F.col("v")["__i"].alias("at"), F.col("v")["__n"].alias("n"))
    groups = cut_lineage(folds.join(vectors, F.col("__group").eqNullSafe(F.col("__g"))).select("__group", "fold", "at", "n"))
    weight = np.array([1.0 / totals[c] for c in names])
    moved: dict = {}
    key = counts.schema["__group"]

    cells = np.zeros((k, len(names)))
    for r in groups.select("fold", F.explode(F.arrays_zip("at", "n")).alias("c")).groupBy("fold", "c.at").agg(F.sum("c.n").alias("n")).collect():
        cells[r["fold"], r["at"]] = r["n"]
    for _ in range(rounds):
        share = cells * weight - 1.0 / k
        now = _with_moves(groups, moved, key)
        best = _proposals(now, share, weight).orderBy(F.desc("gain"), F.xxhash64("__group")).limit(MOVES).collect()
        made = _make_moves(best, share, weight)
        if not made:
            break
        # The counts of the folds follow the moves, so that a round passes over the groups once.
        for r in best:
            if r["__group"] in made:
                cells[r["fold"], r["at"]] -= r["n"]
                cells[made[r["__group"]], r["at"]] += r["n"]
        moved.update(made)
    return _with_moves(groups, moved, key).select("__group", "fold")


def _with_moves(groups: DataFrame, moved: dict, key: T.StructField) -> DataFrame:
    """The groups with their folds after the moves, of which there are at most MOVES a round."""
    if not moved:
        return groups
    schema = T.StructType([key, T.StructField("__to", T.IntegerType())])
    table = groups.sparkSession.createDataFrame(list(moved.items()), schema).withColumnRenamed("__group", "__m")
    out = groups.join(F.broadcast(table), F.col("__group").eqNullSafe(F.col("__m")), "left")
    return out.select("__group", F.coalesce("__to", "fold").alias("fold"), "at", "n")


def _gains(share: np.ndarray, weight: np.ndarray, fold: int, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What moving a group takes off the squared deviations, for each fold it may go to."""
    v = n * weight[at]
    gain = 2 * (share[fold, at] * v).sum() - 2 * (share[:, at] * v).sum(1) - 2 * (v * v).sum()
    gain[fold] = 0.0
    return gain


def _proposals(groups: DataFrame, share: np.ndarray, weight: np.ndarray) -> DataFrame:
    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # The classes of all groups of the batch one after the other.
            lengths, fold = pc.list_value_length(batch.column("at")).to_numpy(), batch.column("fold").to_numpy()
            at, n = (batch.column(c).flatten().to_numpy() for c in ("at", "n"))
            each, start, v = np.arange(len(fold)), np.cumsum(lengths) - lengths, n * weight[at]
            to_fold = np.add.reduceat(share[:, at] * v, start, axis=1)
            gain = 2 * to_fold[fold, each] - 2 * to_fold - 2 * np.add.reduceat(v * v, start)
            gain[fold, each] = 0.0
            to = gain.argmax(0)
            kept = np.flatnonzero(gain[to, each] > 1e-12)
            own = batch.take(pa.array(kept))
            more = [pa.array(to[kept].astype(np.int32)), pa.array(gain[to, each][kept])]
            yield pa.RecordBatch.from_arrays([*own.columns, *more], names=[*own.schema.names, "to", "gain"])

    schema = T.StructType([*groups.schema, T.StructField("to", T.IntegerType()), T.StructField("gain", T.DoubleType())])
    return groups.mapInArrow(propose, schema)


def _make_moves(proposals: list, share: np.ndarray, weight: np.ndarray) -> dict:
    """The proposals that still help when those before them have been made; a group may go to another fold by then."""
    made = {}
    for r in proposals:
        at, n = np.array(r["at"]), np.array(r["n"], float)
        gain = _gains(share, weight, r["fold"], at, n)
        to = int(gain.argmax())
        if gain[to] > 1e-12:
            share[r["fold"], at] -= n * weight[at]
            share[to, at] += n * weight[at]
            made[r["__group"]] = to
    return made


def blocked_folds(
    df: DataFrame, k: int, order: Sequence[str], id_col: str = "sequence_id", target: str | None = None
) -> DataFrame:
    """Contiguous chunks in time order (the first n mod k get one more), per class with `target`."""
    keys = [target] if target else []
    rows = with_position(df.select(*dict.fromkeys([id_col, *keys, *order])), keys, order, "__p", "__n")
    return rows.select(id_col, ntile_of(F.col("__p"), F.col("__n"), k).cast("int").alias("fold"))


def purged_blocked_splits(
    df: DataFrame, k: int, purge: int, order: Sequence[str], id_col: str = "sequence_id"
) -> DataFrame:
    """(id, fold, role): test blocks of floor(n / k) rows, the last takes the rest; train rows are
    those more than `purge` positions away from the test block."""
    rows = with_position(df.select(*dict.fromkeys([id_col, *order])), [], order, "__p", "__n")
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    size = F.floor(F.col("__n") / k)
    start = F.col("fold") * size
    end = F.when(F.col("fold") == k - 1, F.col("__n")).otherwise(start + size)
    p = F.col("__p")
    role = (
        F.when((p >= start) & (p < end), "test")
        .when((p < start - purge) | (p >= end + purge), "train")
    )
    return rows.select(id_col, "fold", role.alias("role")).filter("role IS NOT NULL")


def expanding_splits(df: DataFrame, k: int, order: Sequence[str], id_col: str = "sequence_id") -> DataFrame:
    """Time-series split: fold i tests the i-th of the last k blocks of n // (k + 1) rows and trains
    on everything before it."""
    rows = with_position(df.select(*dict.fromkeys([id_col, *order])), [], order, "__p", "__n")
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    size = F.floor(F.col("__n") / (k + 1))
    start = F.col("__n") - (k - F.col("fold")) * size
    role = F.when(F.col("__p") < start, "train").when(F.col("__p") < start + size, "test")
    return rows.select(id_col, "fold", role.alias("role")).filter("role IS NOT NULL")


def holdout(
    df: DataFrame,
    test_size: float,
    id_col: str = "sequence_id",
    seed: int | None = 42,
    target: str | None = None,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """(id, role). A `split` column wins; with `order` the last rows in time are the test part;
    otherwise rows are drawn by seeded hash, per class with `target`."""
    if "split" in df.columns:
        return df.select(id_col, F.col("split").alias("role"))
    if order is not None:
        rows = with_position(df.select(*dict.fromkeys([id_col, *order])), [], order, "__p", "__n")
    else:
        keys = [target] if target else []
        rows = _shuffled(df.select(id_col, *keys), keys, id_col, seed, "__n")
    train = F.floor(F.col("__n") * F.lit(1.0 - test_size))
    return rows.select(id_col, F.when(F.col("__p") < train, "train").otherwise("test").alias("role"))


def fold_roles(folds: DataFrame, k: int, id_col: str = "sequence_id") -> DataFrame:
    """(id, fold, role) from one fold per sequence: test in its own fold, train in the others."""
    each = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    rows = folds.withColumnRenamed("fold", "__own").withColumn("fold", each)
    return rows.select(
        id_col, "fold", F.when(F.col("fold") == F.col("__own"), "test").otherwise("train").alias("role")
    )


def fold_balance(roles: DataFrame, targets: DataFrame, id_col: str = "sequence_id", target: str = "target") -> DataFrame:
    """Rows, positives and negatives per (fold, role), and whether only one class is present."""
    joined = roles.join(targets.select(id_col, target), id_col)
    out = joined.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(target) > 0).alias("positives"),
        F.count_if(F.col(target) <= 0).alias("negatives"),
    )
    return out.withColumn("single_class", (F.col("positives") == 0) | (F.col("negatives") == 0))


def sample_rows(df: DataFrame, n: int, id_col: str = "sequence_id", seed: int = 42) -> DataFrame:
    """n rows without replacement, by seeded hash order."""
    return df.withColumn("__h", seeded_hash(seed, id_col)).orderBy("__h", id_col).limit(n).drop("__h")
