"""L1-penalised models by coordinate descent on cross products that Spark sums over the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Features whose table of cross products the driver holds (32 MB), and tasks that add up the parts of it first.
MAX_FEATURES, ADDERS = 2048, 16
# Passes over the rows for a class target at most, and the part of the penalty by which a gradient may miss its condition: with
# two classes, and with several, whose coefficients are found class by class and come nearer more slowly.
PASSES, MISS, MISS_SEVERAL = 100, 1e-6, 1e-3


@dataclass
class L1Model:
    """Coefficients (a row for each class, one for two classes or a real target) of standardised features, and by how much
    the conditions of the optimum are missed, as a part of the penalty."""

    coefficients: np.ndarray
    missed: float


def _summed(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows (x array, label) of what `part` makes of a batch. Tasks add up their batches, a few tasks the sums of
    all others, and one those: whatever the number of rows, a task holds a few tables and the driver gets one."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                own = part(x, batch.column("label").to_numpy())
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column("sums"):
                own = np.frombuffer(data.as_py())
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = rows.mapInArrow(first, "sums binary").repartition(ADDERS).mapInArrow(added, "sums binary")
    found = parts.repartition(1).mapInArrow(added, "sums binary").first()
    return np.frombuffer(found["sums"]) if found else np.zeros(0)


def descend(gram: np.ndarray, pull: np.ndarray, penalty: np.ndarray, start: np.ndarray, rounds: int = 10_000, close: float = 1e-12) -> np.ndarray:
    """The minimum of b'Gb / 2 - c'b + sum(penalty |b|), coordinate by coordinate."""
    b = start.copy()
    rest = pull - gram @ b
    scale = max(float(np.abs(pull).max(initial=0.0)), 1e-300)
    for _ in range(rounds):
        most = 0.0
        for j in np.flatnonzero(np.diag(gram) > 0):
            old = b[j]
            z = rest[j] + gram[j, j] * old
            new = np.sign(z) * max(abs(z) - penalty[j], 0.0) / gram[j, j]
            if new != old:
                rest -= gram[:, j] * (new - old)
                b[j] = new
                most = max(most, abs(new - old) * gram[j, j])
        if most <= close * scale:
            break
    return b


def _missed(gradient: np.ndarray, b: np.ndarray, penalty: np.ndarray) -> float:
    """How far the gradient is from the penalty against each coefficient that is not zero, and beyond it for the others."""
    off = np.where(b != 0, np.abs(gradient + penalty * np.sign(b)), np.maximum(np.abs(gradient) - penalty, 0.0))
    return float(off.max(initial=0.0))


def fit_l1(rows: DataFrame, task_type: str, C: float = 1.0, alpha: float = 0.01) -> L1Model:
    """(features vector, label) -> the model. A real target minimises half the mean squared error plus alpha times the
    absolute coefficients; classes 0, 1, ... minimise the absolute coefficients plus C times the sum of the log losses. The
    intercept is free. Values are centred and scaled by their deviation (0: by 1), as sums of the rows, not of copies.

    A real target takes two passes over the rows: means, then all cross products. Classes take one for each step: weighted
    cross products around the last coefficients, on which the next ones are found; a step that does not help is halved."""
    rows = rows.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))
    size = rows.select(F.size("x")).first()[0]
    sums = _summed(rows, lambda x, y: np.concatenate(([len(y), y.sum(), y.max()], x.sum(0))))
    n, mean = sums[0], sums[3:] / sums[0]
    if task_type == "regression":
        middle = sums[1] / n

        def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            d = np.column_stack((x - mean, y - middle))
            return (d.T @ d).ravel()

        whole = _summed(rows, products).reshape(size + 1, -1) / n
        sd = np.sqrt(np.diag(whole)[:size])
        scale = 1 / np.where(sd > 0, sd, 1.0)
        gram, pull = whole[:size, :size] * np.multiply.outer(scale, scale), whole[:size, size] * scale
        penalty = np.full(size, alpha)
        b = descend(gram, pull, penalty, np.zeros(size))
        return L1Model(b[None], _missed(gram @ b - pull, b, penalty) / alpha if alpha else 0.0)

    sd = np.sqrt(np.maximum(_summed(rows, lambda x, y: ((x - mean) ** 2).sum(0)) / n, 0.0))
    scale = 1 / np.where(sd > 0, sd, 1.0)
    classes = int(rows.agg(F.max("label")).first()[0]) + 1
    models = 1 if classes == 2 else classes
    wide = size + 1
    penalty = np.append(np.full(size, 1.0 / C), 0.0)

    def step(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, gradients and curvatures at the coefficients, over all rows."""

        def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = np.column_stack(((x - mean) * scale, np.ones(len(y))))
            margin = z @ b.T
            margin = np.column_stack((np.zeros(len(y)), margin)) if models == 1 else margin
            top = margin.max(1, keepdims=True)
            share = np.exp(margin - top)
            total = share.sum(1, keepdims=True)
            loss = (np.log(total[:, 0]) + top[:, 0] - margin[np.arange(len(y)), y.astype(int)]).sum()
            share /= total
            out = [np.array([loss])]
            for k in range(models):
                own, hit = (share[:, 1], y == 1) if models == 1 else (share[:, k], y == k)
                out += [z.T @ (own - hit), (z.T @ (z * (own * (1 - own))[:, None])).ravel()]
            return np.concatenate(out)

        found = _summed(rows, part)
        each = found[1:].reshape(models, wide + wide * wide)
        return float(found[0]), each[:, :wide], each[:, wide:].reshape(models, wide, wide)

    b = np.zeros((models, wide))
    loss, gradient, curve = step(b)
    missed = np.inf
    for _ in range(PASSES):
        missed = max(_missed(g, own, penalty) for g, own in zip(gradient, b)) * C
        if missed <= (MISS if models == 1 else MISS_SEVERAL):
            break
        # A little more curvature keeps flat directions bounded.
        aim = np.stack([
            descend(h + 1e-9 * np.eye(wide) * max(np.trace(h), 1e-9), (h + 1e-9 * np.eye(wide) * max(np.trace(h), 1e-9)) @ own - g, penalty, own, 500)
            for g, h, own in zip(gradient, curve, b)
        ])
        now, pace = loss + (penalty * np.abs(b)).sum(), 1.0
        while True:
            trial = b + pace * (aim - b)
            found = step(trial)
            if found[0] + (penalty * np.abs(trial)).sum() <= now or pace < 1e-4:
                break
            pace /= 2
        if pace < 1e-4:
            break
        b, (loss, gradient, curve) = trial, found
        # A coefficient on its way to zero arrives.
        b[np.abs(b) < 1e-12] = 0.0
    return L1Model(b[:, :size], missed)
