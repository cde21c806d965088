"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in NumPy, with a threshold per language."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import packed, quoted, unpacked

# Labelled rows that the classifier is fitted on, at most (the documented bound), and how it is fitted.
TRAIN_ROWS = 4096
BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 16, 16, 16, (1, 2, 3)
EPOCHS, LEAST_STEPS, BATCH, RATE, SEED = 8, 400, 32, 0.08, 7
# Words start near zero, so that unseen ones say next to nothing; this share is left out at random in training.
START, LEFT_OUT = 0.002, 0.5
# Letters at a word's start that are features beside the whole word, so that unseen forms share what is known.
PREFIXES = (4, 5, 6)
# Toxic rows that a language needs in the calibration part for a threshold of its own.
CALIBRATION_LEAST = 8
# Words a worker remembers, and words convolved at a time.
REMEMBERED, STRETCH = 1 << 18, 1 << 15

WORD = re.compile(r"[^\W\d_]+")
# Empty rows after each document, so that no window reaches into the next.
PAD = max(WIDTHS)


def word_features(word: str) -> list[int]:
    """Rows of the embedding table: of the word and of its beginnings."""
    parts = [word, *("<" + word[:n] for n in PREFIXES)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


@dataclass
class ToxicityModel:
    table: np.ndarray
    filters: list[np.ndarray]  # by width: (width, SIZE, FILTERS)
    offsets: np.ndarray
    output: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def pooled(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Largest value of every filter in each document of so many words, over the windows that begin in it. x has PAD
        empty rows after each document and at the end."""
        starts = np.cumsum(lengths + PAD) - lengths - PAD
        bounds = np.stack((starts, starts + np.maximum(lengths, 1)), 1).ravel()
        n = len(x) - PAD
        y = x @ np.concatenate([f[j] for f in self.filters for j in range(len(f))], axis=1)
        found, at = [], 0
        for f in self.filters:
            h = y[:n, at : at + FILTERS].copy()
            for j in range(1, len(f)):
                h += y[j : j + n, at + j * FILTERS : at + (j + 1) * FILTERS]
            found.append(np.maximum.reduceat(h, bounds, axis=0)[::2])
            at += len(f) * FILTERS
        return np.concatenate(found, axis=1)

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.offsets, 0) @ self.output + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Scorer:
    """Scores texts with a model; a word's embedding is summed once and remembered."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.vectors = np.zeros((1024, SIZE), np.float32)

    def _number(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            n = self.known[word] = len(self.known) + 1  # 0 stays the empty row
            if n >= len(self.vectors):
                self.vectors = np.concatenate((self.vectors, np.zeros_like(self.vectors)))
            self.vectors[n] = self.model.table[word_features(word)].sum(0)
        return n

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.forget()
        best = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        held: list[np.ndarray] = []
        owners: list[int] = []
        size = 0
        empty = np.zeros(PAD, np.int64)

        def flush() -> None:
            nonlocal held, owners, size
            if owners:
                lengths = np.array([len(h) for h in held])
                numbers = np.concatenate([a for h in held for a in (h, empty)] + [empty])
                pooled = self.model.pooled(self.vectors[numbers], lengths)
                np.maximum.at(best, np.array(owners), pooled)
            held, owners, size = [], [], 0

        for i, text in enumerate(texts):
            words = WORD.findall((text or "").lower())
            numbers = np.fromiter(map(self._number, words), np.int64, len(words))
            # A long text goes in stretches that overlap by a filter's width.
            for at in range(0, max(1, len(numbers)), STRETCH):
                held.append(numbers[at : at + STRETCH + PAD])
                owners.append(i)
                size += len(held[-1])
                if size >= STRETCH:
                    flush()
        flush()
        return self.model.probability(best).astype(float)


def fit(texts: Iterable[str], toxic: np.ndarray, langs: list[str]) -> ToxicityModel:
    """Train on four fifths of the rows, set thresholds on the rest. The same rows give the same model."""
    rng = np.random.default_rng(SEED)
    features: dict[str, int] = {}
    rows, calibrating = [], []
    for i, t in enumerate(texts):
        rows.append(np.fromiter((features.setdefault(w, len(features)) for w in WORD.findall((t or "").lower())), np.int32))
        if i % 5 == 0:
            calibrating.append(t)
    parts = np.empty((max(1, len(features)), 1 + len(PREFIXES)), np.int32)
    for i, w in enumerate(features):
        parts[i] = word_features(w)
    features.clear()
    kept = np.arange(0, len(rows), 5)
    model = ToxicityModel(
        (rng.standard_normal((BUCKETS, SIZE)) * START).astype(np.float32),
        [(rng.standard_normal((w, SIZE, FILTERS)) * (1 / np.sqrt(w * SIZE))).astype(np.float32) for w in WIDTHS],
        np.full(FILTERS * len(WIDTHS), 0.1, np.float32),
        (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.1).astype(np.float32),
        float(np.log((toxic.mean() + 1e-3) / (1.001 - toxic.mean()))) if len(toxic) else 0.0,
    )
    if not len(toxic):
        return model
    calibration = np.zeros(len(toxic), bool)
    calibration[kept] = True
    training = np.flatnonzero(~calibration) if (~calibration).any() else np.arange(len(toxic))
    squares = [np.full(p.shape, 1e-6, np.float32) for p in (model.table, *model.filters, model.offsets, model.output)]
    bias_square = 1e-6

    def step(p: np.ndarray, square: np.ndarray, g: np.ndarray, at=slice(None)) -> None:
        square[at] += g * g
        p[at] -= RATE * g / np.sqrt(square[at])

    steps = -(-len(training) // BATCH)
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // steps))):
        order = rng.permutation(training)
        for b in range(0, len(order), BATCH):
            some = order[b : b + BATCH]
            lengths = np.array([len(rows[i]) + PAD for i in some])
            starts = np.cumsum(lengths) - lengths
            words = np.full(int(lengths.sum()) + PAD, -1, np.int64)
            for i, at in zip(some, starts):
                words[at : at + len(rows[i])] = rows[i]
            words[rng.random(len(words)) < LEFT_OUT] = -1
            there = np.flatnonzero(words >= 0)
            x = np.zeros((len(words), SIZE), np.float32)
            x[there] = model.table[parts[words[there]]].sum(1)
            # Where each filter is largest in each document.
            n, y = len(x) - PAD, x @ np.concatenate([f[j] for f in model.filters for j in range(len(f))], axis=1)
            tops, places, at = [], [], 0
            for f in model.filters:
                h = y[:n, at : at + FILTERS].copy()
                for j in range(1, len(f)):
                    h += y[j : j + n, at + j * FILTERS : at + (j + 1) * FILTERS]
                at += len(f) * FILTERS
                place = np.stack([h[s : s + max(k - PAD, 1)].argmax(0) + s for s, k in zip(starts, lengths)])
                places.append(place)
                tops.append(np.take_along_axis(h, place, 0))
            pooled = np.concatenate(tops, axis=1)
            hidden = np.maximum(pooled + model.offsets, 0)
            error = (model.probability(pooled) - toxic[some]).astype(np.float32) / len(some)
            back = np.outer(error, model.output) * (hidden > 0)
            dx = np.zeros_like(x)
            for k, f in enumerate(model.filters):
                own = back[:, k * FILTERS : (k + 1) * FILTERS]
                grad = np.zeros_like(f)
                for j in range(len(f)):
                    seen = x[places[k] + j]  # document, filter, embedding
                    grad[j] = np.einsum("df,dfe->ef", own, seen)
                    np.add.at(dx, places[k] + j, own[:, :, None] * f[j].T[None])
                step(f, squares[1 + k], grad)
            step(model.offsets, squares[-2], back.sum(0))
            step(model.output, squares[-1], hidden.T @ error)
            bias_square += float(error.sum()) ** 2
            model.bias -= RATE * float(error.sum()) / np.sqrt(bias_square)
            touched = there[np.abs(dx[there]).sum(1) > 0]
            if len(touched):
                into, which = np.unique(parts[words[touched]], return_inverse=True)
                grad = np.zeros((len(into), SIZE), np.float32)
                np.add.at(grad, which.reshape(len(touched), -1), dx[touched][:, None, :])
                step(model.table, squares[0], grad, into)

    scorer = Scorer(model)
    scores = scorer.scores(calibrating)
    model.threshold = _threshold(scores, toxic[kept])
    names = np.array([langs[i] for i in kept])
    for lang in sorted(set(names.tolist())):
        own = names == lang
        if toxic[kept][own].sum() >= CALIBRATION_LEAST:
            model.thresholds[lang] = _threshold(scores[own], toxic[kept][own])
    return model


def _threshold(scores: np.ndarray, toxic: np.ndarray) -> float:
    """The cut with the best F1, in the middle of its gap and nearest to a half of equals; a half if nothing is toxic."""
    if not toxic.any():
        return 0.5
    values = np.unique(scores)
    cuts = np.append((values[:-1] + values[1:]) / 2, [0.5])
    best = max(cuts.tolist(), key=lambda c: (round(_f1(scores >= c, toxic), 9), -abs(c - 0.5)))
    return float(best)


def _f1(said: np.ndarray, toxic: np.ndarray) -> float:
    right = float((said & (toxic > 0)).sum())
    return 2 * right / max(1.0, float(said.sum() + toxic.sum()))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train_toxicity(
    docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS, text: str = "text", doc_id: str = "doc_id", lang: str = "lang"
) -> ToxicityModel:
    """Fit on at most `rows` labelled documents outside the held-out fold, the first by a hash of the id. Null labels do
    not count; of several labels of an id the highest holds, of several rows of an id the least text."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    said = docs.select(quoted(doc_id).alias("_id"), quoted(text).alias("_text"), quoted(lang).alias("_lang"))
    # At most `rows` ids: a size that is known.
    found = said.join(F.broadcast(known), "_id").groupBy("_id", "_toxic").agg(F.min(F.struct("_text", "_lang")).alias("_row"))
    found = found.select("_id", "_toxic", "_row._text", "_row._lang").toArrow()
    ids, toxic = found.column(0).to_pylist(), found.column(1).to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), ids[i]))
    texts, langs = found.column(2), found.column(3).to_pylist()
    said = (texts[i].as_py() or "" for i in order)  # one at a time: the driver keeps word numbers, not texts
    return fit(said, np.array([float(toxic[i] > 0) for i in order]), [langs[i] or "" for i in order])


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """Every row with score (0 to 1), predicted (1 from a score of 0.5), threshold (of the row's language) and rejected
    (the score reaches the threshold). The score is a function of the text alone; the language only picks the threshold.

    Null, empty and wordless texts get the score of an empty document; whole texts are scored, whatever their length; a
    null or unknown language has the common threshold; repeated rows are scored each; an empty table gives an empty
    result; columns named as a result's are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            found = [scorer.scores(texts.iloc[at : at + 512].tolist()) for at in range(0, len(texts), 512)]
            yield pd.Series(np.concatenate(found) if found else np.empty(0), dtype="float64")

    names = docs.columns
    cut: Column = F.lit(float(model.threshold))
    for name, value in sorted(model.thresholds.items()):
        cut = F.when(F.coalesce(quoted(lang), F.lit("")) == name, F.lit(float(value))).otherwise(cut)
    rows = docs.select(packed(docs), scored(quoted(text)).alias("_score"), cut.alias("_cut"))
    return unpacked(
        rows,
        names,
        {
            "score": F.col("_score"),
            "predicted": (F.col("_score") >= 0.5).cast("int"),
            "threshold": F.col("_cut"),
            "rejected": F.col("_score") >= F.col("_cut"),
        },
    )
