"""Benchmark decontamination by latent semantic retrieval: TF-IDF passages, a randomised SVD, cosine candidates, then
longest common subsequences and answer checks."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.byte_words import hashed_words, words_of
from tidemark.llm.common import ROW, packed, quoted, unpacked
from tidemark.session import cut_lineage

# Words from one passage to the next; a passage has twice as many. Items are searched in passages of about their length: up
# to so many words in those of the first stride, and so on; all others in those of the last.
STRIDES, LENGTHS = (6, 12, 24), (14, 30)
STRIDE = STRIDES[-1]
# Rows of the corpus part and of the benchmark part of the sketch, and dimensions kept.
CORPUS_ROWS, BENCHMARK_ROWS, DIMENSIONS = 64, 256, 128
# Terms in more than this share of the passages weigh nothing (save in items that have few others); passages with fewer weighing terms are not searched.
COMMON, LEAST_TERMS = 0.1, 3
# Cosine of a candidate; share of an item that its longest common subsequence has to cover, alone or with its answer.
COSINE, VERBATIM, PARAPHRASE, ANSWER = 0.6, 0.8, 0.6, 0.8
# What is broadcast at a time: benchmark items and terms (about 512 bytes each); a larger benchmark is searched in parts.
MAX_ITEMS, MAX_TERMS = 100_000, 100_000

# Characters worked on at a time.
STRETCH = 1 << 20

SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def answer_of(text: str) -> list[str]:
    """Words of the last sentence, or of the last ones if that is shorter than three words."""
    words: list[str] = []
    for sentence in reversed(SENTENCE.split(text)):
        words = words_of(sentence) + words
        if len(words) >= 3:
            break
    return words


def masks(terms: list[int]) -> tuple[dict[int, int], int]:
    """For each term the bits of its places; and how many places there are."""
    found: dict[int, int] = {}
    for i, t in enumerate(terms):
        found[t] = found.get(t, 0) | 1 << i
    return found, len(terms)


def common_subsequence(item: tuple[dict[int, int], int], region: list[int], least: float = 0.0) -> float:
    """Length of the longest common subsequence as a share of the item; a bit stands for a place of the item. 0 if the
    item's words in the region, in whatever order, are less than `least` of it."""
    places, n = item
    if not n:
        return 0.0
    shared = [places[t] for t in region if t in places]
    there = 0
    for m in shared:
        there |= m
    if there.bit_count() < least * n:
        return 0.0
    full = (1 << n) - 1
    left = full
    for m in shared:
        u = left & m
        left = ((left + u) | (left - u)) & full
    return 1 - left.bit_count() / n


@dataclass
class Benchmark:
    terms: int
    hashes: np.ndarray  # of the terms, sorted
    numbers: np.ndarray  # of the terms in that order
    item_ids: list[int]
    items: list[tuple[dict[int, int], int]]
    answers: list[tuple[dict[int, int], int]]
    counts: list[np.ndarray]  # terms of each item, repeats included

    @classmethod
    def of(cls, rows: list[tuple]) -> Benchmark:
        """From (item id, text), all different."""
        terms: dict[str, int] = {}
        for _, t in rows:
            for w in words_of(t):
                terms.setdefault(w, len(terms))
        numbers = [[terms[w] for w in words_of(t)] for _, t in rows]
        answers = [[terms[w] for w in answer_of(t)] for _, t in rows]
        hashes, _ = hashed_words(list(terms))
        order = np.argsort(hashes)
        return cls(len(terms), hashes[order], order, [r[0] for r in rows], [masks(n) for n in numbers], [masks(a) for a in answers], [np.array(n) for n in numbers])

    @classmethod
    def parts(cls, benchmark: DataFrame, text: str, item_id: str) -> Iterator[Benchmark]:
        """The benchmark in parts of at most MAX_ITEMS items and MAX_TERMS terms (one item with more is a part of its own);
        at least one, which may be empty."""
        items = benchmark.select(quoted(item_id).alias("id"), quoted(text).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
        # By hash, so parts are about as large as each other.
        parts = max(1, -(-2 * items.count() // MAX_ITEMS) if items.limit(MAX_ITEMS + 1).count() > MAX_ITEMS else 1)
        for part in range(parts):
            own = items.where(F.pmod(F.xxhash64("id", "t"), F.lit(parts)) == part).distinct().collect() if parts > 1 else items.collect()
            waiting = [sorted({(r[0], r[1]) for r in own if words_of(r[1])})]
            while waiting:
                rows = waiting.pop()
                if len(rows) > 1 and len({w for _, t in rows for w in words_of(t)}) > MAX_TERMS:
                    waiting += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
                elif rows or parts == 1:
                    yield cls.of(rows)

    def stretches(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Texts by the stretch: the first one's place, the terms of all their words (-1: not in the benchmark) and the
        number of words of each."""
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (size < STRETCH or end == at):
                size += len(texts[end] or "")
                end += 1
            hashes, counts = hashed_words(texts[at:end])
            if len(self.hashes):
                place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
                yield at, np.where(self.hashes[place] == hashes, self.numbers[place], -1), counts
            at = end


def _blocks(own: np.ndarray, counts: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts one after the other: the block of every word, counted through, the text of every block, and whether a
    passage begins there. Each text has one more block than its words fill, so that passages end with it."""
    blocks = (counts + stride - 1) // stride + 1
    text = np.repeat(np.arange(len(counts)), counts)
    starts, first = np.cumsum(counts) - counts, np.cumsum(blocks) - blocks
    block = first[text] + (np.arange(len(own)) - starts[text]) // stride
    begins = np.ones(int(blocks.sum()), bool)
    begins[first + blocks - 1] = False
    return block, np.repeat(np.arange(len(counts)), blocks), begins


def _passage_statistics(docs: DataFrame, benchmark: Benchmark, text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Over all passages of the corpus: passages with each term, the sketch (term by row) and the number of passages.

    The sketch is the random side of the SVD: every passage is added with a random sign to one of CORPUS_ROWS rows, so
    that the rows span what the passages span. Tasks sum their own part; Spark sums the parts by term."""
    known = docs.sparkSession.sparkContext.broadcast(benchmark)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark, passages = known.value, 0
        n = max(1, benchmark.terms)
        seen, sketch = np.zeros(n, np.int64), np.zeros(n * CORPUS_ROWS, np.float32)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for first, own, counts in benchmark.stretches(texts):
                block, text, begins = _blocks(own, counts)
                passages += int(begins.sum())
                drawn = np.array([zlib.crc32((t or "").encode("utf-8", "surrogatepass")) for t in texts[first : first + len(counts)]], np.uint64)
                place = np.arange(len(text), dtype=np.uint64)
                mixed = (drawn[text] * np.uint64(0x9E3779B1) + place * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(20)
                row, sign = (mixed % np.uint64(CORPUS_ROWS)).astype(np.int64), np.where(mixed >> np.uint64(30) & np.uint64(1), 1, -1)
                at = np.flatnonzero(own >= 0)
                np.add.at(sketch, own[at] * CORPUS_ROWS + row[block[at]], sign[block[at]].astype(np.float32))
                seen += np.bincount(np.unique(block[at] * n + own[at]) % n, minlength=n)
        there = np.flatnonzero(seen)
        values = pa.array(sketch.reshape(n, CORPUS_ROWS)[there].ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(there) + 1, dtype=np.int32) * CORPUS_ROWS), values)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(seen[there]), lists], names=["term", "passages", "rows"])
        one = pa.array([[0.0] * CORPUS_ROWS], pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([passages]), one], names=["term", "passages", "rows"])

    parts = docs.select(quoted(text)).mapInArrow(summed, "term long, passages long, rows array<float>")
    parts = parts.groupBy("term").agg(F.sum("passages"), F.array(*[F.sum(F.col("rows")[i]) for i in range(CORPUS_ROWS)]))
    n = max(1, benchmark.terms)
    seen, sketch, passages = np.zeros(n, np.int64), np.zeros((n, CORPUS_ROWS)), 0
    for term, count, rows in parts.collect():
        if term < 0:
            passages = count
        else:
            seen[term], sketch[term] = count, rows
    return seen, sketch, passages


@dataclass
class LatentSpace:
    weights: np.ndarray  # of terms; 0: common
    directions: np.ndarray  # term by dimension, times the weight
    items: np.ndarray  # unit vectors of the items


def latent_space(benchmark: Benchmark, seen: np.ndarray, sketch: np.ndarray, passages: int) -> LatentSpace:
    """Directions of the randomised SVD of the TF-IDF passages of corpus and benchmark. Scaling the sketch's columns by the
    inverse frequencies gives the sketch of the weighted passages, so one pass over the corpus serves both."""
    weights = np.log1p(passages / (1 + seen))
    common = seen > COMMON * passages
    for own in benchmark.counts:
        # An item of common words only keeps their weights, or it could not be found.
        different = np.unique(own)
        if (~common[different]).sum() < max(LEAST_TERMS, len(different) / 4):
            common[different] = False
    weights[common] = 0
    if not passages:
        weights[:] = 1
    rng = np.random.default_rng(3)
    n = len(weights)
    vectors = np.zeros((min(len(benchmark.items), BENCHMARK_ROWS), n))
    for i, own in enumerate(benchmark.counts):
        v = np.bincount(own, minlength=n) * weights
        size = np.linalg.norm(v)
        if size:
            vectors[i % BENCHMARK_ROWS] += rng.choice([-1, 1]) * v / size
    corpus = (sketch * weights[:, None]).T
    both = [2 * vectors / max(np.linalg.norm(vectors), 1e-9), corpus / max(np.linalg.norm(corpus), 1e-9)]
    _, strength, directions = np.linalg.svd(np.concatenate(both), full_matrices=False)
    directions = directions[: min(DIMENSIONS, int((strength > 1e-9).sum()))].T * weights[:, None]
    items = np.stack([directions[own].sum(0) for own in benchmark.counts]) if benchmark.counts else np.zeros((0, directions.shape[1]))
    items /= np.maximum(np.linalg.norm(items, axis=1, keepdims=True), 1e-9)
    return LatentSpace(weights, directions.astype(np.float32), items.astype(np.float32))


def matches_of(texts: list[str | None], benchmark: Benchmark, space: LatentSpace) -> list[list[dict]]:
    """The items found in each text."""
    found: list[dict[int, dict]] = [{} for _ in texts]
    scales = np.searchsorted(LENGTHS, [len(c) for c in benchmark.counts])
    members = [(stride, np.flatnonzero(scales == i)) for i, stride in enumerate(STRIDES)]
    for first, own, counts in benchmark.stretches(texts):
        at = np.flatnonzero(own >= 0)
        at = at[space.weights[own[at]] > 0]
        for stride, items in members:
            if len(at) and len(items):
                _search(found, first, own, counts, at, benchmark, space, stride, items)
    return [[f[i] for i in sorted(f)] for f in found]


def _search(found: list[dict[int, dict]], first: int, own: np.ndarray, counts: np.ndarray, at: np.ndarray, benchmark: Benchmark, space: LatentSpace, stride: int, items: np.ndarray) -> None:
    """Search the passages of one stride for the items that have about their length."""
    block, text, begins = _blocks(own, counts, stride)
    starts = np.cumsum(counts) - counts
    head = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    vectors = space.items[items]
    terms = np.bincount(block[at], minlength=len(text))
    # Stretches of blocks, with the one after them: no matter how many there are, so many vectors are held.
    for a in range(0, len(text), 16_384):
        end = min(len(text), a + 16_384 + 1)
        some = a + np.flatnonzero(begins[a : end - 1] & (terms[a : end - 1] + terms[a + 1 : end] >= LEAST_TERMS))
        if not len(some):
            continue
        here = at[np.searchsorted(block[at], a) : np.searchsorted(block[at], end)]
        blocks = np.zeros((end - a, space.directions.shape[1]), np.float32)
        # The first words of all blocks, then the second ones, ...: no block twice in one addition.
        rank = np.arange(len(here)) - (np.cumsum(terms[a:end]) - terms[a:end])[block[here] - a]
        for turn in np.split(here[np.argsort(rank, kind="stable")], np.cumsum(np.bincount(rank))[:-1]):
            blocks[block[turn] - a] += space.directions[own[turn]]
        for b in range(0, len(some), 4096):
            part = some[b : b + 4096]
            # A passage is a block and the next.
            passages = blocks[part - a] + blocks[part - a + 1]
            passages /= np.maximum(np.linalg.norm(passages, axis=1, keepdims=True), 1e-9)
            for start in range(0, len(items), 4096):
                cosine = passages @ vectors[start : start + 4096].T
                for p, i in np.argwhere(cosine >= COSINE).tolist():
                    doc = int(text[part[p]])
                    words = own[starts[doc] : starts[doc] + counts[doc]]
                    _check(found[first + doc], benchmark, int(items[start + i]), float(cosine[p, i]), words, (int(part[p]) - int(head[doc])) * stride, stride)


def _check(found: dict[int, dict], benchmark: Benchmark, item: int, cosine: float, words: np.ndarray, at: int, stride: int) -> None:
    """Keep a candidate whose subsequences hold; of several passages the best."""
    best = found.get(item)
    if best is not None and best["lcs"] >= 1 and best["answer"] >= 1:
        return
    n = benchmark.items[item][1]
    region = words[max(0, at - n) : at + 2 * stride + n].tolist()
    lcs = common_subsequence(benchmark.items[item], region, PARAPHRASE)
    if lcs < PARAPHRASE:
        return
    answer = common_subsequence(benchmark.answers[item], region)
    if (lcs >= VERBATIM or answer >= ANSWER) and (best is None or (lcs, answer) > (best["lcs"], best["answer"])):
        found[item] = {"item_id": benchmark.item_ids[item], "cosine": cosine, "lcs": lcs, "answer": answer}


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_text: str = "text", item_id: str = "item_id"
) -> DataFrame:
    """Every row with matches: the benchmark items found in the text (item_id, cosine of the best passage, lcs and answer:
    shares of the item and of its answer that a common subsequence covers).

    Texts are cut into overlapping passages: of 12 words for items of up to 14, of 24 for items of up to 30, and of 48 for
    all others. Term frequencies and a random sketch are summed over all passages of 48 words of the corpus; the SVD of
    sketch and benchmark gives a latent space; every passage is searched in it for items of a cosine from COSINE. A
    candidate holds if the longest common subsequence of item and passage, with as many words around it as the item has,
    covers VERBATIM of the item, or PARAPHRASE of it and ANSWER of its answer (its last sentence). Words are lower-cased
    runs of letters and digits. A benchmark of more than MAX_ITEMS items or MAX_TERMS terms is searched part by part, with
    the matches so far written in between.

    Null and empty texts match nothing, nor do items without words or id; equal items and repeated rows are found each;
    empty tables give no matches; whole texts are searched; columns named matches are replaced.
    """
    names = docs.columns
    kind = "array<struct<item_id: long, cosine: double, lcs: double, answer: double>>"
    rows = docs.select(packed(docs), F.array().cast(kind).alias("_matches"))
    for turn, known in enumerate(Benchmark.parts(benchmark, item_text, item_id)):
        space = latent_space(known, *_passage_statistics(docs, known, text))
        found = _matches(docs.sparkSession.sparkContext.broadcast((known, space)), kind)
        if turn:
            rows = cut_lineage(rows)
        rows = rows.select(ROW, F.concat("_matches", found(F.col(ROW).getField(text))).alias("_matches"))
    return unpacked(rows, names, {"matches": F.col("_matches")})


def _matches(shared, kind: str):
    @F.pandas_udf(kind)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(matches_of(texts.tolist(), *shared.value), dtype=object)

    return found
