"""Ranked lexical search: each block's documents are grouped by the mask of an item's terms that they hold, and masks are
evaluated by descending highest score until no other can enter the ranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tidemark.llm.common import quoted
from tidemark.session import cut_lineage

# Bytes of item texts that are broadcast at a time; more items are searched part by part.
PART_BYTES = 8 << 20
# Documents of an item whose scores are worked out at a time.
STEP_DOCS = 64

# Letters, digits and all bytes of other characters stay, A-Z lower-cased; the rest parts terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
RANKED = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
_LAST = np.iinfo(np.int64).max


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text: runs of ASCII letters and digits, A-Z lower-cased, and of any other characters."""
    return (text or b"").translate(_TERM_BYTES).split()


@dataclass
class Items:
    """Items by number: their different terms as numbers into the vocabulary, and how often each occurs in the item."""

    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]
    times: list[np.ndarray]

    @classmethod
    def of(cls, texts: list[list[str]]) -> Items:
        vocabulary: dict[bytes, int] = {}
        terms, times = [], []
        for parts in texts:
            words = [w for t in parts for w in terms_of(t.encode("utf-8", "surrogatepass"))]
            own, n = np.unique(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64), return_counts=True)
            terms.append(own)
            times.append(n)
        return cls(vocabulary, terms, times)


def _as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def _counted(docs: DataFrame, items, text: str, doc_id: str) -> DataFrame:
    """(id, n, terms, tfs) of every document with a term: its length, and the items' terms in it with their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = items.value.vocabulary.get
        for batch in batches:
            n, terms, tfs = [], [], []
            for t in _as_bytes(batch.column("t")):
                words = terms_of(t)
                n.append(len(words))
                own, k = np.unique(np.array([x for x in map(number, words) if x is not None], np.int32), return_counts=True)
                terms.append(own)
                tfs.append(k.astype(np.int32))
            out = pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))],
                names=["id", "n", "terms", "tfs"],
            )
            yield out.filter(pc.greater(out.column("n"), 0))

    rows = docs.select(quoted(doc_id).cast("long").alias("id"), quoted(text).alias("t"))
    return rows.mapInArrow(count, "id long, n long, terms array<int>, tfs array<int>")


def _frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary; counts are summed in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "df"])

    df = np.zeros(size, np.int64)
    for r in counted.mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    return df


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


class Ranking:
    """The highest-scoring documents of one item so far: highest first, ties by id, documents without an id last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.unnamed = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        """What a score must reach to enter: 1 while there is room."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        some = scores >= self.least
        scores, ids, unnamed = (np.concatenate(x) for x in ((self.scores, scores[some]), (self.ids, ids[some]), (self.unnamed, unnamed[some])))
        order = np.lexsort((ids, unnamed, -scores))[: self.k]
        self.scores, self.ids, self.unnamed = scores[order], ids[order], unnamed[order]


class Block:
    """Some documents with what each of their terms is worth, by document and by term."""

    def __init__(self, batch: pa.RecordBatch, mean: tuple[int, int]):
        n_docs, length = mean
        terms, tfs = (batch.column(c) for c in ("terms", "tfs"))
        self.ids = batch.column("id").fill_null(_LAST).to_numpy()
        self.unnamed = batch.column("id").is_null().to_numpy(zero_copy_only=False)
        sizes = terms.value_lengths().to_numpy()
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.term = terms.flatten().to_numpy().astype(np.int64)
        tf = tfs.flatten().to_numpy().astype(np.int64)
        m = 75 + 25 * batch.column("n").to_numpy() * n_docs // length
        doc = np.repeat(np.arange(len(sizes)), sizes)
        self.worth = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
        order = np.argsort(self.term, kind="stable")
        self.by_term, self.doc, self.term_worth = self.term[order], doc[order], self.worth[order]

    def rank(self, ranking: Ranking, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray) -> int:
        """Let the documents of the block into the ranking of an item; the number of documents evaluated. `dense` is a zero
        for each term of the vocabulary, and is left so."""
        starts, ends = (np.searchsorted(self.by_term, terms, side) for side in ("left", "right"))
        masks = np.zeros((len(self.ids), (len(terms) + 63) // 64), np.uint64)
        highest = np.zeros(len(terms), np.int64)
        for j, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            if a < b:
                masks[self.doc[a:b], j // 64] |= np.uint64(1 << j % 64)
                highest[j] = weights[j] * self.term_worth[a:b].max()
        # Documents with one mask become neighbours.
        order = np.lexsort(masks.T)
        ordered = masks[order]
        first = np.flatnonzero(np.concatenate(([True], (ordered[1:] != ordered[:-1]).any(1))))
        bits = np.unpackbits(ordered[first].view(np.uint8), axis=1, bitorder="little", count=len(terms))
        bounds = bits.astype(np.int64) @ highest
        sizes = np.diff(np.append(first, len(order)))
        turn = np.argsort(-bounds, kind="stable")
        bounds, reach, done, at = bounds[turn], np.cumsum(sizes[turn]), 0, 0
        dense[terms] = weights
        while at < len(turn) and bounds[at] >= ranking.least:
            # The next masks, until they hold enough documents for one step.
            end = int(np.searchsorted(reach, done + STEP_DOCS)) + 1
            end = max(at + 1, min(end, int(np.searchsorted(-bounds, -ranking.least, "right"))))
            docs = np.concatenate([order[first[g] : first[g] + sizes[g]] for g in turn[at:end].tolist()])
            ranking.add(self.scores(docs, dense), self.ids[docs], self.unnamed[docs])
            at, done = end, done + len(docs)
        dense[terms] = 0
        return done

    def scores(self, docs: np.ndarray, dense: np.ndarray) -> np.ndarray:
        sizes = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[docs] - (ends - sizes), sizes)
        sums = np.concatenate(([0], np.cumsum(dense[self.term[at]] * self.worth[at])))
        return sums[ends] - sums[ends - sizes]


def _searched(counted: DataFrame, items, weights, mean: tuple[int, int], k: int) -> DataFrame:
    """(item, id, score): the best of every task for every item of the part."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = items.value
        dense = np.zeros(len(asked.vocabulary), np.int64)
        own = [weights.value[t] * n for t, n in zip(asked.terms, asked.times)]
        rankings = [Ranking(k) for _ in own]
        for batch in batches:
            if batch.num_rows:
                block = Block(batch, mean)
                for ranking, terms, w in zip(rankings, asked.terms, own):
                    if len(terms):
                        block.rank(ranking, terms, w, dense)
        item = np.repeat(np.arange(len(rankings)), [len(r.ids) for r in rankings])
        ids, unnamed, scores = (np.concatenate([getattr(r, c) for r in rankings]) for c in ("ids", "unnamed", "scores"))
        columns = [pa.array(item), pa.array(ids, mask=unnamed), pa.array(scores)]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "id", "score"])

    return counted.mapInArrow(search, "item long, id long, score long")


def rank_documents(
    docs: DataFrame, items: DataFrame, *, k: int = 20, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", part_bytes: int = PART_BYTES
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item with a score above 0, equal scores by
    ascending doc_id.

    With N documents that hold a term, L terms in all of them, n terms in a document, df documents that hold a term and tf
    times it occurs, a term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))), a document's length counts as
    m = 75 + 25 n N div L, and the score is the sum over the item's terms, repeats included, of w ((10^9 tf) div (1000 tf + 12 m)).

    Items are broadcast in parts of about `part_bytes` of text. One pass over the documents counts the part's terms and
    writes them as numbers; document frequencies are summed from that table. Each task then takes its documents in blocks,
    sets a bit for each term of an item that a document holds, groups the documents by that mask, and evaluates the masks
    by descending highest score (the block's highest worth of each term summed) until the k-th best score so far is above
    what the next mask can reach. A task returns k rows an item at most.

    Null and empty texts have no term and are no documents for N; repeated rows are documents each; documents without an id
    come last among equal scores; rows of one item id are one item with the terms of all; items without a term have no
    rows; empty tables give an empty result; other columns are left out.
    """
    spark = docs.sparkSession
    asked = items.select(quoted(item_id).alias("item_id"), quoted(item_text).alias("t")).where("t IS NOT NULL")
    parts = max(1, -(-(asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // part_bytes))
    found = []
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).groupBy("item_id").agg(F.collect_list("t").alias("t")).collect()
        if not own:
            continue
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], _numbered(asked))
        listed = Items.of([r["t"] for r in own])
        shared = spark.sparkContext.broadcast(listed)
        counted = cut_lineage(_counted(docs, shared, text, doc_id))
        n_docs, length = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = spark.sparkContext.broadcast(term_weights(_frequencies(counted, len(listed.vocabulary)), n_docs))
        best = _searched(counted, shared, weights, (n_docs, length), k)
        rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
        best = best.withColumn("rank", rank).where(F.col("rank") <= k)
        # One row an item of the part, whose size is bounded.
        best = best.join(F.broadcast(names), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
        found.append(cut_lineage(best))
    if not found:
        return spark.createDataFrame([], T.StructType([*_numbered(asked).fields[1:], *RANKED.fields]))
    return reduce(DataFrame.union, found)


def _numbered(asked: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("item", T.LongType()), asked.schema["item_id"]])
