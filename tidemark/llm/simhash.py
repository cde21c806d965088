"""SimHash near-duplicates by anchor points: a covering code gives the anchors at which fingerprints meet."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, quoted, unpacked
from tidemark.llm.components import components
from tidemark.session import cut_lineage

SEED = 42
# Fingerprints that one block of a crowded anchor holds on average; a task compares two blocks at a time.
BLOCK_ROWS = 1024
# Links that a task gathers before it folds them into the classes found so far.
FOLD_LINKS = 1 << 20


def _majority(digests: np.ndarray) -> np.ndarray:
    """Digests as rows of bytes -> the bytes whose bits are 1 where over half of the digests have them."""
    ones = np.zeros(digests.shape[1] * 8, np.int64)
    for at in range(0, len(digests), 65_536):
        ones += np.unpackbits(digests[at : at + 65_536], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(digests), bitorder="little")


def _shingles(words: list[bytes], n: int) -> list[bytes]:
    joined = b" ".join(words)
    if len(words) <= n:
        return [joined]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [joined[a:b] for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())]


def fingerprint_of(text: str | None, shingle: int, wide: int = 0) -> tuple[int, int, int]:
    """64 bits of the shingles, as a signed number: a bit is 1 if set in over half of their XXH64 hashes. With `wide`,
    128 bits more, of the different shingles of that many words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0, 0, 0
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, SEED) for x in _shingles(words, shingle)], "<u8")
    fp = int(_majority(hashes.view(np.uint8).reshape(-1, 8)).view("<i8")[0])
    if not wide:
        return fp, 0, 0
    digests = b"".join(map(xxhash.xxh3_128_digest, set(_shingles(words, wide))))
    w1, w2 = _majority(np.frombuffer(digests, np.uint8).reshape(-1, 16)).view("<i8").tolist()
    return fp, w1, w2


def fingerprints(text: Column, shingle: int, wide: int = 0) -> Column:
    @F.pandas_udf("fp long, w1 long, w2 long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([fingerprint_of(t, shingle, wide) for t in texts], columns=["fp", "w1", "w2"]).astype("int64")

    return simhash(text)


def blocks_for(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the blocks of the 64 bits: so many that links differ in at most one bit of some block."""
    n = max_bits // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _anchors_of(fp: str, index: int, shift: int, width: int) -> str:
    """SQL for the anchors of one block: array of structs (anchor, visits).

    Anchors are the words of the longest Hamming code that fits into the block, a covering code of radius 1, times the
    bits left over. A fingerprint's home is its one code word within the radius. Two blocks that differ in one bit have
    different parity, so it is enough that the even one of them also visits the anchors within radius plus threshold
    that can be home to the other: the words that share two flipped bits with its syndrome, and the flips of the bits
    left over.
    """
    r = (width + 1).bit_length() - 1
    code = (1 << r) - 1
    x = f"(shiftrightunsigned({fp}, {shift}) & {(1 << width) - 1}L)"
    parity = [sum(1 << (p - 1) for p in range(1, code + 1) if p >> j & 1) for j in range(r)]
    s = " + ".join(f"shiftleft(bit_count({x} & {m}L) & 1, {j})" for j, m in enumerate(parity))
    pairs = f"transform(filter(sequence(1, {code}), p -> s > 0 AND p < (p ^ s)), p -> x ^ shiftleft(1L, p - 1) ^ shiftleft(1L, (p ^ s) - 1))"
    spare = f"transform(sequence({code}, {width - 1}), q -> home ^ shiftleft(1L, q))" if width > code else "array()"
    visits = f"CASE WHEN bit_count(x) % 2 = 0 THEN concat({pairs}, {spare}) ELSE array() END"
    # x, s and home are bound by one-element transforms, as SQL has no local names.
    body = f"concat(array(struct(home AS anchor, false AS visits)), transform({visits}, v -> struct(v AS anchor, true AS visits)))"
    bound = f"transform(array(CASE WHEN s > 0 THEN x ^ shiftleft(1L, s - 1) ELSE x END), home -> {body})[0]"
    bound = f"transform(array({x}), x -> {bound})[0]"
    bound = f"transform(array({s}), s -> {bound})[0]"
    return f"transform({bound}, a -> struct(a.anchor | {index << 48}L AS anchor, a.visits AS visits))"


def at_anchors(fps: DataFrame, max_bits: int) -> DataFrame:
    """Fingerprints with anchor and visits, one row for each anchor at which one has to be."""
    lists = [_anchors_of("fp", i, shift, width) for i, (shift, width) in enumerate(blocks_for(max_bits))]
    rows = fps.select("*", F.explode(F.expr(f"concat({', '.join(lists)})")).alias("at"))
    return rows.select(F.col("at.anchor").alias("anchor"), F.col("at.visits").alias("visits"), *fps.columns)


def _tiles(rows: DataFrame, block_rows: int) -> DataFrame:
    """The rows with tile: a crowded anchor is cut into blocks by hash, and each pair of blocks is a tile."""
    names = rows.columns
    crowded = rows.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
    crowded = cut_lineage(crowded.select("anchor", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")))
    rows = rows.join(crowded, "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node", "visits"), F.col("blocks").cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("own", own).select(*names, "blocks", "own", other.alias("other"))
    tile = F.least("own", "other").cast("long") * F.col("blocks") + F.greatest("own", "other")
    return rows.select(*names, tile.alias("tile"))


def _fold(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of a[i] and b[i]; a label is the smallest position of its class."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels


def _links(group: np.ndarray, visits: np.ndarray, fp: np.ndarray, max_bits: int, wide: list[np.ndarray], wide_bits: int):
    """A spanning forest of the links inside the groups, as two lists of places. Rows are sorted by group, homes before
    visitors; a home is compared with all rows after it, visitors not with each other."""
    n = len(group)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    labels = np.arange(n)
    homes = np.flatnonzero(~visits & (ends - np.arange(n) > 1))
    found, held, lag = [], 0, 1
    while len(homes):
        near = homes[np.bitwise_count(fp[homes] ^ fp[homes + lag]) <= max_bits]
        if len(near) and wide:
            near = near[sum(np.bitwise_count(w[near] ^ w[near + lag]) for w in wide) <= wide_bits]
        if len(near):
            found += [near, near + lag]
            held += len(near)
        if held > FOLD_LINKS:
            labels = _fold(labels, np.concatenate(found[::2]), np.concatenate(found[1::2]))
            found, held = [], 0
        lag += 1
        homes = homes[ends[homes] - homes > lag]
    if found:
        labels = _fold(labels, np.concatenate(found[::2]), np.concatenate(found[1::2]))
    members = np.flatnonzero(labels != np.arange(n))
    return members, labels[members]


def linked_fingerprints(fps: DataFrame, max_bits: int, wide_bits: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node, fp and with `wide_bits` w1, w2), nodes all different -> (a, b): pairs of nodes that join every class of
    nodes linked by at most so many differing bits, each member with the first of its class at an anchor."""
    rows = _tiles(at_anchors(fps, max_bits), block_rows)
    rows = rows.repartition("anchor", "tile").sortWithinPartitions("anchor", "tile", "visits")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            anchor, tile = (held.column(c).to_numpy() for c in ("anchor", "tile"))
            # The last group may go on in the next batch.
            last = int(np.flatnonzero((anchor != anchor[-1]) | (tile != tile[-1]))[-1]) + 1 if len(anchor) and (anchor[0] != anchor[-1] or tile[0] != tile[-1]) else 0
            if last:
                yield from _compared(held.slice(0, last))
                held = held.slice(last).combine_chunks()
        if held is not None and held.num_rows:
            yield from _compared(held)

    def _compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        anchor, tile = (table.column(c).to_numpy() for c in ("anchor", "tile"))
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (tile[1:] != tile[:-1])))
        visits = table.column("visits").to_numpy(zero_copy_only=False).astype(bool)
        fp, *wide = (table.column(c).to_numpy().view(np.uint64) for c in (("fp",) if wide_bits is None else ("fp", "w1", "w2")))
        a, b = _links(np.cumsum(new), visits, fp, max_bits, wide, wide_bits or 0)
        if len(a):
            node = table.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(node[x]) for x in (a, b)], names=["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def fingerprint_classes(rows: DataFrame, max_bits: int, wide_bits: int | None = None, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, node, fp, w1, w2) -> (node, root, component_id): the smallest node and the smallest doc_id reachable over
    links."""
    signature = ["fp"] if wide_bits is None else ["fp", "w1", "w2"]
    nodes = cut_lineage(rows.groupBy("node").agg(F.min(quoted(doc_id)).alias("first"), *[F.first(c).alias(c) for c in signature]))
    roots = components(linked_fingerprints(nodes.select("node", *signature), max_bits, wide_bits))
    named = nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    named = cut_lineage(named)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return named.join(least, "root").select("node", "root", "component_id")


def _signed(docs: DataFrame, columns: Sequence[str], shingle: int, wide: tuple[int, int] | None, text: str) -> DataFrame:
    """The columns as one struct, with node, fp, w1 and w2; written once, as the texts are hashed in Python."""
    rows = docs.select(F.struct(*[quoted(c).alias(c) for c in columns]).alias(ROW), fingerprints(quoted(text), shingle, wide[0] if wide else 0).alias("s"))
    node = F.xxhash64("s.fp", "s.w1", "s.w2") if wide else F.col("s.fp")
    return cut_lineage(rows.select(ROW, node.alias("node"), "s.fp", "s.w1", "s.w2"))


def near_duplicates(
    docs: DataFrame,
    *,
    shingle: int = 3,
    max_bits: int = 3,
    wide: tuple[int, int] | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The given columns (default: all) with fingerprint (16 hex digits) and component_id, the smallest doc_id reachable
    over links between fingerprints of at most `max_bits` differing bits. With `wide` = (words, bits), a link also needs
    at most `bits` differing bits of a 128-bit fingerprint of the different shingles of so many words.

    Equal fingerprints are one row from the start, so copies cost no comparison. The 64 bits are cut into blocks so that
    a link differs in at most one bit of some block; per block, fingerprints go to the anchors of a covering code and are
    compared there only (`_anchors_of`). Tasks return a spanning forest of the links of an anchor, never all pairs.

    Null, empty and blank texts have fingerprint zero and link like any other; texts with fewer words than a shingle are
    one shingle; a null doc_id is no component's name unless no member has another; repeated rows are members each; an
    empty table gives an empty result; columns named fingerprint or component_id are replaced.
    """
    names = list(columns or docs.columns)
    rows = _signed(docs, dict.fromkeys([*names, doc_id]), shingle, wide, text)
    classes = fingerprint_classes(_narrow(rows, doc_id), max_bits, wide[1] if wide else None, "_id")
    rows = rows.join(classes.drop("root"), "node")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return unpacked(rows, names, {"fingerprint": shown, "component_id": F.col("component_id")})


def first_of_each(
    docs: DataFrame,
    *,
    shingle: int = 3,
    max_bits: int = 3,
    wide: tuple[int, int] | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """One row of each component of `near_duplicates`, that of the smallest doc_id, with the columns of the input. Rows of
    one id and fingerprint are one; of several fingerprints of one id the least stays, and so it does in a component
    without any id."""
    names = docs.columns
    rows = _signed(docs, names, shingle, wide, text)
    narrow = _narrow(rows, doc_id)
    classes = fingerprint_classes(narrow, max_bits, wide[1] if wide else None, "_id")
    first = narrow.groupBy("node").agg(F.min("_id").alias("_id"))
    kept = classes.join(first, "node").where(F.col("_id").eqNullSafe(F.col("component_id")))
    kept = kept.groupBy("root").agg(F.min("node").alias("_keep"), F.first("component_id").alias("_first"))
    kept = cut_lineage(kept.select("_keep", "_first"))
    own = F.col(ROW).getField(doc_id)
    rows = rows.withColumn("_id", own).join(kept, (F.col("node") == F.col("_keep")) & F.col("_id").eqNullSafe(F.col("_first")), "left_semi")
    return unpacked(rows.dropDuplicates(["node", "_id"]), names, {})


def _narrow(rows: DataFrame, doc_id: str) -> DataFrame:
    return rows.select(F.col(ROW).getField(doc_id).alias("_id"), "node", "fp", "w1", "w2")
