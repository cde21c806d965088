"""Token-ID shards compressed by Re-Pair: frequent id pairs become nonterminals, block by block, with rules and expansion
lengths stored for decoding from any place."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.common import quoted
from tidemark.session import ensure_checkpoint_dir

# Ids after which a block is closed at the next end of a document.
BLOCK_IDS = 1 << 20
# A pair is replaced while it occurs at least so often in its block; at most so many pairs a round, and rounds a block.
LEAST_PAIRS, ROUND_RULES, ROUNDS = 16, 4096, 8
# Pieces of text that a worker remembers with their ids.
PIECES = 1 << 20

# Texts of these characters are cut into pieces here, as the byte-level tokenizer itself cuts them: letters, digits and other
# characters in runs, each with one space before it, and white space. Other texts are encoded as a whole.
# Apostrophes, control characters, letters beyond U+017F and what may be a special token make a text other.
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(9, 14), *range(32, 39), *range(40, 127), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = True
# A space at which a piece always begins, and the characters that are worked on at a time.
BETWEEN = re.compile(r"(?<=[^\s]) (?=[^\s])")
STRETCH = 1 << 21
_SPACE, _WHITE, _END = 2, 3, 5
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
_CLASS[48:58] = 1
_CLASS[9:14] = _WHITE
_CLASS[32] = _SPACE
_CLASS[0] = _END  # stands between texts


# Hashing of pieces: a random 64-bit number for each byte times a power of an odd number for each place. Pieces that share a
# hash are compared byte by byte.
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def piece_starts(data: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts with a zero byte after each; a zero byte is a piece of its own."""
    kind = _CLASS[data]
    white = (kind == _SPACE) | (kind == _WHITE)
    starts = np.empty(len(data), bool)
    starts[0] = True
    changed = kind[1:] != kind[:-1]
    # A run begins where its kind changes, unless a space before it belongs to it.
    starts[1:] = (changed | (kind[1:] == _END)) & ~white[1:] & ((kind[:-1] != _SPACE) | (kind[1:] == _END))
    # White space begins a piece, and so does the last of it before something else.
    starts[1:] |= white[1:] & ~white[:-1]
    starts[:-1] |= white[:-1] & ~white[1:] & (kind[1:] != _END)
    return np.flatnonzero(starts)


def plain_texts(texts: list[str]) -> list[bool]:
    """Whether each text has only the characters that are cut into pieces here."""
    encoded = [t.encode() for t in texts]
    ends = np.cumsum([len(t) for t in encoded])
    data = np.frombuffer(b"".join(encoded), np.uint8)
    if not len(data):
        return [True] * len(texts)
    odd = ~_PLAIN[data]
    second = data[1:]
    # The two signs among the letters of one lead byte, and the beginning of a special token.
    odd[1:] |= (data[:-1] == 0xC3) & ((second == 0x97) | (second == 0xB7)) | (data[:-1] == 0x3C) & (second == 0x7C)
    found = np.ones(len(texts), bool)
    found[np.searchsorted(ends, np.flatnonzero(odd), "right")] = False
    return found.tolist()


def _byte_letters() -> dict[int, str]:
    """Character -> the characters that the byte-level vocabulary has for its bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    for b in range(256):
        names.setdefault(b, chr(256 + len(names) - len(shown)))
    return {c: "".join(names[b] for b in chr(c).encode()) for c in range(0x180)}


class Encoder:
    """Encodes texts by piece: a different piece is encoded once, by the tokenizer's model, which never joins pieces."""

    def __init__(self, path: str, by_piece: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.by_piece = Tokenizer.from_file(path), by_piece
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.letters = _byte_letters()
        self.powers = self.inverse = np.empty(0, np.uint64)
        self.forget()

    def forget(self) -> None:
        """Known pieces by hash, and by number their ids and their bytes, each in one array with starts and lengths."""
        self.known: dict[int, int] = {}
        self.flat, self.starts, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.bytes, self.byte_starts, self.byte_lengths = np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        ids = [[t.id for t in tokenize(p.decode().translate(letters))] for p in pieces]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lengths) - lengths))
        self.flat, self.lengths = np.concatenate((self.flat, flat)), np.concatenate((self.lengths, lengths))
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.byte_starts = np.concatenate((self.byte_starts, len(self.bytes) + np.cumsum(lengths) - lengths))
        self.bytes = np.concatenate((self.bytes, np.frombuffer(b"".join(pieces), np.uint8)))
        self.byte_lengths = np.concatenate((self.byte_lengths, lengths))

    def _by_pieces(self, texts: list[str]) -> list[np.ndarray]:
        joined = ("\0".join(texts) + "\0").encode()
        data = np.frombuffer(joined, np.uint8)
        if len(self.powers) <= len(data):
            n = 2 * len(data) + 1
            self.powers, self.inverse = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        starts = piece_starts(data)
        sizes = np.diff(np.append(starts, len(data)))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * self.powers[: len(data)], dtype=np.uint64)))
        hashes = (sums[starts + sizes] - sums[starts]) * self.inverse[starts]
        real = data[starts] != 0
        at, own = starts[real], sizes[real]
        # Hashes are numbered as they turn up, so a hash is first seen where the highest number so far grows.
        which, different = pd.factorize(hashes[real])
        first = np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1))
        numbers = np.fromiter(map(self.known.get, different.tolist(), repeat(-1)), np.int64, len(different))
        old, new = np.flatnonzero(numbers >= 0), np.flatnonzero(numbers < 0)
        alike = np.array_equal(own, own[first][which]) and np.array_equal(data[data != 0], _gather(data, at[first], own[first], which))
        alike = alike and np.array_equal(own[first[old]], self.byte_lengths[numbers[old]])
        if not alike or not np.array_equal(_gather(data, at, own, first[old]), _gather(self.bytes, self.byte_starts, self.byte_lengths, numbers[old])):
            # Different pieces with one hash: these texts are encoded as wholes.
            return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]
        if len(new):
            numbers[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(different[new].tolist(), numbers[new].tolist()))
            self._learn([joined[a : a + n] for a, n in zip(at[first[new]].tolist(), own[first[new]].tolist())])
        numbers = numbers[which]
        ids = _gather(self.flat, self.starts, self.lengths, numbers)
        totals = np.zeros(len(starts) + 1, np.int64)
        totals[1:][real] = self.lengths[numbers]
        totals = np.cumsum(totals)
        return np.split(ids, totals[np.flatnonzero(~real)][:-1])

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as encoding the whole text gives them. Long texts are taken in stretches that end where
        pieces end."""
        if len(self.known) > PIECES:
            self.forget()
        found: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[str] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            for i, ids in zip(owners, self._by_pieces(waiting) if waiting else []):
                found[i].append(ids)
            waiting.clear()
            owners.clear()
            size = 0

        plain = plain_texts(texts) if self.by_piece else [False] * len(texts)
        for i, text in enumerate(texts):
            if not plain[i]:
                found[i].append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
                continue
            at = 0
            while at < len(text) or not at:
                cut = BETWEEN.search(text, at + STRETCH) if len(text) - at > STRETCH else None
                end = cut.start() if cut else len(text)
                waiting.append(text[at:end])
                owners.append(i)
                size += end - at
                at = max(end, 1)
                if size >= STRETCH:
                    flush()
        flush()
        return [np.concatenate(x) if len(x) > 1 else x[0] for x in found]


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The stretches of `flat` with these numbers, one after the other."""
    own = lengths[numbers]
    ends = np.cumsum(own)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    places = np.repeat((starts[numbers] - (ends - own)).astype(kind), own)
    places += np.arange(total, dtype=kind)
    return flat[places]


def repair(ids: np.ndarray, doc_starts: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, rules, places of the documents in the sequence). Rule r stands for symbol vocabulary + r and is a pair
    of earlier symbols. A round counts all neighbouring pairs and replaces the frequent ones, most frequent first where
    there are many; of overlapping places every second one is taken. Pairs never reach over a document's end."""
    wide = vocabulary > 60_000
    most = (1 << 31 if wide else 1 << 16) - vocabulary
    kind, shift = (np.uint64, 32) if wide else (np.uint32, 16)
    s = ids.astype(kind)
    first = np.zeros(len(s), bool)
    first[doc_starts] = True
    rules = np.empty((0, 2), kind)
    for _ in range(ROUNDS):
        if len(s) < 2 or len(rules) >= most:
            break
        keys = s[:-1] << kind(shift) | s[1:]
        ordered = np.sort(keys[~first[1:]])
        if not len(ordered):
            break
        at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(np.append(at, len(ordered)))
        often = np.flatnonzero(counts >= LEAST_PAIRS)
        if not len(often):
            break
        room = min(ROUND_RULES, most - len(rules))
        if len(often) > room:
            often = np.sort(often[np.argsort(-counts[often], kind="stable")[:room]])
        pairs = ordered[at[often]]
        # A small table of hashes has the one pair of a slot; only slots of several pairs are searched.
        slots = _slot(pairs, shift)
        table = np.full(1 << 16, -1, np.int32)
        table[slots] = np.arange(len(pairs))
        table[np.flatnonzero(np.bincount(slots, minlength=1 << 16) > 1)] = len(pairs)
        found = table[_slot(keys, shift)]
        places = np.flatnonzero((found >= 0) & ~first[1:])
        found = found[places]
        several = np.flatnonzero(found == len(pairs))
        found[several] = np.minimum(np.searchsorted(pairs, keys[places[several]]), len(pairs) - 1)
        hit = pairs[found] == keys[places]
        places, found = places[hit], found[hit]
        # In a run of neighbouring places the first, third, ... are taken.
        begins = np.concatenate(([True], places[1:] != places[:-1] + 1))
        run = places - places[begins][np.cumsum(begins) - 1]
        places, found = places[run % 2 == 0], found[run % 2 == 0]
        s[places] = (vocabulary + len(rules) + found).astype(kind)
        rules = np.concatenate((rules, np.stack((pairs >> kind(shift), pairs & kind((1 << shift) - 1)), 1)))
        keep = np.ones(len(s), bool)
        keep[places + 1] = False
        s, first = s[keep], first[keep]
    small = np.uint32 if wide else np.uint16
    return s.astype(small), rules.astype(small), np.flatnonzero(first)


def _slot(keys: np.ndarray, shift: int) -> np.ndarray:
    return (keys * keys.dtype.type(0x9E3779B1)) >> keys.dtype.type(2 * shift - 16)


def expansion_lengths(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """How many ids each rule stands for."""
    lengths = []
    size = lambda x: 1 if x < vocabulary else lengths[x - vocabulary]
    for a, b in rules.tolist():
        lengths.append(size(a) + size(b))
    return np.array(lengths, np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, vocabulary: int) -> np.ndarray:
    """The ids that a stretch of the sequence stands for."""
    if not len(rules):
        return symbols.astype(np.uint32)
    held = np.zeros(vocabulary + len(rules), bool)
    held[symbols] = True
    used = np.flatnonzero(held)
    known: dict[int, np.ndarray] = {}

    def ids_of(x: int) -> np.ndarray:
        if x < vocabulary:
            return np.array([x], np.uint32)
        if x not in known:
            a, b = rules[x - vocabulary].tolist()
            known[x] = np.concatenate((ids_of(a), ids_of(b)))
        return known[x]

    plain = used[used < vocabulary]
    flat = [ids_of(x) for x in used[len(plain) :].tolist()]
    table = np.concatenate((plain.astype(np.uint32), *flat))
    sizes = np.concatenate((np.ones(len(plain), np.int64), np.array([len(x) for x in flat], np.int64)))
    place = np.zeros(len(held), np.int32)
    place[used] = np.arange(len(used))
    return _gather(table, np.cumsum(sizes) - sizes, sizes, place[symbols])


class Block:
    """One block of the file, for decoding whole documents or a range of one's ids."""

    def __init__(self, row: dict) -> None:
        kind = np.dtype(f"<u{row['width']}")
        self.vocabulary = row["vocabulary"]
        self.sequence = np.frombuffer(row["sequence"], kind)
        self.rules = np.frombuffer(row["rules"], kind).reshape(-1, 2)
        self.lengths = np.frombuffer(row["rule_lengths"], "<u4")
        self.places = np.append(np.frombuffer(row["doc_places"], "<u4"), len(self.sequence)).astype(np.int64)

    def document(self, n: int) -> np.ndarray:
        return expand(self.sequence[self.places[n] : self.places[n + 1]], self.rules, self.lengths, self.vocabulary)

    def ids(self, n: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of document n: expansion lengths say which symbols hold them; only those are expanded."""
        symbols = self.sequence[self.places[n] : self.places[n + 1]]
        sizes = np.ones(len(symbols), np.int64)
        compound = symbols >= self.vocabulary
        sizes[compound] = self.lengths[symbols[compound].astype(np.int64) - self.vocabulary]
        ends = np.cumsum(sizes)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skipped = int(ends[a - 1]) if a else 0
        return expand(symbols[a:b], self.rules, self.lengths, self.vocabulary)[start - skipped : stop - skipped]

    def whole(self) -> np.ndarray:
        return expand(self.sequence, self.rules, self.lengths, self.vocabulary)


BLOCK = pa.schema([
    ("part", pa.int64()), ("block", pa.int64()), ("part_start", pa.int64()), ("n_ids", pa.int64()),
    ("vocabulary", pa.int32()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())),
    ("doc_places", pa.binary()), ("rules", pa.binary()), ("rule_lengths", pa.binary()), ("sequence", pa.binary()),
])
BLOCK_SQL = (
    "part long, block long, part_start long, n_ids long, vocabulary int, width int, doc_ids array<long>, doc_tokens array<long>, "
    "doc_places binary, rules binary, rule_lengths binary, sequence binary"
)


def write_token_shards(
    docs: DataFrame, path: str, tokenizer: str, *, end_id: int | None = 2, by_piece: bool = True, text: str = "text", doc_id: str = "doc_id",
    block_ids: int = BLOCK_IDS,
) -> None:
    """Encode every text, append `end_id`, and write the ids in ascending doc_id order (nulls first, equal ids by a hash of
    the text) as blocks of a Parquet table: one file for each range of doc_ids, so `part` and `block` give the order.

    A block has its documents' ids and lengths, Re-Pair rules with expansion lengths, the compressed sequence and the
    place of each document in it. Null texts count as empty; an empty table writes no block. `by_piece` states that the
    tokenizer is byte-level with the usual splitting pattern, so that pieces may be encoded once each.
    """
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, by_piece)
        context = TaskContext.get()
        part, block, start = context.partitionId() if context else 0, 0, 0
        ids, names = [], []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal block, start, ids, names, held
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.concatenate(ids)
            sequence, rules, places = repair(flat, (np.cumsum(lengths) - lengths)[lengths > 0], encoder.vocabulary)
            # An empty document has the place of the next one.
            every = np.append(places, len(sequence))[np.cumsum(lengths > 0) - (lengths > 0)]
            row = {
                "part": part, "block": block, "part_start": start, "n_ids": len(flat), "vocabulary": encoder.vocabulary,
                "width": sequence.dtype.itemsize, "doc_ids": names, "doc_tokens": lengths.tolist(),
                "doc_places": every.astype("<u4").tobytes(), "rules": rules.astype(rules.dtype.newbyteorder("<")).tobytes(),
                "rule_lengths": expansion_lengths(rules, encoder.vocabulary).astype("<u4").tobytes(),
                "sequence": sequence.astype(sequence.dtype.newbyteorder("<")).tobytes(),
            }
            block, start, ids, names, held = block + 1, start + len(flat), [], [], 0
            return pa.RecordBatch.from_pylist([row], BLOCK)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                for name, found in zip(some.column("doc_id").to_pylist(), encoder.encoded(some.column("text").to_pylist())):
                    ids.append(found if end_id is None else np.append(found, np.uint32(end_id)))
                    names.append(name)
                    held += len(ids[-1])
                    if held >= block_ids:
                        yield close()
        if ids:
            yield close()

    rows.mapInArrow(blocks, BLOCK_SQL).write.option("parquet.block.size", str(32 << 20)).parquet(path)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def _encoder(path: str, by_piece: bool) -> Encoder:
    """One encoder for each worker process and tokenizer."""
    if (path, by_piece) not in _ENCODERS:
        _ENCODERS[path, by_piece] = Encoder(path, by_piece)
    return _ENCODERS[path, by_piece]


def read_token_shards(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the file: start counts the ids of all
    documents before it, ids_crc32 is the CRC-32 of its ids as little-endian unsigned 32-bit integers."""
    blocks = spark.read.parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_offset"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                ids = Block(row).whole().astype("<u4")
                lengths = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                columns = [
                    pa.array([row["part"]] * len(lengths), pa.int64()), pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["part_start"] + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = blocks.mapInArrow(decoded, "part long, doc_id long, at long, n_tokens long, ids_crc32 long").join(parts, "part")
    return rows.select("doc_id", (F.col("part_offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def new_shard_path(spark) -> str:
    """A new folder for shards, in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/token-shards-{uuid.uuid4().hex}"
