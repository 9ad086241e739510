"""Operator 7, best-fit-decreasing packing into windows of fixed size.

Where the texts are read each becomes token ids, an end id is added, and the
ids are cut into full windows and a rest. Only (id, start, length, checksum)
goes on from there, numbered and written to the shared folder. Full windows are
sequences as they are. Rests are dealt out by a hash of their number, so rows
that repeat, ids and texts alike, go everywhere; each task packs its own, longest
first: a segment tree indexed by remaining capacity finds the tightest open
window that still holds a rest. Tasks hold their rests in blocks of BLOCK rows at
most, in the order of the numbers, so memory is bounded and a task that is run
again gives the same windows; each block leaves at most one window that best fit
could not have filled further.

Null and empty texts are the end id alone. Texts of any length are encoded
whole. Repeated rows are packed each for itself. An empty table gives an empty
result. Further columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, column, each_text, table, united
from .token_counts import spelled

WINDOW = 2048
END_ID = 1
BLOCK = 1_000_000
#: Bytes that a worker's cache holds, about; a longer pre-token than LONGEST_KEPT is encoded each time.
CACHE_BYTES, LONGEST_KEPT = 96 << 20, 256
#: Numbers of sequences that are one full window start here.
WHOLE = 1 << 62
PIECES = regex.compile(public_tokenizers.PATTERN)
#: Only Latin letters and marks on which all tables of letters and spaces agree.
PLAIN = re.compile("[^\x00-\x1b\x20-\x7e\xa1-\xac\xae-ɏ]")
#: ASCII and Latin letters alone, for which the faster engine's classes say the same as the pattern.
FAST = re.compile("[^\x00-\x1b\x20-\x7eÀ-ÖØ-öø-ɏ]")
FAST_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
SPECIAL = "<|endoftext|>"


class Ids(dict):
    """The ids of a pre-token, as little-endian 32-bit numbers; a cache emptied when full."""

    def __init__(self, tokenizer, most: int = CACHE_BYTES):
        super().__init__()
        self.model, self.most, self.held = tokenizer.model, most, 0

    def __missing__(self, piece: str) -> bytes:
        ids = [x.id for x in self.model.tokenize(spelled(piece))]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST_KEPT:
            # What an entry takes of a dictionary, its string's and its bytes' heads, and what these hold.
            self.held += 190 + (len(piece) if piece.isascii() else 4 * len(piece)) + len(out)
            if self.held > self.most:
                self.clear()
                self.held = 0
            self[piece] = out
        return out


class Encoder:
    """Texts to the ids that the library gives with its defaults, as bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.ids = Ids(self.tokenizer)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if SPECIAL not in text and not FAST.search(text):
            return b"".join(map(self.ids.__getitem__, FAST_PIECES.findall(text)))
        if SPECIAL in text or PLAIN.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.ids.__getitem__, PIECES.findall(text)))


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


class Openings:
    """Open windows by remaining capacity, under a segment tree of whether a capacity is there."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.there = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        node = self.leaves + capacity
        while node and not self.there[node]:
            self.there[node] = 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The tightest capacity of least or more, with a window that has it."""
        node, there = self.leaves + least, self.there
        while not there[node]:
            while node & 1:  # no right neighbour under the same parent
                node >>= 1
            if not node:
                return None
            node += 1
            if node & (node - 1) == 0:  # past the right edge of the tree
                return None
        while node < self.leaves:
            node *= 2
            node += not there[node]
        capacity = node - self.leaves
        window = self.windows[capacity].pop()
        if not self.windows[capacity]:
            while node and not (there[2 * node] or there[2 * node + 1] if node < self.leaves else 0):
                there[node] = 0
                node >>= 1
        return capacity, window


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length, given longest first."""
    openings, opened = Openings(window), 0
    at, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, n in enumerate(lengths.tolist()):
        found = openings.take(n)
        if found is None:
            capacity, w = window, opened
            opened += 1
        else:
            capacity, w = found
        at[k], offset[k] = w, window - capacity
        if capacity > n:
            openings.put(capacity - n, w)
    return at, offset


PIECE = "{0} {1}, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str, window: int, end_id: int, id_column: str, text_column: str) -> DataFrame:
    """Full windows and the rest of every document."""
    kind = docs.schema[id_column].dataType.simpleString()
    end = struct.pack("<I", end_id)
    step = 4 * window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(each_text(column(batch, "text"))):
                ids = encode(text) + end
                for s in range(0, len(ids), step):
                    part = ids[s : s + step]
                    row.append(i)
                    start.append(s >> 2)
                    length.append(len(part) >> 2)
                    crc.append(zlib.crc32(part))
                    total.append(len(ids) >> 2)
            if row:
                ints = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                yield pa.RecordBatch.from_arrays([column(batch, "id").take(pa.array(row)), *ints], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")).mapInArrow(run, PIECE.format("id", kind))


def packed(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema[id_column].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        first, held, rows = (context.partitionId() if context else 0) << 40, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal first, held, rows
            t = pa.Table.from_batches(held).sort_by([("length", "descending"), ("_row", "ascending")]).drop_columns(["_row"])
            at, offset = best_fit(t["length"].to_numpy(), window)
            t = t.append_column("sequence_id", pa.array(at + first)).append_column("offset", pa.array(offset))
            first, held, rows = first + int(at.max()) + 1, [], 0
            yield from t.combine_chunks().to_batches(max_chunksize=10_000)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
                if rows >= BLOCK:
                    yield from done()
        if held:
            yield from done()

    cut = pieces(docs, path or public_tokenizers.path("byte_bpe_50k.json"), window, end_id, id_column, text_column)
    # Written, so that the numbers stay what they are.
    cut = checkpointed(cut.withColumn("_row", F.monotonically_increasing_id()))
    whole = cut.where(F.col("length") == window).withColumns({"sequence_id": F.lit(WHOLE) + F.col("_row"), "offset": F.lit(0).cast("long")}).drop("_row")
    dealt = cut.where(F.col("length") < window).repartition(F.xxhash64("_row")).sortWithinPartitions("_row")
    return whole.transform(united, dealt.mapInArrow(pack, PIECE.format("id", kind) + ", sequence_id long, offset long")).withColumnRenamed("id", id_column)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
