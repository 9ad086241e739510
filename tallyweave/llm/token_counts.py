"""Operator 2, token counts.

Texts are cut into pre-tokens where they are read, and the lengths of the
pre-tokens are summed there: no pre-token is ever shuffled. Two tiers give the
lengths, for all texts alike. The first is a broadcast hash table, some flat
arrays: every entry of the tokenizer's own vocabulary that ends a word is a
frequent pre-token by construction of its merges; the driver encodes them once.
Its size is that of the vocabulary, whatever the data. The second is a cache in
each Python worker, which encodes a pre-token that the table misses with the
library, once, and is emptied when it holds CACHE_BYTES. Texts in which the
library's tables of letters may differ from the expression's are cut by the
library, and their pieces go through the same two tiers.

Null and empty texts have 0 bytes and 0 tokens. Texts of any length are
counted whole. Repeated rows give repeated rows; further columns of the input
are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .common import by_batch, column, each_text, table

LIMIT = 2048
#: Bytes that a worker's cache holds, about; a longer pre-token than LONGEST_KEPT is encoded each time.
CACHE_BYTES, LONGEST_KEPT = 64 << 20, 256
#: Fixed value: the pattern that word_bpe_49k.json splits by.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Latin letters without combining marks: normal form C leaves them alone. Texts with other characters are cut by the library, whose tables of letters may be newer or older.
PLAIN = re.compile("[^\x00-ɏ]")
SPECIAL = ("<|startoftext|>", "<|endoftext|>")


def _byte_characters() -> dict[int, str]:
    """Byte-level models spell a byte as itself if that is a visible Latin-1 character, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTE_CHARACTERS = _byte_characters()


def spelled(piece: str) -> str:
    """A pre-token as byte-level models see it."""
    return piece.encode("utf-8").decode("latin-1").translate(BYTE_CHARACTERS)


class FrequentTable:
    """Tier one: pre-tokens as models see them, with their lengths, in an open hash table of flat arrays."""

    def __init__(self, lengths: dict[str, int]):
        told = [x.encode() for x in lengths]
        self.names, self.at = b"".join(told), np.cumsum([0, *map(len, told)]).astype(np.uint32)
        self.lengths = np.array(list(lengths.values()), np.uint16)
        self.slots = np.full(1 << max(4, (2 * len(told)).bit_length()), -1, np.int32)
        for k, x in enumerate(told):
            i = self._first(x)
            while self.slots[i] >= 0:
                i = (i + 1) & (len(self.slots) - 1)
            self.slots[i] = k

    def _first(self, name: bytes) -> int:
        return xxhash.xxh3_64_intdigest(name) & (len(self.slots) - 1)

    def get(self, piece: str) -> int | None:
        name = piece.encode("utf-8", "surrogatepass")
        i = self._first(name)
        while (k := self.slots[i]) >= 0:
            if self.names[self.at[k] : self.at[k + 1]] == name:
                return int(self.lengths[k])
            i = (i + 1) & (len(self.slots) - 1)
        return None


class Lengths(dict):
    """Tokens of a pre-token: this worker's cache, which asks the broadcast table and then the library.

    Pre-tokens are keyed as the texts have them, or as models see them where told so.
    """

    def __init__(self, tokenizer, frequent: FrequentTable | None = None, as_seen: bool = False, most: int | None = None):
        super().__init__()
        self.model, self.frequent, self.as_seen, self.most, self.held = tokenizer.model, frequent, as_seen, most or CACHE_BYTES, 0

    def __missing__(self, piece: str) -> int:
        seen = piece if self.as_seen or piece.isascii() and piece.isprintable() else spelled(piece)
        n = self.frequent.get(seen) if self.frequent else None
        if n is None:
            n = len(self.model.tokenize(seen))
        if len(piece) <= LONGEST_KEPT:
            # What an entry takes of a dictionary and its string's head, and four bytes a character at most.
            self.held += 160 + (len(piece) if piece.isascii() else 4 * len(piece))
            if self.held > self.most:
                self.clear()
                self.held = 0
            self[piece] = n
        return n


def frequent_lengths(tokenizer) -> FrequentTable:
    """Tier one, from the vocabulary alone: pre-tokens that it holds as ends of words."""
    lengths = Lengths(tokenizer, as_seen=True, most=1 << 40)
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        if entry.endswith("</w>") and len(entry) <= LONGEST_KEPT and (not entry.isascii() or PIECES.fullmatch(entry[:-4])):
            lengths[entry[:-4]]
    return FrequentTable(dict(lengths))


class Counter:
    """Counts the tokens of texts as the library does with its defaults."""

    def __init__(self, path: str, frequent: FrequentTable | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lengths, self.seen = Lengths(self.tokenizer, frequent), Lengths(self.tokenizer, frequent, as_seen=True)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if "<|" in text and any(x in text for x in SPECIAL):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if text.isascii() or not PLAIN.search(text):
            return sum(map(self.lengths.__getitem__, PIECES.findall(text.lower())))
        text = self.tokenizer.normalizer.normalize_str(text)
        return sum(self.seen[x] for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))


@lru_cache(1)
def counter(path: str, frequent: Broadcast) -> Counter:
    """One for all tasks of a worker."""
    return Counter(path, frequent.value)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit for every row of docs."""
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path("word_bpe_49k.json")
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(Tokenizer.from_file(path)))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = column(batch, "text")
        tokens = np.fromiter(map(counter(path, frequent), each_text(texts)), np.int64, len(texts))
        n_bytes = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0)
        return pa.RecordBatch.from_arrays([column(batch, "id"), n_bytes, pa.array(tokens), pa.array(tokens > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_column].dataType.simpleString()
    return by_batch(docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean", rows).withColumnRenamed("id", id_column)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
