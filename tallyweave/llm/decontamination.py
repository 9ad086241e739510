"""Operator 6, benchmark decontamination by an FM-index per shard.

Words are longest runs of a-z, 0-9 and non-ASCII characters after A-Z became
a-z. A phrase is ten consecutive words of an item, or all of a shorter item.
A task cuts the texts it reads into shards of SHARD_BYTES, indexes each by
fm_index.py, searches all phrases backward, locates their occurrences by
sampled suffix positions and merges them into removal spans. A benchmark of up
to BLOCK_WORDS words is broadcast, and nothing is shuffled. A larger one is dealt
into blocks of about so many; each takes a pass of its own, whose hits are written
to the shared folder before the next block is broadcast, and hits meet their
documents by row at the end. So neither the driver nor a task ever holds more
than a block, and an item of more words is cut into overlapping parts.

Words are found by a 64-bit hash of their bytes and length, and those of each
occurrence are then compared with the phrase's own.

Null texts and texts without words have no words and no hits; null and empty
items have no phrases; items of one id are one item with the phrases of all its
texts. Repeated
documents give repeated rows, each with its own decision. An empty benchmark
leaves every document clean. decontaminated() keeps further columns; the query
reads none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import by_batch, checkpointed, column, slices, table, text_bytes, united
from .fm_index import FMIndex

WINDOW = 10
SHARD_BYTES = 6 << 20
BLOCK_WORDS = 2_000_000


class Phrases:
    """Items' phrases over a vocabulary of sorted word hashes.

    items: name, hashes of the words, the words with bytes of zero between them. A phrase is a place in the symbols (from 1)
    of all items and a length; it is cut out while it is searched, so that a word of an item takes some 40 bytes in all.
    """

    def __init__(self, items: list[tuple[str, np.ndarray, bytes]], window: int):
        every = np.concatenate([h for _, h, _ in items])
        self.vocabulary, first = np.unique(every, return_index=True)
        self.stream = (np.searchsorted(self.vocabulary, every) + 1).astype(np.int32)
        self.raw, at = b"\0".join(raw for _, _, raw in items), 0
        _, begins, ends, _ = words.spans(np.frombuffer(self.raw, np.uint8), np.array([0, len(self.raw)]))
        kept = np.stack([begins[first], ends[first]]) if len(begins) else np.zeros((2, len(first)), np.int64)
        self.bounds = kept.astype(np.int32 if len(self.raw) < 1 << 31 else np.int64)
        number: dict[str, int] = {}
        starts, lengths, of = [], [], []
        for name, hashes, _ in items:
            many = max(1, len(hashes) - window + 1)
            starts.append(np.arange(at, at + many, dtype=np.int32))
            lengths.append(np.full(many, min(window, len(hashes)), np.int32))
            of.append(np.full(many, number.setdefault(name, len(number)), np.int32))
            at += len(hashes)
        self.starts, self.lengths, self.of, self.names = np.concatenate(starts), np.concatenate(lengths), np.concatenate(of), list(number)

    def word(self, symbol: int) -> bytes:
        begin, end = self.bounds[:, symbol - 1]
        return self.raw[begin:end]

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def hashed_items(benchmark: DataFrame, window: int, id_column: str, text_column: str) -> DataFrame:
    """(item, n, hashes, words) of each item, or of its overlapping parts; items without words and repeats are left out."""
    block = BLOCK_WORDS

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, sizes, hashes, told = [], [], [], []
        for name, text in zip(column(batch, "i").to_pylist(), column(batch, "t").to_pylist(), strict=True):
            data = np.frombuffer(text.encode(), np.uint8)
            folded, begins, ends, _ = words.spans(data, np.array([0, len(data)]))
            h = words.hashes(folded, begins, ends)
            for first in range(0, max(1, len(h) - window + 1) if len(h) else 0, block):
                last = first + block + window - 1
                own = folded[begins[first] : ends[min(last, len(h)) - 1]]
                names.append(name)
                hashes.append(h[first:last].tobytes())
                sizes.append(len(h[first:last]))
                told.append(own.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(told, pa.binary())], ["item", "n", "hashes", "words"])

    rows = benchmark.select(F.col(id_column).cast("string").alias("i"), F.col(text_column).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").dropDuplicates()
    return by_batch(rows, "item string, n long, hashes binary, words binary", run)


def phrases_of(items: DataFrame, window: int) -> Phrases | None:
    """A block's phrases, on the driver."""
    t = items.toArrow()
    if not t.num_rows:
        return None
    told = zip(t["item"].to_pylist(), t["hashes"].to_pylist(), t["words"].to_pylist(), strict=True)
    return Phrases([(name, np.frombuffer(h, np.uint64), raw) for name, h, raw in told], window)


class Hits:
    """For the texts of a shard: word counts, hit words as byte spans, items that occur."""

    def __init__(self, texts: pa.Array, phrases: Phrases):
        self.data, offsets = text_bytes(texts)
        begins, ends, heads, parts, base = [], [], [np.zeros(1, np.int64)], [], 0
        for first, last in slices(texts):
            low, high = offsets[first], offsets[last]
            folded, b, e, h = words.spans(self.data[low:high], offsets[first : last + 1] - low)
            parts.append(phrases.symbols(words.hashes(folded, b, e)))
            begins.append(b + low)
            ends.append(e + low)
            heads.append(h[1:] + base)
            base += len(b)
        self.offsets, self.heads = offsets, np.concatenate(heads)
        self.begins, self.ends = np.concatenate(begins), np.concatenate(ends)
        n, counts = len(texts), np.diff(self.heads)
        of = np.repeat(np.arange(n), counts)
        # In the indexed text a 0 follows each document: word w is at w + its document's number.
        places = np.arange(base) + of
        line = np.zeros(base + n, np.int64)
        line[places] = np.concatenate(parts)
        while True:
            at, phrase, hit = self._occurrences(line, places, phrases)
            wrong = [w for w in np.flatnonzero(hit).tolist() if words.FOLD[self.data[self.begins[w] : self.ends[w]]].tobytes() != phrases.word(line[places[w]])]
            if not wrong:
                break
            # Another word of the same hash, which is no word of a phrase.
            line[places[wrong]] = 0
        self.counts = counts
        text = np.searchsorted(self.heads + np.arange(n + 1), at, "right") - 1
        pairs = np.unique(text * len(phrases.names) + phrases.of[phrase])
        self.items: list[list[str]] = [[] for _ in range(n)]
        for p in pairs.tolist():
            self.items[p // len(phrases.names)].append(phrases.names[p % len(phrases.names)])
        # Runs of hit words, not across texts.
        self.spans: list[list[list[int]]] = [[] for _ in range(n)]
        at = np.flatnonzero(hit)
        if len(at):
            fresh = np.append(True, (np.diff(at) > 1) | (np.diff(of[at]) > 0))
            for a, b in zip(at[fresh].tolist(), at[np.append(fresh[1:], True)].tolist(), strict=True):
                i = int(of[a])
                self.spans[i].append([int(self.begins[a] - offsets[i]), int(self.ends[b] - offsets[i])])

    @staticmethod
    def _occurrences(line: np.ndarray, places: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where phrases occur in the line, which, and the words inside an occurrence."""
        index = FMIndex(line, len(phrases.vocabulary))
        low, high = index.search(phrases.stream, phrases.starts, phrases.lengths)
        found = high - low
        phrase = np.repeat(np.arange(len(found)), found)
        rows = np.arange(len(phrase)) - np.repeat(np.cumsum(found) - found, found) + low[phrase]
        at = index.locate(rows)
        stop = at + phrases.lengths[phrase]
        marks = np.bincount(at, minlength=len(line) + 1) - np.bincount(stop, minlength=len(line) + 1)
        return at, phrase, np.cumsum(marks)[places] > 0


_FOUND = "n_words long, spans array<array<long>>, items array<string>"


def found(docs: DataFrame, phrases: Phrases | None, text_column: str) -> DataFrame:
    """docs with n_words, spans (byte ranges of hit words) and items."""
    # A word that no text has stands for no phrases.
    held = docs.sparkSession.sparkContext.broadcast(phrases or Phrases([("", np.zeros(1, np.uint64), b"")], 1))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, text_column)
            for first, last in slices(texts, SHARD_BYTES):
                part = batch.slice(first, last - first)
                hits = Hits(texts.slice(first, last - first), held.value)
                out = [column(part, x) for x in names] + [pa.array(hits.counts, pa.int64()), pa.array(hits.spans, pa.list_(pa.list_(pa.int64()))), pa.array(hits.items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(out, [*names, "n_words", "spans", "items"])

    fields = ", ".join(f"`{x}` {docs.schema[x].dataType.simpleString()}" for x in names)
    return docs.mapInArrow(run, f"{fields}, {_FOUND}")


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Byte ranges that overlap or touch, as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def removal_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, spans and items (sorted); docs must have no columns of these names."""
    items = checkpointed(hashed_items(benchmark, window, item_id, item_text))
    total = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if total <= BLOCK_WORDS:
        return found(docs, phrases_of(items, window), text_column).withColumn("items", F.array_sort("items"))
    # Many blocks: rows are numbered and written, so that a row has the same number in each pass.
    rows = checkpointed(docs.withColumn("_row", F.monotonically_increasing_id()))
    count = -(-total // BLOCK_WORDS)
    parts = []
    for k in range(count):
        phrases = phrases_of(items.where(F.pmod(F.xxhash64("item", "hashes"), F.lit(count)) == k), window)
        if phrases is not None:
            told = found(rows.select("_row", F.col(text_column).alias("text")), phrases, "text").drop("text")
            parts.append(checkpointed(told if not parts else told.where(F.size("spans") > 0)))

    def joined(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [merged(x) for x in column(batch, "spans").to_pylist()]
        return pa.RecordBatch.from_arrays([column(batch, "_row"), column(batch, "n_words"), pa.array(spans, pa.list_(pa.list_(pa.int64()))), column(batch, "items")], ["_row", "n_words", "spans", "items"])

    every = parts[0]
    for p in parts[1:]:
        every = every.transform(united, p)
    met = every.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return rows.join(by_batch(met, f"_row long, {_FOUND}", joined), "_row").drop("_row")


def words_in(spans: str, text: str) -> F.Column:
    """Words in byte ranges of a text."""
    raw = F.col(text).cast("binary")
    # Each range starts and ends with a word, so its words are the runs in it.
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + F.regexp_count(F.substring(raw, (x[0] + 1).cast("int"), (x[1] - x[0]).cast("int")).cast("string"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_column: str = "text") -> DataFrame:
    """docs with the hit words cut out of their texts; all rows and columns stay, texts without hits are untouched."""
    mine = [f"_{k}" for k in range(len(docs.columns))]  # any names that the columns have may stand
    body = mine[docs.columns.index(text_column)]
    out = removal_spans(docs.toDF(*mine), benchmark, window, body)
    raw = F.col(body).cast("binary")
    # What stands between the spans, joined once; spans begin and end with words, so pieces are whole characters.
    upto = lambda k: F.when(k == 0, F.lit(0).cast("long")).otherwise(F.get(F.get(F.col("spans"), k - 1), F.lit(1)))
    kept = F.transform("spans", lambda x, k: F.substring(raw, (upto(k) + 1).cast("int"), (x[0] - upto(k)).cast("int")).cast("string"))
    cut = F.concat(F.array_join(kept, ""), F.substring(raw, (F.element_at(F.element_at("spans", -1), 2) + 1).cast("int"), F.octet_length(body)).cast("string"))
    out = out.withColumn(body, F.when(F.size("spans") > 0, cut).otherwise(F.col(body)))
    return out.select(*(F.col(a).alias(b) for a, b in zip(mine, docs.columns, strict=True)))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removal_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", words_in("spans", "text").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def brute(docs: list[tuple[int, str | None]], items: list[tuple[str, str | None]], window: int = WINDOW) -> list[tuple]:
    """The query's rows, plainly, for tests."""
    phrases: dict[tuple[str, ...], set[str]] = {}
    for name, text in items:
        w = words.of_text(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add(str(name))
    sizes, out = {len(p) for p in phrases}, []
    for doc, text in docs:
        w = words.of_text(text)
        hit, names = [False] * len(w), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in phrases:
                    hit[i : i + n] = [True] * n
                    names |= phrases[p]
        out.append((doc, len(w), sum(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), any(hit)))
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, array_to_string(w[i:i + 9], ' ') AS phrase, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, s.n, item FROM s JOIN p ON s.phrase = p.phrase AND s.n = p.n),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS told FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(told, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""
