"""Operator 8, stupid-backoff scores from n-gram count tables, in joins.

Each word is scored by the longest n-gram up to ORDER that ends in it and that
the counts hold; each order given up costs a factor ALPHA.

left_out_scores() scores a corpus by its own counts less those of the document
itself, so text found nowhere else backs off to single words, and a word of no
other document counts as seen half a time:

1. Documents are cut into slices of some megabytes, written to the shared folder
   in buckets, and not moved again.
2. The distinct n-grams of a slice, added up there, are dealt out by hash: those
   that go to one part of the hash space travel together as arrays. No n-gram is
   hot, as it comes once a slice, and the parts grow in number with the corpus.
3. Where they lie, they explode into rows (key, slice, n), are added up to the
   count table, and joined to it; both read that one exchange and need no other.
   N-grams that no other slice has need no answer.
4. Answers, named by their place in what the slice sent, meet their slice again,
   where what a document has itself is taken off and its words' scores are added
   up.

score_against() scores documents by the count tables of any other corpus
(ngram_counts()), in plain joins.

Sums of left_out_scores() are whole millionths of natural logarithms, rounded
per count, so the result does not depend on the order of addition. N-grams are
64-bit hashes of their words there.

Null and empty texts, and texts without words, have n_words 0 and a null score.
Repeated rows are documents of their own, and count for each other. An empty
table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType

from . import words
from .common import column, shared_folder, slices, table, text_bytes, united

ALPHA = 0.4
MICRO = 1_000_000
ORDER = 3
#: Bytes of text counted together.
SLICE = 9 << 20
#: N-grams of all slices together that are counted in one task, at most and on average.
PART = 2_000_000
ONE, TWO = np.uint64(0x632BE59BD9B4E019), np.uint64(0x9E6C63D0876A9A47)


def micro_log(counts: np.ndarray) -> np.ndarray:
    return np.rint(np.log(counts) * MICRO).astype(np.int64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of some texts: a hash of each word, words of each text; a megabyte at a time."""
    texts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    found = []
    for first, last in slices(texts):
        folded, begins, ends, heads = words.spans(*text_bytes(texts.slice(first, last - first)))
        found.append((words.hashes(folded, begins, ends), np.diff(heads)))
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def grams(h: np.ndarray, of: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n from 1 to order: keys of the n-grams, and the word that each begins at."""
    out, acc = [], h
    for n in range(1, order + 1):
        if n > 1:
            acc = acc[:-1] * words.BASE + h[n - 1 :] * TWO
        at = np.flatnonzero(of[n - 1 :] == of[: len(of) - n + 1]) if len(of) >= n else np.zeros(0, np.int64)
        out.append((words.mixed(acc[at] + np.uint64(int(ONE) * n % (1 << 64))), at))
    return out


def zipped(data: bytes) -> bytes:
    return pa.Codec("zstd", 3).compress(data, asbytes=True)


def unzipped(data: pa.Buffer, size: int) -> bytes:
    return pa.Codec("zstd").decompress(data, size, asbytes=True) if size else b""


def _texts(size: int, data: pa.Buffer, rows: int, lengths: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(unzipped(data, size), np.uint8), np.append(0, np.cumsum(np.frombuffer(unzipped(lengths, 8 * rows), np.int64)))


def slices_of(texts: DataFrame) -> DataFrame:
    """Texts (id, text) a slice to a row: its name, bytes, words, rows, the texts and their lengths, packed, and the ids."""
    kind, id_type = texts.schema["id"].dataType.simpleString(), to_arrow_type(texts.schema["id"].dataType)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = (context.partitionId() if context else 0) << 32
        for batch in batches:
            for first, last in slices(column(batch, "text"), SLICE):
                data, offsets = text_bytes(column(batch, "text").slice(first, last - first))
                ids = pa.ListArray.from_arrays([0, last - first], column(batch, "id").slice(first, last - first).cast(id_type))
                told = [[name], [len(data)], [len(word_hashes(data, offsets)[0])], [last - first]]
                packed = [zipped(data.tobytes()), zipped(np.diff(offsets).tobytes())]
                yield pa.RecordBatch.from_arrays([*map(pa.array, told), *(pa.array([x], pa.binary()) for x in packed), ids], ["slice", "size", "words", "rows", "data", "lengths", "ids"])
                name += 1

    return texts.mapInArrow(cut, f"slice long, size long, words long, rows long, data binary, lengths binary, ids array<{kind}>")


def written(cuts: DataFrame) -> DataFrame:
    """Slices as files in the shared folder, in buckets by name, so that answers travel to them and they stay where they are."""
    spark, name = cuts.sparkSession, f"tallyweave_slices_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts.write.bucketBy(buckets, "slice").option("path", f"{shared_folder(spark)}/{name}").option("compression", "none").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return out


def parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of the hash space, cut evenly, that each key lies in; keys in order are in order of parts."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def placed(keys: np.ndarray, often: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts of keys in order, and the order in which keys are dealt out: by part, those that come once first."""
    part = parts_of(keys, parts)
    return part, np.lexsort((often > 1, part))


def dealt(cuts: DataFrame, order: int, parts: int) -> DataFrame:
    """The distinct n-grams of each slice, dealt out by the part of the hash space that they are in: a row holds those of a slice and a part.

    First those that come once (single), then the others with their counts, 128 * many + few; both in order of keys. A key is
    cut into its upper 16 (top), next 16 (mid) and lower 32 bits (low). In order, top hardly changes from one to the next, so
    the exchange's compression leaves little more than six bytes a key; a row for each would take eleven. Rows are never more
    than n-grams.
    """
    kinds = {"top": np.int16, "mid": np.int16, "low": np.int32, "few": np.int8, "many": np.int32}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, data, rows, lengths in zip(*(column(batch, x) for x in ("slice", "size", "data", "rows", "lengths")), strict=True):
                h, counts = word_hashes(*_texts(size.as_py(), data.as_buffer(), rows.as_py(), lengths.as_buffer()))
                of = np.repeat(np.arange(len(counts)), counts)
                keys, often = np.unique(np.concatenate([k for k, _ in grams(h, of, order)]), return_counts=True)
                part, by = placed(keys, often, parts)
                keys, often = keys[by], often[by]
                told, begins = np.unique(part, return_index=True)
                begins, above = np.append(begins, len(keys)), np.append(0, np.cumsum(often > 1))
                for first in range(0, len(told), 64):
                    bounds = begins[first : first + 65]
                    here = slice(int(bounds[0]), int(bounds[-1]))
                    k, n = keys[here], often[here][often[here] > 1]
                    values = (k >> np.uint64(48), k >> np.uint64(32), k, n & 127, n >> 7)
                    at = [x - x[0] for x in (bounds, bounds, bounds, above[bounds], above[bounds])]
                    lists = [pa.ListArray.from_arrays(pa.array(a, pa.int32()), pa.array(v.astype(kind))) for a, v, kind in zip(at, values, kinds.values(), strict=True)]
                    single = pa.array(np.diff(at[0]) - np.diff(at[3]), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(told[first : first + 64], pa.int32()), pa.array(np.full(len(single), name.as_py(), np.int64)), single, *lists], ["part", "slice", "single", *kinds])

    schema = "part int, slice long, single int, top array<smallint>, mid array<smallint>, low array<int>, few array<tinyint>, many array<int>"
    return cuts.select("slice", "size", "rows", "data", "lengths").mapInArrow(run, schema).repartitionById(parts, "part")


def exploded(runs: DataFrame) -> DataFrame:
    """A row (part, slice, at, key, n) for each distinct n-gram of each slice, where dealt() put it; at is its place in the part's run."""
    wide = lambda name, bits: F.get(name, "at").cast("long").bitwiseAND((1 << bits) - 1)
    key = F.shiftleft(wide("top", 16), 48).bitwiseOR(F.shiftleft(wide("mid", 16), 32)).bitwiseOR(F.col("low_bits").cast("long").bitwiseAND((1 << 32) - 1))
    after = F.col("at") - F.col("single")
    n = F.coalesce(F.get("few", after) + F.get("many", after).cast("long") * 128, F.lit(1))
    return runs.select("part", "slice", "single", "top", "mid", "few", "many", F.posexplode("low").alias("at", "low_bits")).select("part", "slice", "at", key.alias("key"), n.alias("n"))


@F.arrow_udf(BinaryType())
def packed(answers: pa.Array) -> pa.Array:
    """Answers (at, elsewhere) of a run, in any order: those in order of at, as bytes by significance, zipped."""

    def one(answer: pa.StructArray) -> bytes:
        at, elsewhere = (answer.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("at", "elsewhere"))
        by = np.argsort(at)
        return zipped(np.concatenate([np.diff(at[by], prepend=0), elsewhere[by]]).view(np.uint8).reshape(-1, 8).T.tobytes())

    return pa.array([one(x.values) for x in answers], pa.binary())


def unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """at and elsewhere of n answers."""
    both = np.ascontiguousarray(np.frombuffer(unzipped(pa.py_buffer(data), 16 * n), np.uint8).reshape(8, -1).T).view(np.int64).ravel()
    return np.cumsum(both[:n]), both[n:]


def left_out_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_words, micro_log (millionths, of the product of all words' scores) and score (mean log per word) for every row of docs."""
    kind, id_type = docs.schema[id_column].dataType.simpleString(), to_arrow_type(docs.schema[id_column].dataType)
    cuts = written(slices_of(docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))))
    total = cuts.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]

    parts = total * order // PART + 1
    rows = exploded(dealt(cuts, order, parts))
    # Sums, and the first and last slice that has the n-gram; both sides of the join read the same exchange, and lie as it dealt them.
    counts = rows.groupBy("key", "part").agg(F.sum("n").alias("total"), F.min("slice").alias("first"), F.max("slice").alias("last")).where("first < last")
    found = rows.join(counts.hint("shuffle_hash"), ["key", "part"]).select("slice", "part", F.struct("at", (F.col("total") - F.col("n")).alias("elsewhere")).alias("answer"))
    told = found.groupBy("slice", "part").agg(F.collect_list("answer").alias("answers"))
    answers = told.select("slice", "part", F.size("answers").alias("n"), packed("answers").alias("packed"))

    def score(own: pa.Table, answers: pa.Table) -> pa.Table:
        held, ids = own.drop_columns(["ids"]).to_pylist()[0], own["ids"].combine_chunks()[0].values.cast(id_type)
        h, counts = word_hashes(*_texts(held["size"], pa.py_buffer(held["data"]), held["rows"], pa.py_buffer(held["lengths"])))
        of = np.repeat(np.arange(len(counts)), counts)
        found, heads = zip(*grams(h, of, order), strict=True)
        keys = np.concatenate(found)
        del found
        # As np.unique(keys, return_inverse=True), in half its memory.
        by, new, all_at = np.argsort(keys), np.ones(len(keys), bool), np.empty(len(keys), np.int64)
        keys = keys[by]
        new[1:] = keys[1:] != keys[:-1]
        distinct, all_at[by] = keys[new], np.cumsum(new) - 1
        del keys, by, new
        many, totals = len(distinct), np.bincount(all_at, minlength=len(distinct))
        part, by = placed(distinct, totals, parts)
        begins = np.searchsorted(part, answers["part"].to_numpy())
        del part
        for first, n, data in zip(begins, answers["n"].to_pylist(), answers["packed"], strict=True):
            at, elsewhere = unpacked(data.as_py(), n)
            totals[by[first + at]] += elsewhere
        del by
        # What other documents have of the n-gram that begins at each word; 0 where none does.
        others, done = np.zeros((order, len(h)), np.int64), 0
        for n, at in enumerate(heads):
            mine = all_at[done : done + len(at)]
            done += len(at)
            _, pair, own = np.unique(of[at] * many + mine, return_inverse=True, return_counts=True)
            others[n, at] = totals[mine] - own[pair]
        rest = np.maximum(total - counts, 1)
        value = np.where(others[0] > 0, micro_log(np.maximum(others[0], 1)), half) - micro_log(rest)[of]
        for n in range(1, order):
            # The n-gram that ends in a word begins n words before; words with fewer before them have no such order to give up.
            top, under = others[n, : len(h) - n], others[n - 1, : len(h) - n]
            seen = micro_log(np.maximum(top, 1)) - micro_log(np.maximum(under, 1))
            has = of[n:] == of[: len(h) - n] if len(h) > n else np.zeros(0, bool)
            if len(h) > n:
                value[n:] = np.where(has, np.where(top > 0, seen, value[n:] + give_up), value[n:])
        sums = np.bincount(of, value, len(counts)).astype(np.int64) if len(h) else np.zeros(len(counts), np.int64)
        return pa.Table.from_arrays([ids, pa.array(counts), pa.array(sums)], ["id", "n_words", "micro"])

    half, give_up = round(math.log(0.5) * MICRO), round(math.log(alpha) * MICRO)
    whole = cuts.select("slice", "size", "rows", "data", "lengths", "ids")
    out = whole.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(score, f"id {kind}, n_words long, micro long")
    return out.select(
        F.col("id").alias(id_column), "n_words", F.when(F.col("n_words") > 0, F.col("micro")).alias("micro_log"), F.when(F.col("n_words") > 0, F.col("micro") / F.col("n_words") / MICRO).alias("score")
    )


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def ngram_counts(docs: DataFrame, order: int = 2, text_column: str = "text") -> DataFrame:
    """(n, gram, count) of all n-grams up to an order: the count tables."""
    w = docs.select(word_array(F.col(text_column)).alias("w"))
    exploded = [w.select(F.lit(n).alias("n"), F.explode(_windows(F.col("w"), n)).alias("gram")) for n in range(1, order + 1)]
    out = exploded[0]
    for e in exploded[1:]:
        out = out.transform(united, e)
    return out.groupBy("n", "gram").agg(F.count("*").alias("count"))


def _windows(w: Column, n: int) -> Column:
    whole = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
    return F.when(F.size(w) >= n, whole).otherwise(F.array().cast("array<string>"))


def score_against(docs: DataFrame, counts: DataFrame, order: int = 2, alpha: float = ALPHA, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, score): mean log stupid-backoff score of each document's words, against the count tables.

    A word that no table has counts as seen half a time.
    """
    total = counts.where("n = 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
    w = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_column).alias("_id"), word_array(F.col(text_column)).alias("w"))
    at = w.select("_row", "_id", F.posexplode_outer("w").alias("i", "word"), "w").withColumn("_at", F.col("i"))
    rows = at.select("_row", "_id", "_at", *(F.when(F.col("i") >= n - 1, F.array_join(F.slice("w", F.col("i") - n + 2, F.lit(n)), " ")).alias(f"g{n}") for n in range(1, order + 1)),
                     *(F.when(F.col("i") >= n, F.array_join(F.slice("w", F.col("i") - n + 1, F.lit(n)), " ")).alias(f"c{n}") for n in range(1, order)))
    for n in range(1, order + 1):
        own = counts.where(F.col("n") == n)
        rows = rows.join(own.select(F.col("gram").alias(f"g{n}"), F.col("count").alias(f"ng{n}")), f"g{n}", "left")
        if n < order:
            rows = rows.join(own.select(F.col("gram").alias(f"c{n}"), F.col("count").alias(f"nc{n}")), f"c{n}", "left")
    rows = rows.crossJoin(F.broadcast(total))  # one row
    value = F.log(F.coalesce("ng1", F.lit(0.5)) / F.greatest("total", F.lit(1)))
    for n in range(2, order + 1):
        value = F.when(F.col(f"ng{n}").isNotNull(), F.log(F.col(f"ng{n}") / F.col(f"nc{n - 1}"))).otherwise(F.when(F.col("_at") >= n - 1, F.lit(math.log(alpha))).otherwise(0.0) + value)
    found = rows.groupBy("_row").agg(F.max("_id").alias(id_column), F.count("_at").alias("n_words"), F.avg(F.when(F.col("_at").isNotNull(), value)).alias("score"))
    return found.select(id_column, "n_words", "score")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return left_out_scores(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "micro_log")


#: Trigrams, bigrams, words: what other documents have of each n-gram and of what stands before its last word.
ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
u AS (SELECT doc_id, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
x AS (SELECT doc_id, n, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS c FROM u),
g AS (SELECT doc_id, i, n, a AS g1, b || ' ' || a AS g2, c || ' ' || b || ' ' || a AS g3, b AS c1, c || ' ' || b AS c2 FROM x),
own AS (SELECT doc_id, g1 AS g, count(*) AS k FROM g GROUP BY ALL UNION ALL SELECT doc_id, g2, count(*) FROM g WHERE g2 IS NOT NULL GROUP BY ALL UNION ALL SELECT doc_id, g3, count(*) FROM g WHERE g3 IS NOT NULL GROUP BY ALL),
whole AS (SELECT g, sum(k) AS k FROM own GROUP BY g),
o AS (SELECT doc_id, g, whole.k - own.k AS k FROM own JOIN whole USING (g)),
t AS (SELECT count(*) AS t FROM x),
m AS (SELECT g.doc_id, i, n, o1.k AS k1, o2.k AS k2, o3.k AS k3, p1.k AS j1, p2.k AS j2 FROM g JOIN o o1 ON o1.doc_id = g.doc_id AND o1.g = g1 LEFT JOIN o o2 ON o2.doc_id = g.doc_id AND o2.g = g2 LEFT JOIN o o3 ON o3.doc_id = g.doc_id AND o3.g = g3
LEFT JOIN o p1 ON p1.doc_id = g.doc_id AND p1.g = c1 LEFT JOIN o p2 ON p2.doc_id = g.doc_id AND p2.g = c2),
s AS (SELECT doc_id, sum(CASE WHEN k3 > 0 THEN CAST(round(ln(k3) * {MICRO}) AS BIGINT) - CAST(round(ln(j2) * {MICRO}) AS BIGINT)
WHEN k2 > 0 THEN CASE WHEN i > 2 THEN 1 ELSE 0 END * CAST(round(ln({ALPHA}) * {MICRO}) AS BIGINT) + CAST(round(ln(k2) * {MICRO}) AS BIGINT) - CAST(round(ln(j1) * {MICRO}) AS BIGINT)
ELSE least(i - 1, 2) * CAST(round(ln({ALPHA}) * {MICRO}) AS BIGINT) + CAST(round(ln(CASE WHEN k1 > 0 THEN k1 ELSE 0.5 END) * {MICRO}) AS BIGINT) - CAST(round(ln(greatest(t - n, 1)) * {MICRO}) AS BIGINT) END) AS x FROM m, t GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, CAST(s.x AS BIGINT) AS micro_log FROM d LEFT JOIN s ON d.doc_id = s.doc_id"""
