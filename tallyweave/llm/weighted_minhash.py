"""Operator 5, near duplicates: consistent weighted sampling over TF-IDF shingles.

A document is its weighted set of shingles of five consecutive words (fewer
words: one shingle of all). A weight is the number of times that the shingle
occurs in the document times its inverse document frequency over all documents.
Document frequencies under FLOOR of all documents count as FLOOR, at every size,
so the frequent shingles alone need exact counts.

1. One pass fills a sketch of fixed size (two rows of counters, the lesser
   counts), whose counters the driver gets; no frequency is above its counter. A
   second pass counts the shingles whose counters are above the floor, exactly;
   the driver gets those that are frequent: on average shingles a document over
   FLOOR at most.
2. One pass signs each text: improved consistent weighted sampling draws SAMPLES
   samples, ROWS of them make a band. Equal texts are one class with one
   representative from here on, so copies cost a row each.
3. Representatives that share a band meet in a task and are verified by their
   exact weighted Jaccard similarity, unless they are linked already: a group of
   copies takes as many comparisons as members. A band with more than CHUNK is
   split into chunks that each hold the band's least document too; those not
   linked to it there are then compared with every other chunk.
4. Links, as each task's stars, become components, labelled by the least id.

Null texts and null ids stand alone; texts without words are alike if equal.
Rows that repeat an id are that one document. Empty tables give empty results.
Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import by_batch, checkpointed, column, slices, table, text_bytes, united
from .groups import by_group, components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 10, 3
SAMPLES = BANDS * ROWS
FLOOR = 0.03
#: Counters of a row of the sketch, and in how many parts they travel.
BUCKETS, PARTS = 1 << 19, 32
CHUNK = 1000


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: 32-bit shingles, distinct and ascending in each text; times each occurs; where each text's begin, with the end."""
    folded, begins, ends, heads = words.spans(data, offsets)
    h = words.hashes(folded, begins, ends)
    counts = np.diff(heads)
    n = len(counts)
    of = np.repeat(np.arange(n), counts)
    mixed = np.zeros(len(h), np.uint64)
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    left = np.repeat(heads[1:], counts) - np.arange(len(h))  # words from here to the end of the text
    for j in range(size):
        mixed = mixed * words.BASE + np.where(left > j, padded[j : j + len(h)], 0)
    # A window that runs over the end counts only where the whole text is shorter than a window.
    full = (left >= size) | ((np.arange(len(h)) == np.repeat(heads[:-1], counts)) & (left < size))
    key = np.sort(of[full].astype(np.uint64) << np.uint64(32) | words.mixed(mixed[full]) >> np.uint64(32))
    if not len(key):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    key, times = key[first], np.diff(np.append(first, len(key)))
    return key.astype(np.uint32), times, np.searchsorted(key, np.arange(n + 1).astype(np.uint64) << np.uint64(32))


def buckets(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counters of a shingle in both rows."""
    a = (ids * np.uint32(0x9E3779B1)) >> np.uint32(13)
    b = ((ids ^ (ids >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(13)
    return a, b


@dataclass(frozen=True)
class Frequencies:
    """Exact document frequencies above the floor: shingles, ascending, with their counts."""

    documents: int
    floor: float
    names: np.ndarray
    counts: np.ndarray

    def idf(self, ids: np.ndarray) -> np.ndarray:
        df = np.full(len(ids), self.floor)
        if len(self.names):
            at = np.minimum(np.searchsorted(self.names, ids), len(self.names) - 1)
            df = np.where(self.names[at] == ids, self.counts[at], self.floor)
        return 1 + np.log(max(self.documents, 1) / df)


def frequencies(texts: DataFrame) -> Frequencies:
    """Of texts (id, text): a sketch proposes, a second pass counts."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = np.zeros((2, BUCKETS), np.int64), 0
        for batch in batches:
            texts = column(batch, "text")
            for first, last in slices(texts):
                ids, _, _ = shingles(*text_bytes(texts.slice(first, last - first)))
                for row, where in zip(rows, buckets(ids), strict=True):
                    row += np.bincount(where, minlength=BUCKETS)
            n += batch.num_rows
        if n:
            context = TaskContext.get()
            task = context.partitionId() if context else 0
            parts = rows.reshape(2 * PARTS, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(2 * PARTS)), pa.array(np.full(2 * PARTS, task % 64)), pa.array(np.full(2 * PARTS, n)), pa.array([p.astype("<i4" if n < 1 << 31 else "<i8").tobytes() for p in parts], pa.binary())],
                ["part", "salt", "documents", "counts"],
            )

    def add(t: pa.Table) -> pa.RecordBatch:
        total = np.zeros(BUCKETS // PARTS, np.int64)
        for x in t["counts"].to_pylist():
            total += np.frombuffer(x, "<i4" if len(x) == 4 * len(total) else "<i8")
        return pa.RecordBatch.from_arrays([t["part"][:1].combine_chunks(), pa.array([0]), pa.array([int(np.sum(t["documents"].to_numpy()))]), pa.array([total.astype("<i8").tobytes()], pa.binary())], ["part", "salt", "documents", "counts"])

    schema = "part long, salt long, documents long, counts binary"
    sums = by_group(by_group(texts.mapInArrow(fill, schema), ["part", "salt"], schema, add), ["part"], schema, add).toPandas().sort_values("part")
    if not len(sums):
        return Frequencies(0, 1.0, np.zeros(0, np.uint32), np.zeros(0))
    rows = np.concatenate([np.frombuffer(x, "<i8") for x in sums.counts]).reshape(2, -1)
    documents = int(sums.documents.iloc[0])
    floor = max(1.0, FLOOR * documents)
    held = texts.sparkSession.sparkContext.broadcast(rows > floor)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = []
        for first, last in slices(column(batch, "text")):
            ids, _, _ = shingles(*text_bytes(column(batch, "text").slice(first, last - first)))
            a, b = buckets(ids)
            own.append(ids[held.value[0][a] & held.value[1][b]])
        names, n = np.unique(np.concatenate([np.zeros(0, np.uint32), *own]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(n)], ["name", "n"])

    frequent = by_batch(texts.select("text"), "name long, n long", count).groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") > floor).orderBy("name").toPandas()
    return Frequencies(documents, floor, frequent["name"].to_numpy().astype(np.uint32), frequent["n"].to_numpy(np.float64))


@lru_cache(1)
def draws() -> tuple[np.ndarray, ...]:
    """r, 1 / r, beta and log c of consistent weighted sampling, for 16 bits of a hash each."""
    g = np.random.default_rng(5)
    r = g.gamma(2, 1, 1 << 16)
    return tuple(x.astype(np.float32) for x in (r, 1 / r, g.random(1 << 16), np.log(g.gamma(2, 1, 1 << 16))))


def samples(ids: np.ndarray, weights: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """SAMPLES 32-bit samples of each text that has shingles; texts agree in each with their weighted Jaccard similarity."""
    r, inverse, beta, log_c = draws()
    log_w = np.log(weights).astype(np.float32)
    firsts = heads[:-1][np.diff(heads) > 0]
    out = np.empty((len(firsts), SAMPLES), np.uint32)
    for k in range(SAMPLES):
        h = ids * np.uint32((0x9E3779B1 + 0x3C6EF372 * k) & 0xFFFFFFFF | 1) + np.uint32((0xC2B2AE35 * (k + 1)) & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        at = h >> np.uint32(16)
        b, step = beta[at], r[at]
        t = np.floor(log_w * inverse[at] + b)
        score = (log_c[at] - step * (t - b + 1)).view(np.int32)
        # Floats as numbers that sort alike, then which sample it is.
        order = np.where(score < 0, ~score, score ^ np.int32(-(2**31))).view(np.uint32)
        name = (ids ^ h) * np.uint32(0x297A2D39) + t.astype(np.int32).view(np.uint32) * np.uint32(0x85EBCA77)
        out[:, k] = np.minimum.reduceat(order.astype(np.uint64) << np.uint64(32) | name, firsts).astype(np.uint32)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.zeros((len(signatures), 1), np.uint64)
        for j in range(ROWS):
            key = words.mixed(key * words.BASE + signatures[:, j::ROWS].astype(np.uint64) + np.uint64(1))
    return key.view(np.int64)


class Group:
    """Weighted sets that met, and which of them are linked."""

    def __init__(self, ids: list[np.ndarray], weights: list[np.ndarray]):
        self.ids, self.weights = ids, weights
        self.total = np.array([w.sum() for w in weights])
        self.root = np.arange(len(ids))

    def similar(self, i: int, others: np.ndarray, least: float) -> np.ndarray:
        """Those of others that are at least so similar to i."""
        small, large = np.minimum(self.total[others], self.total[i]), np.maximum(self.total[others], self.total[i])
        others = others[small >= least * large]
        if not len(others):
            return others
        sizes = np.array([len(self.ids[j]) for j in others])
        ids, w = np.concatenate([self.ids[j] for j in others]), np.concatenate([self.weights[j] for j in others])
        at = np.minimum(np.searchsorted(self.ids[i], ids), len(self.ids[i]) - 1)
        both = np.where(self.ids[i][at] == ids, np.minimum(self.weights[i][at], w), 0.0)
        common = np.add.reduceat(both, np.cumsum(sizes) - sizes)
        return others[common >= least * (self.total[others] + self.total[i] - common) - 1e-9]

    def link(self, i: int, found: np.ndarray) -> None:
        roots = np.unique(self.root[np.append(found, i)])
        self.root[np.isin(self.root, roots)] = roots[0]


_PAYLOAD = "band long, chunk int, block int, id long, own boolean, leader long, ids binary, times binary"


def _payload(texts: DataFrame, seats: DataFrame) -> DataFrame:
    """A row of shingles for each seat of a document: the only place where texts meet their seats."""
    wanted = seats.groupBy("id").agg(F.collect_list(F.struct("band", "chunk", "block", "own", "leader")).alias("seats"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text")
            for first, last in slices(texts):
                names = column(batch, "id").slice(first, last - first).to_pylist()
                places = column(batch, "seats").slice(first, last - first).to_pylist()
                ids, times, heads = shingles(*text_bytes(texts.slice(first, last - first)))
                out: list[tuple] = []
                for k, name in enumerate(names):
                    a, b = heads[k], heads[k + 1]
                    told, often = ids[a:b].tobytes(), times[a:b]
                    often = often.astype(np.uint16 if often.max() < 1 << 16 else np.uint32).tobytes() if (often > 1).any() else b""
                    out += [(s["band"], s["chunk"], s["block"], name, s["own"], s["leader"], told, often) for s in places[k]]
                    if len(out) > 2000:
                        yield _batch(out)
                        out = []
                if out:
                    yield _batch(out)

    return texts.join(wanted, "id").mapInArrow(run, _PAYLOAD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["band", "chunk", "block", "id", "own", "leader", "ids", "times"])


def _met(t: pa.Table, frequency: Frequencies) -> tuple[np.ndarray, np.ndarray, Group]:
    t = t.sort_by("id")
    ids = [np.frombuffer(x, np.uint32) for x in t["ids"].to_pylist()]
    # Two bytes a count, four where a count needs them, none where each is 1.
    times = [np.frombuffer(x, np.uint16 if len(x) == 2 * len(i) else np.uint32) if x else 1 for i, x in zip(ids, t["times"].to_pylist(), strict=True)]
    return t["id"].to_numpy(), t["own"].to_numpy(), Group(ids, [frequency.idf(i) * n for i, n in zip(ids, times, strict=True)])


def similar_pairs(texts: DataFrame, classes: DataFrame, frequency: Frequencies, least: float, chunk: int = CHUNK) -> DataFrame:
    """Stars of links (a, b) among the representatives, from classes (id, bands) and their texts (id, text)."""
    passes = classes.select("id", F.explode("bands").alias("band"))
    met = passes.groupBy("band").agg(F.count("*").alias("m"), F.min("id").alias("least")).where("m > 1")
    met = met.withColumn("chunks", F.ceil(F.col("m") / chunk).cast("int"))
    placed = passes.join(met, "band").withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int"))
    seats = checkpointed(placed.select("band", "chunk", "chunks", F.lit(0).alias("block"), "id", F.lit(True).alias("own"), F.when(F.col("chunks") > 1, F.col("least")).alias("leader")))
    guests = met.where("chunks > 1").select("band", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "chunks", F.lit(0).alias("block"), F.col("least").alias("id"), F.lit(False).alias("own"), F.col("least").alias("leader"))
    guests = guests.where(F.col("chunk") != F.pmod(F.xxhash64("id"), "chunks"))
    held = texts.sparkSession.sparkContext.broadcast(frequency)

    def meet(t: pa.Table) -> pa.RecordBatch | None:
        leader = t["leader"][0].as_py()
        names, own, group = _met(t, held.value)
        for i in range(len(names)):
            rest = np.flatnonzero((np.arange(len(names)) > i) & (group.root != group.root[i]))
            found = group.similar(i, rest, least)
            if len(found):
                group.link(i, found)
        roots = names[group.root]
        alone = np.zeros(len(names), bool) if leader is None else own & (group.root != group.root[int(np.searchsorted(names, leader))])
        on = (roots != names) | alone
        if not on.any():
            return None
        n = int(on.sum())
        return pa.RecordBatch.from_arrays([pa.array(names[on]), pa.array(roots[on]), pa.array([t["band"][0].as_py()] * n, pa.int64()), pa.array([t["chunk"][0].as_py()] * n, pa.int32()), pa.array(alone[on])], ["a", "b", "band", "chunk", "alone"])

    first = checkpointed(by_group(_payload(texts, seats.transform(united, guests)), ["band", "chunk", "block"], "a long, b long, band long, chunk int, alone boolean", meet))
    links = first.where("a <> b").select("a", "b")
    alone = first.where("alone").select(F.col("a").alias("id"), "band", F.col("chunk").alias("home"))
    if alone.isEmpty():
        return links
    # Blocks of strays bound what meets a chunk at a time.
    blocks = alone.groupBy("band").agg(F.ceil(F.count("*") / chunk).cast("int").alias("blocks"))
    strays = alone.join(blocks, "band").withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), "blocks").cast("int"))
    large = met.where("chunks > 1").select("band", "chunks").join(blocks, "band")
    visits = strays.join(large.select("band", "chunks"), "band").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("chunk <> home")
    hosts = seats.join(large.select("band", "blocks"), "band").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["band", "chunk", "block", "id", "own", "leader"]
    again = visits.withColumns({"own": F.lit(False), "leader": F.lit(None).cast("long")}).select(columns).transform(united, hosts.select(columns))

    def visit(t: pa.Table) -> pa.RecordBatch | None:
        names, own, group = _met(t, held.value)
        hosts = np.flatnonzero(own)
        for i in np.flatnonzero(~own).tolist():
            found = group.similar(i, hosts[group.root[hosts] != group.root[i]], least)
            if len(found):
                group.link(i, found)
        roots = names[group.root]
        on = roots != names
        return pa.RecordBatch.from_arrays([pa.array(names[on]), pa.array(roots[on])], ["a", "b"]) if on.any() else None

    return links.transform(united, by_group(_payload(texts, again), ["band", "chunk", "block"], "a long, b long", visit))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK) -> DataFrame:
    """id, class_id (the least id of the group) and kept (it is that one) for every row of docs."""
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    usable = texts.where("id IS NOT NULL AND text IS NOT NULL")
    frequency = frequencies(usable)
    held = docs.sparkSession.sparkContext.broadcast(frequency)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = column(batch, "text"), [[] for _ in range(batch.num_rows)]
            for first, last in slices(texts, 1 << 19):
                ids, times, heads = shingles(*text_bytes(texts.slice(first, last - first)))
                on = np.flatnonzero(np.diff(heads))
                if len(on):
                    bands = band_keys(samples(ids, held.value.idf(ids) * times, heads))
                    for i, b in zip((on + first).tolist(), bands, strict=True):
                        keys[i] = b
            yield pa.RecordBatch.from_arrays([column(batch, x) for x in ("id", "h1", "h2")] + [pa.array(keys, pa.list_(pa.int64()))], ["id", "h1", "h2", "bands"])

    hashed = usable.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    signed = checkpointed(hashed.mapInArrow(sign, "id long, h1 long, h2 long, bands array<long>"))
    classes = checkpointed(signed.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.any_value("bands").alias("bands")))
    pairs = checkpointed(similar_pairs(usable, classes.select("id", "bands"), frequency, least, chunk))
    merged = components(pairs).withColumnRenamed("node", "id")
    labelled = classes.select("h1", "h2", "id").join(merged, "id", "left").select("h1", "h2", F.coalesce("component", "id").alias("component"))
    found = signed.select("id", "h1", "h2").join(labelled, ["h1", "h2"]).select("id", F.col("component").alias("class_id"))
    others = texts.where("id IS NULL OR text IS NULL").select("id", F.col("id").alias("class_id"))
    return found.transform(united, others).withColumn("kept", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True))).withColumnRenamed("id", id_column)


def without_near_duplicates(docs: DataFrame, least: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with one document of each group, with all columns; rows of a kept id all stay, however often it occurs, and so do those without an id."""
    dropped = near_duplicates(docs, least, id_column, text_column).where("NOT kept").select(F.col(id_column).alias("_gone")).distinct()
    return docs.join(dropped, docs[id_column] == dropped["_gone"], "left_anti")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, and what each document reaches.
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
t AS (SELECT doc_id, g, count(*) AS tf FROM s GROUP BY ALL),
f AS (SELECT g, 1 + ln(n / greatest(count(*), 1, {FLOOR} * n)) AS idf FROM t, (SELECT count(*) AS n FROM d) GROUP BY g, n),
x AS (SELECT doc_id, g, tf * idf AS weight FROM t JOIN f USING (g)),
total AS (SELECT doc_id, sum(weight) AS weight FROM x GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.weight, b.weight)) AS common FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM p JOIN total u ON u.doc_id = a JOIN total v ON v.doc_id = b WHERE common >= {SIMILARITY} * (u.weight + v.weight - common) - 1e-9 UNION SELECT a.doc_id, b.doc_id FROM d a JOIN d b ON a.text = b.text AND a.doc_id < b.doc_id),
l AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a)
SELECT doc_id, class_id, doc_id = class_id AS kept FROM documents JOIN c USING (doc_id)"""
