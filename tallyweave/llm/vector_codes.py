"""Operator 13, product codes of vectors, with nearest entries found by annular norm pruning.

Vectors become integers floor(4096 x) and are cut into PARTS equal parts; each
part position has a codebook that starts as that part of the first vectors and
is moved ROUNDS times to the floors of its members' means.

An entry can only be as near as the best one so far if its norm differs from the
part's by no more than that distance. So the entries of a codebook are sorted by
norm; each part evaluates the two entries next to it in norm, exactly, in
integers; a binary search gives the annulus of norms that the best distance so
far allows, both ends included, and so on with the next two inside it until the
annulus holds nothing more. Ties go to the lower index.

A round is a pass over the vectors: each task sends one row an entry, the count
and the sums of its members, and what reaches the driver is a row for each entry
of each codebook and component, whatever the number of vectors. The last pass writes a narrow row a vector. The errors of a label
are added up in tasks first; labels with more than a 512th of all rows, at most
512 of them, are broadcast and the others joined by a shuffle, so that no key of
that holds more.

Rows whose vector is null or holds null or non-finite components are dropped.
Components beyond a vector's end count as zero: the length is that of the
longest vector kept, rounded up to a multiple of PARTS. Null ids are coded but
start no codebook; where a starting id repeats, its least vector stands for it.
With fewer than ENTRIES ids a codebook has as many entries. Repeated rows count
as often as they stand. Components are exact whatever their size: beyond what 64
bits hold for a distance the same steps run in Python's integers, and an error of
more than 38 digits (the query: than a long holds) is null and adds nothing. An
empty table gives an empty one. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, column, table, united

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Labels that hold more than one row in so many are joined by a broadcast.
OFTEN = 512
#: Sums of components, of 1036 bits and as many as there are rows, travel as longs of so many bits, so many at most; half a million tasks do not overflow one.
LIMB, LIMBS = 44, 25
#: Vectors worked on together.
TOGETHER = 4096


def quantised(vectors: pa.Array, size: int) -> np.ndarray:
    """The integers of vectors that hold only finite numbers, a row each; Python's integers if they are very large."""
    lengths = np.asarray(vectors.value_lengths().fill_null(0))
    flat = np.asarray(vectors.flatten()).astype(np.float64)
    limit = np.abs(flat).max(initial=0.0) * SCALE
    out = np.zeros((len(vectors), size), np.int64)
    # A distance is a sum of size / PARTS squares of differences of two such numbers.
    if limit >= 2.0**28 / max(1.0, size / PARTS) ** 0.5:
        out = out.astype(object)
        flat = np.array([int(x) * SCALE if abs(x) >= 2.0**60 else math.floor(x * SCALE) for x in flat.tolist()], dtype=object)
    else:
        flat = np.floor(flat * SCALE).astype(np.int64)
    row = np.repeat(np.arange(len(vectors)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


@dataclass(frozen=True)
class Codebook:
    """The entries of one part position."""

    entries: np.ndarray

    @cached_property
    def by_norm(self) -> tuple[np.ndarray, np.ndarray]:
        """The entries' places in order of norm, and the norms."""
        norms = _norms(self.entries)
        order = np.argsort(norms, kind="stable")
        return order, norms[order]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each part its entry and squared distance; how many distances were evaluated."""
        if len(parts) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        if parts.dtype == object or self.entries.dtype == object:
            parts = parts.astype(object)
        order, norms = self.by_norm
        own, kind = _norms(parts), parts.dtype
        code, best = np.full(len(parts), len(norms)), np.zeros(len(parts), kind)
        # What is evaluated lies from below up to above; the entries beside it in norm come next.
        below = np.searchsorted(norms, own)
        above, rows, evaluated = below.copy(), np.arange(len(parts)), 0
        low, high = np.zeros(len(parts), np.int64), np.full(len(parts), len(norms))
        while len(rows):
            for side, there in ((below, below[rows] > low[rows]), (above, above[rows] < high[rows])):
                mine = rows[there]
                side[mine] -= side is below
                entry = order[side[mine]]
                told = _distances(parts[mine], self.entries[entry])
                better = (code[mine] == len(norms)) | (told < best[mine]) | ((told == best[mine]) & (entry < code[mine]))
                best[mine[better]], code[mine[better]] = told[better], entry[better]
                side[mine] += side is above
                evaluated += len(mine)
            reach = _roots(best[rows])
            # Both ends are inclusive: what rounding may take off the norms and the distance is added.
            slack = 2 if kind == object else (own[rows] + reach + 1) * 1e-12
            low[rows], high[rows] = np.searchsorted(norms, own[rows] - reach - slack, "left"), np.searchsorted(norms, own[rows] + reach + slack, "right")
            rows = rows[(below[rows] > low[rows]) | (above[rows] < high[rows])]
        return code, best, evaluated


def _roots(squares: np.ndarray) -> np.ndarray:
    """Square roots, of Python's integers rounded down."""
    return np.array([math.isqrt(x) for x in squares.tolist()], dtype=object) if squares.dtype == object else np.sqrt(squares.astype(np.float64))


def _norms(parts: np.ndarray) -> np.ndarray:
    return _roots((parts * parts).sum(1)) if parts.shape[1] else np.zeros(len(parts))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    apart = a - b
    return (apart * apart).sum(1) if a.shape[1] else np.zeros(len(a), np.int64)


def usable(vectors: DataFrame, vector_column: str = "embedding") -> DataFrame:
    """The rows whose vector is there and holds finite numbers alone."""
    good = F.forall(vector_column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col(vector_column).isNotNull() & good)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for first in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(first, TOGETHER)
            yield part, quantised(column(part, "vector"), size)


def started(rows: DataFrame, size: int) -> list[Codebook]:
    """The codebooks before the first round, of rows (id, vector)."""
    ids = rows.where("id IS NOT NULL").select("id").distinct().orderBy("id").limit(ENTRIES)
    # At most ENTRIES ids; the least vector of each is found where the rows lie.
    chosen = rows.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("vector").alias("vector")).orderBy("id").collect()
    if not chosen:
        return []
    kind = pa.list_(pa.float64())
    held = quantised(pa.array([list(r["vector"]) for r in chosen], kind), size)
    return [Codebook(p) for p in np.split(held, PARTS, axis=1)]


def _limbs(x: int) -> list[tuple[int, int]]:
    """An integer as summands of LIMB bits, with their places; those that are zero are left out."""
    sign, rest = (-1 if x < 0 else 1), abs(x)
    return [(k, sign * own) for k in range(-(-rest.bit_length() // LIMB)) if (own := (rest >> (k * LIMB)) & ((1 << LIMB) - 1))]


def moved(rows: DataFrame, books: list[Codebook], size: int) -> list[Codebook]:
    """The codebooks after a round over rows (id, vector)."""
    width = size // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [[0] * len(b.entries) for b in books]
        sums = [np.zeros((len(b.entries), width), object) for b in books]
        for _, held in _blocks(batches, size):
            for k, (book, part) in enumerate(zip(books, np.split(held, PARTS, axis=1), strict=True)):
                code, _, _ = book.nearest(part)
                for e in np.unique(code).tolist():
                    own = part[code == e]
                    counts[k][e] += len(own)
                    sums[k][e] += own.sum(0).astype(object)
        # Place 0 has the count, the others have the limbs of the sums.
        told = [(k, e, 0, n) for k, own in enumerate(counts) for e, n in enumerate(own) if n]
        told += [(k, e, 1 + c * LIMBS + at, limb) for k, e, _, _ in list(told) for c, x in enumerate(sums[k][e]) for at, limb in _limbs(int(x))]
        if told:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*told, strict=True)], ["part", "entry", "place", "n"])

    found = rows.select("vector").mapInArrow(run, "part long, entry long, place long, n long").groupBy("part", "entry", "place").agg(F.sum("n").alias("n")).collect()
    total: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
    for r in found:
        n, sums = total.setdefault((r["part"], r["entry"]), ([0], [0] * width))
        if r["place"]:
            sums[(r["place"] - 1) // LIMBS] += r["n"] << ((r["place"] - 1) % LIMBS * LIMB)
        else:
            n[0] = r["n"]
    after = [b.entries.astype(object) for b in books]
    for (part, entry), (n, sums) in total.items():
        after[part][entry] = [x // n[0] for x in sums]
    small = all(abs(x) < 1 << 28 for b in after for x in b.ravel().tolist()) and all(b.entries.dtype != object for b in books)
    return [Codebook(b.astype(np.int64) if small else b) for b in after]


def trained(rows: DataFrame, rounds: int = ROUNDS) -> tuple[list[Codebook], int]:
    """The codebooks of rows (id, vector) after all rounds, and the vectors' length."""
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    size = -(-longest // PARTS) * PARTS
    books = started(rows, size)
    for _ in range(rounds if books else 0):
        books = moved(rows, books, size)
    return books, size


def digest(books: list[Codebook]) -> str:
    """The hash of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.entries.ravel().tolist()).encode()).hexdigest()


def coded(rows: DataFrame, books: list[Codebook], size: int) -> DataFrame:
    """rows (id, label, vector) as (id, label, code, error, evaluated); evaluated: distances worked out."""
    ids, labels = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, held in _blocks(batches, size):
            told = [book.nearest(part) for book, part in zip(books, np.split(held, PARTS, axis=1), strict=True)]
            codes = np.stack([c for c, _, _ in told], 1).astype(np.uint8)
            error = sum(e.astype(object) for _, e, _ in told)
            hexes = pa.array([x.tobytes().hex() for x in codes], pa.string())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "id"), column(batch, "label"), hexes, pa.array([str(x) for x in error], pa.string()), pa.array(np.full(batch.num_rows, sum(n for _, _, n in told) / batch.num_rows))],
                ["id", "label", "code", "error", "evaluated"],
            )

    if not books:
        return rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("decimal(38,0)").alias("error"), F.lit(0.0).alias("evaluated"))
    out = rows.select("id", "label", "vector").mapInArrow(run, f"id {ids}, label {labels}, code string, error string, evaluated double")
    return out.withColumn("error", F.col("error").try_cast("decimal(38,0)"))


def with_totals(rows: DataFrame, key: str, value: str, name: str, often: int = OFTEN) -> DataFrame:
    """rows, a written table, with the sum of a value over equal keys, nulls together."""
    totals = checkpointed(rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"), F.try_sum(value).alias(name)))
    many = (totals.agg(F.sum("_n")).first()[0] or 0) // often
    # So many rows each have no more than often keys.
    hot = F.broadcast(totals.where(F.col("_n") > many).select("_key", name, F.lit(True).alias("_hot")))
    first = rows.join(hot, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    told = first.where("_hot").drop("_hot")
    rest = first.where("_hot IS NULL").drop("_hot", name).join(totals.where(F.col("_n") <= many).drop("_n"), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    return told.transform(united, rest)


def compressed(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """id, code, error, label_error and codebooks_sha256 for every usable vector."""
    rows = usable(vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"), F.col(label_column).alias("label")), "vector")
    books, size = trained(rows.select("id", "vector"))
    found = with_totals(checkpointed(coded(rows, books, size).drop("evaluated")), "label", "error", "label_error")
    return found.select(F.col("id").alias(id_column), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compressed(table(spark, sf_dir, "embeddings"))
    return found.withColumns({c: F.col(c).try_cast("long") for c in ("error", "label_error")})


def _oracle() -> str:
    """The same in DuckDB's SQL, by all entries of each codebook."""
    whole = "(s - ((s % n) + n) % n) // n"
    steps = ["""b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM parts WHERE vec_id IN (SELECT DISTINCT vec_id FROM kept WHERE vec_id IS NOT NULL ORDER BY vec_id LIMIT 16))"""]
    near = "n{k} AS MATERIALIZED (SELECT r, part, min(d * 16 + entry) % 16 AS entry, min(d * 16 + entry) // 16 AS d FROM (SELECT r, parts.part, entry, list_sum(list_transform(list_zip(parts.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts JOIN b{k} b ON b.part = parts.part) GROUP BY r, part)"
    for k in range(ROUNDS):
        steps.append(near.format(k=k))
        steps.append(f"""m{k} AS (SELECT part, entry, list({whole} ORDER BY pos) AS v FROM (SELECT part, entry, pos, sum(x) AS s, count(*) AS n FROM
  (SELECT part, n.entry, unnest(v) AS x, unnest(range(len(v))) AS pos FROM parts JOIN n{k} n USING (r, part)) GROUP BY part, entry, pos) GROUP BY part, entry)""")
        steps.append(f"b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (part, entry))")
    steps.append(near.format(k=ROUNDS))
    return f"""WITH kept AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS HUGEINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, vec_id, part, q[part * len(q) // {PARTS} + 1 : (part + 1) * len(q) // {PARTS}] AS v FROM kept, range({PARTS}) t(part)),
{', '.join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM n{ROUNDS} GROUP BY r),
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r) CROSS JOIN book"""


ORACLE = _oracle()
