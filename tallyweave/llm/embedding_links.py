"""Operator 3, near duplicates among embeddings by spherical-cap filters.

The filters are unit vectors in random product codes: a direction is one
codeword for each block of coordinates. A vector passes the filters (caps) that
it exceeds a threshold for; list decoding finds them from the blocks' inner
products without visiting the directions that cannot reach it. Vectors of a
high cosine share filters with near certainty, others hardly ever. The number of
codewords grows with the fourth root of the number of vectors, without a limit,
so that a filter is passed by a handful of unrelated ones whatever the input; a
vector that passes few filters takes its BEST best ones.

Equal vectors are one vector with a weight. Vectors meet by filter; a filter
with many is split into chunks that meet two at a time, so no task holds more
than 2 * CHUNK of them, whatever the cluster. Each pair's cosine is computed in
double precision, and it counts in the least filter that both pass, once.

Null, zero and non-finite vectors link with nothing. Only vectors of equal
length are compared. Repeated rows are different vectors. Null ids come back
unlinked. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, column, table
from .groups import by_group, components, joined

COSINE = 0.95
#: Filters that a random vector passes, on average; those taken at least; random vectors in a filter, on average.
PASSED, BEST, TOGETHER = 24, 12, 8
BLOCKS = 4
CHUNK = 1000


@lru_cache(8)
def code(dimension: int, rows: int) -> tuple[tuple[np.ndarray, ...], float]:
    """Codewords of each block, and the threshold that random vectors exceed for PASSED filters on average.

    The threshold is found by counting, never by listing all filters: there are as many as vectors, about.
    """
    draw = np.random.default_rng(dimension)
    blocks = min(BLOCKS, dimension)
    words = max(4, math.ceil((PASSED * max(rows, TOGETHER) / TOGETHER) ** (1 / blocks)))
    books = []
    for part in np.array_split(np.arange(dimension), blocks):
        w = draw.standard_normal((words, len(part))).astype(np.float32)
        books.append(w / np.linalg.norm(w, axis=1, keepdims=True) / np.float32(math.sqrt(blocks)))
    x = draw.standard_normal((64, dimension))
    sums = [(np.sort(a), np.sort(b)) for a, b in (halves(v, books) for v in (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32))]
    low, high = -1.0, 1.0
    for _ in range(24):
        middle = (low + high) / 2
        passed = sum(int((len(b) - np.searchsorted(b, np.float32(middle) - a)).sum()) for a, b in sums) / len(sums)
        low, high = (middle, high) if passed > PASSED else (low, middle)
    return tuple(books), low


def halves(v: np.ndarray, books) -> tuple[np.ndarray, np.ndarray]:
    """Sums of inner products over all choices in the first and in the second half of the blocks."""
    parts = np.split(v, np.cumsum([b.shape[1] for b in books])[:-1])
    sums = [b @ p for b, p in zip(books, parts, strict=True)]
    half = (len(sums) + 1) // 2
    out = []
    for group in (sums[:half], sums[half:]):
        total = np.zeros(1, np.float32)
        for s in group:
            total = np.add.outer(total, s).ravel()
        out.append(total)
    return out[0], out[1]


def decode(v: np.ndarray, books, threshold: float) -> np.ndarray:
    """Numbers of the filters that v exceeds, or of its BEST best, ascending."""
    a, b = halves(v, books)
    least = threshold
    while True:
        rows = np.flatnonzero(a >= least - b.max())
        score = np.add.outer(a[rows], b)
        i, j = np.nonzero(score >= least)
        if len(i) >= min(BEST, len(a) * len(b)):
            break
        least -= 0.02
    found = rows[i] * len(b) + j
    if least < threshold:
        found = found[np.argsort(-score[i, j], kind="stable")[:BEST]]
    return np.sort(found)


def unit(vectors: pa.Array, width: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small numbers leave the range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked(vectors: DataFrame, cosine: float = COSINE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id, n_links, component_id and kept for every row of vectors."""
    v = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"))
    sound = F.col("id").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    classes = checkpointed(v.where(sound).groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    rows = classes.count()

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in column(batch, "v").to_pylist():
                x = unit(pa.array([x], pa.list_(pa.float64())), len(x))[0]
                books, threshold = code(len(x), rows)
                found.append(decode(x.astype(np.float32), books, threshold))
            told = pa.array(found, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([column(batch, "rep"), column(batch, "n"), column(batch, "v"), told], ["rep", "n", "v", "filters"])

    kind = vectors.schema[vector_column].dataType.simpleString()
    decoded = checkpointed(classes.mapInArrow(filters, f"rep long, n long, v {kind}, filters array<long>"))
    passes = decoded.select("rep", F.size("v").alias("width"), F.explode("filters").alias("filter"))
    met = passes.groupBy("width", "filter").agg(F.count("*").alias("m")).where("m > 1").withColumn("chunks", F.ceil(F.col("m") / CHUNK).cast("int"))
    seats = (
        passes.join(met, ["width", "filter"])
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("rep", "width", "filter", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    )

    def meet(t: pa.Table) -> pa.RecordBatch | None:
        first = {k: t[k][0].as_py() for k in ("width", "filter", "i", "j")}
        ids, n, own = (t[k].to_numpy() for k in ("rep", "n", "own"))
        x = unit(t["v"].combine_chunks(), first["width"])
        close = x @ x.T >= cosine
        np.fill_diagonal(close, False)
        if first["i"] != first["j"]:
            close &= own[:, None] != own[None, :]
        on = np.flatnonzero(close.any(1))
        on = on[np.argsort(ids[on])]
        if not len(on):
            return None
        close, ids, n = close[np.ix_(on, on)], ids[on], n[on]
        lists = [np.asarray(f) for f in t["filters"].take(pa.array(on)).to_pylist()]
        lower = np.concatenate([f[f < first["filter"]] for f in lists])
        of = np.repeat(np.arange(len(on)), [int((f < first["filter"]).sum()) for f in lists])
        names, at, count = np.unique(lower, return_inverse=True, return_counts=True)
        shared = count[at] > 1
        names, at = np.unique(at[shared], return_inverse=True)
        has = np.zeros((len(on), len(names)), np.float32)
        has[of[shared], at] = 1
        counted = close & (has @ has.T == 0)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counted @ n), pa.array(ids[joined(close)])], ["id", "links", "root"])

    seated = seats.join(decoded, "rep").select("width", "filter", "i", "j", "own", "rep", "n", "v", "filters")
    found = checkpointed(by_group(seated, ["width", "filter", "i", "j"], "id long, links long, root long", meet))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.selectExpr("id AS a", "root AS b")).withColumnRenamed("node", "id")
    told = decoded.select("v", F.col("rep").alias("id"), "n").join(links, "id", "left").join(roots, "id", "left")
    told = told.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = v.withColumn("key", F.when(sound, F.col("v"))).join(told.withColumnRenamed("v", "key"), "key", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id") == F.col("component_id")).withColumnRenamed("id", id_column)


def op3_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))


#: All pairs, and what each vector reaches.
ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE list_sum(list_transform(embedding, lambda x: abs(x))) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, (SELECT min(b) FROM r WHERE a = vec_id) AS component_id, vec_id = (SELECT min(b) FROM r WHERE a = vec_id) AS kept FROM embeddings"""
