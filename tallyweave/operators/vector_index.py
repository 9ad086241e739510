"""Nearest neighbours over an inverted file of cells, exactly.

build() cuts the vectors into cells around centroids (of a bounded sample) and
writes them as a table partitioned by cell, with a small table of the cells:
centroid, radius, rows. search() joins a table of queries to cells in the
cluster: no vector of a query or of a row passes through the driver.

A row of a cell is no nearer to a query than the distance to the centroid less
the radius. Each query first reads the cells that hold enough rows nearest to
it; the distance of the last of its answers so far then rules out all cells
whose bound is beyond it, and the others are read in a second pass. So answers
are those of a full scan, and only the folders of cells that some query needs
are read.

Vectors meet in tiles of at most about TILE rows of a cell and TILE queries, so
neither a cell that holds most rows nor one that all queries need is one task's.

Rows without a vector, of another length than most, or with components that are
not finite are written to cell -1 and never found; queries like that find
nothing. Ties go to the smaller id. Repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .materialize import stored, united

#: Cells at most, and sampled rows for each that centroids are fitted to: both bound what the driver and a broadcast hold.
MOST_CELLS, SAMPLED = 1024, 16
#: Rounds of fitting; rows of a cell, and queries, that meet in one task.
ROUNDS, TILE = 6, 4096
#: What rounding may take off a bound.
SLACK = 1e-9


@dataclass(frozen=True)
class Index:
    """Where an index lies, its columns, and its cells: ids, centroids, radii and numbers of rows."""

    path: str
    schema: StructType
    id_column: str
    vector_column: str
    cells: np.ndarray
    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray

    def rows(self, spark) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/rows")


def _matrix(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have that size and are finite, and those as a matrix."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    good = np.asarray(pc.fill_null(pc.equal(vectors.value_lengths(), size), False))
    flat = vectors.filter(pa.array(good)).flatten()
    held = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(-1, size) if size else np.zeros((good.sum(), 0))
    finite = np.isfinite(held).all(1)
    good[good] = finite
    return good, held[finite]


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1)[None, :] - 2 * x @ centroids.T).argmin(1)


def _fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of a sample, by farthest-apart starts among it and ROUNDS of means."""
    centroids = np.unique(sample, axis=0)
    centroids = centroids[np.random.default_rng(0).permutation(len(centroids))[:cells]]
    for _ in range(ROUNDS):
        own = _nearest(sample, centroids)
        count = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    return centroids


def build(rows: DataFrame, path: str, id_column: str = "id", vector_column: str = "embedding", cells: int | None = None) -> Index:
    """An index of all rows under path, with all their columns; `_cell` is a column of its own."""
    size = F.size(vector_column)
    usual = rows.where(F.col(vector_column).isNotNull()).groupBy(size.alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    dimension, n = (usual["size"], usual["n"]) if usual else (0, 0)
    cells = min(MOST_CELLS, cells or max(1, round(n**0.5 / 2)))
    drawn = rows.where(size == dimension).orderBy(F.xxhash64(id_column), id_column).limit(cells * SAMPLED).select(vector_column).toArrow() if n else None
    _, sample = _matrix(drawn[vector_column], dimension) if n else (None, np.zeros((0, dimension)))
    centroids = _fitted(sample, cells) if len(sample) else np.zeros((1, dimension))
    held = rows.sparkSession.sparkContext.broadcast(centroids)
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, TILE):
                batch = whole.slice(first, TILE)
                good, x = _matrix(batch.column(batch.schema.get_field_index(vector_column)), dimension)
                cell, apart = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
                if len(x):
                    cell[good] = _nearest(x, held.value)
                    apart[good] = np.sqrt(((x - held.value[cell[good]]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(apart), pa.array(cell)], [*batch.schema.names, "_apart", "_cell"])

    told = rows.mapInArrow(assign, f"{', '.join(names)}, _apart double, _cell int")
    # Rows of a cell are dealt over as many files as it needs, whatever their number.
    salt = F.pmod(F.xxhash64(id_column), F.lit(max(1, n // (cells * TILE))))
    schema = told.schema
    told.repartition("_cell", salt).write.partitionBy("_cell").parquet(f"{path}/rows")
    written = rows.sparkSession.read.schema(schema).parquet(f"{path}/rows")
    # A row a cell.
    told = sorted(tuple(r) for r in written.where("_cell >= 0").groupBy("_cell").agg(F.max("_apart"), F.count("*")).collect())
    ids = np.array([c for c, _, _ in told], np.int64)
    return Index(path, schema, id_column, vector_column, ids, centroids[ids], np.array([r for _, r, _ in told]), np.array([k for _, _, k in told], np.int64))


def _bounds(index: Index, queries: DataFrame) -> DataFrame:
    """queries (q, v) with, for each cell, its number, the least distance of its rows and whether it is read first."""
    held = queries.sparkSession.sparkContext.broadcast((index.cells, index.centroids, index.radii, index.sizes))
    kind = queries.schema["q"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, centroids, radii, _ = held.value
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                good, x = _matrix(batch.column(batch.schema.get_field_index("v")), centroids.shape[1])
                if not len(x):
                    continue
                apart = np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(1)[None, :], 0))
                scale = np.sqrt((x**2).sum(1))[:, None] + np.sqrt((centroids**2).sum(1))[None, :]
                near = apart - radii[None, :] - SLACK * (1 + scale)
                far = apart + radii[None, :]
                kept = batch.filter(pa.array(good))
                row = np.repeat(np.arange(len(x)), len(cells))
                yield pa.RecordBatch.from_arrays(
                    [kept.column(kept.schema.get_field_index("q")).take(pa.array(row)), pa.array(np.tile(cells, len(x)).astype(np.int32)), pa.array(near.ravel()), pa.array(far.ravel())], ["q", "cell", "near", "far"]
                )

    return queries.mapInArrow(run, f"q {kind}, cell int, near double, far double")


def _met(index: Index, queries: DataFrame, pairs: DataFrame, rows: DataFrame, limit: int) -> DataFrame:
    """(q, id, distance): the best rows of each tile for the pairs (q, cell) of queries and cells."""
    spark = queries.sparkSession
    # As many rows as there are cells.
    asked = {r["cell"]: r["n"] for r in pairs.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    sizes = dict(zip(index.cells.tolist(), index.sizes.tolist(), strict=True))
    plan = [(c, -(-sizes[c] // TILE), -(-n // TILE)) for c, n in asked.items()]
    tiles = F.broadcast(spark.createDataFrame(plan, "cell int, blocks long, chunks long"))
    kept = rows.where(F.col("_cell").isin([c for c, _, _ in plan])).select(F.col(index.id_column).alias("id"), F.col(index.vector_column).alias("x"), F.col("_cell").alias("cell"))
    right = kept.join(tiles, "cell").select("cell", F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "id", "x")
    left = pairs.join(queries, "q").join(tiles, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("q"), "chunks").alias("chunk"), "q", "v")
    size = index.centroids.shape[1]
    schema = f"q {queries.schema['q'].dataType.simpleString()}, id {kept.schema['id'].dataType.simpleString()}, distance double"

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        _, q = _matrix(a["v"], size)
        _, x = _matrix(b["x"], size)
        parts = []
        for first in range(0, len(q) if len(x) else 0, 64):
            own = q[first : first + 64]
            square = (own**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * own @ x.T
            worst = np.partition(square, min(limit, len(x)) - 1, axis=1)[:, min(limit, len(x)) - 1]
            # Near enough to be among the best once distances are worked out one by one.
            i, j = np.nonzero(square <= (worst + SLACK * (1 + (own**2).sum(1) + (x**2).sum(1).max()))[:, None])
            exact = np.concatenate([np.sqrt(((x[j[k : k + TILE]] - own[i[k : k + TILE]]) ** 2).sum(1)) for k in range(0, len(i), TILE)])
            told = pa.table({"i": pa.array(i + first), "id": b["id"].take(pa.array(j)), "distance": pa.array(exact)})
            told = told.take(pc.sort_indices(told, [("i", "ascending"), ("distance", "ascending"), ("id", "ascending")]))
            i = told["i"].to_numpy()
            parts.append(told.filter(pa.array(np.arange(len(i)) - np.searchsorted(i, i) < limit)))
        if not parts:
            return pa.table({"q": a["q"].slice(0, 0), "id": b["id"].slice(0, 0), "distance": pa.array([], pa.float64())})
        told = pa.concat_tables(parts)
        return pa.table({"q": a["q"].take(told["i"]), "id": told["id"], "distance": told["distance"]})

    keys = ["cell", "block", "chunk"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile, schema)


def search(index: Index, queries: DataFrame, limit: int, query_id: str = "query_id", vector_column: str = "embedding", where=None) -> DataFrame:
    """(query_id, id, distance, rank, cells_read) of the nearest rows of each query, exactly; ids of queries are their own.

    where: a condition on the rows; it comes before the limit, so that a filtered query has as many answers as there are.
    cells_read: the share of cells that were read for the query.
    """
    spark = queries.sparkSession
    asked = stored(queries.select(F.col(query_id).alias("q"), F.col(vector_column).alias("v")))
    rows = index.rows(spark) if where is None else index.rows(spark).where(where)
    sizes = spark.createDataFrame(list(zip(index.cells.tolist(), index.sizes.tolist(), strict=True)), "cell int, n long")
    bounds = _bounds(index, asked).join(F.broadcast(sizes), "cell")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("q").orderBy("far", "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounds = stored(bounds.withColumn("first", before < limit).drop("n", "far"))
    first = stored(_met(index, asked, bounds.where("first").select("q", "cell"), rows, limit))
    best = Window.partitionBy("q").orderBy("distance", "id")
    worst = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == limit).select("q", F.col("distance").alias("worst"))
    more = stored(bounds.where("NOT first").join(worst, "q", "left").where("worst IS NULL OR near <= worst").select("q", "cell"))
    every = first.transform(united, _met(index, asked, more, rows, limit))
    read = bounds.where("first").select("q", "cell").transform(united, more).groupBy("q").agg((F.count("*") / max(1, len(index.cells))).alias("cells_read"))
    ranked = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    return ranked.join(read, "q").select(F.col("q").alias(query_id), F.col("id").alias(index.id_column), "distance", "rank", "cells_read")
