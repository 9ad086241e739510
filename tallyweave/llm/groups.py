"""Bounded groups of rows to one task each, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, united


def by_group(df: DataFrame, keys: list[str], schema: str, work: Callable[[pa.Table], pa.RecordBatch | None]) -> DataFrame:
    """work() applied to the rows of each group, which must be few; one sort, and a group in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            out = work(pa.Table.from_batches(held).combine_chunks())
            held.clear()
            if out is not None and out.num_rows:
                yield out

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            told = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            cuts = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in told])) + 1
            bounds = [0, *cuts.tolist(), batch.num_rows]
            if held and tuple(x[0] for x in told) != last:
                yield from done()
            for a, b in zip(bounds, bounds[1:], strict=False):
                if a:
                    yield from done()
                held.append(batch.slice(a, b - a))
            last = tuple(x[-1] for x in told)
        if held:
            yield from done()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def joined(links: np.ndarray) -> np.ndarray:
    """The least index that each row of a symmetric matrix of links reaches."""
    label = np.arange(len(links))
    while True:
        nxt = np.minimum(label, np.where(links, label[None, :], len(links)).min(1, initial=len(links)))
        nxt = nxt[nxt]
        if (nxt == label).all():
            return label
        label = nxt


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each end of an edge (a, b) reaches.

    Large and small stars in turn: every node hooks the neighbours above it to
    its least neighbour, until each component is one star. The edges of a round
    are written to the shared checkpoint folder; the driver sees two sums.
    """
    e = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct())
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = e.selectExpr("x AS u", "y AS v").transform(united, e.selectExpr("y AS u", "x AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("x"), F.least("u", "m").alias("y")).distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        hooked = large.join(least, "x").where("y <> m").selectExpr("y AS x", "m AS y")
        e = checkpointed(hooked.transform(united, least.selectExpr("x", "m AS y")).distinct())
    return e.selectExpr("x AS node", "y AS component").transform(united, e.selectExpr("y AS node", "y AS component").distinct())


def summed(df: DataFrame, size: int, count: Callable[[pa.RecordBatch], np.ndarray], parts: int = 32) -> np.ndarray:
    """The sum over all batches of vectors of a fixed size, on the driver.

    A task adds up its own; its vector travels in parts, and these are added in two steps, so that no task holds many.
    """
    width = -(-size // parts)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(parts * width, np.int64)
        for batch in batches:
            total[:size] += count(batch)
        if total.any():
            context = TaskContext.get()
            task = context.partitionId() if context else 0
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts)), pa.array(np.full(parts, task % 64)), pa.array([p.tobytes() for p in total.reshape(parts, -1)], pa.binary())], ["part", "salt", "sums"])

    def add(t: pa.Table) -> pa.RecordBatch:
        total = np.zeros(width, np.int64)
        for x in t["sums"]:
            total += np.frombuffer(x.as_buffer(), np.int64)
        return pa.RecordBatch.from_arrays([t["part"][:1].combine_chunks(), pa.array([0]), pa.array([total.tobytes()], pa.binary())], ["part", "salt", "sums"])

    schema = "part long, salt long, sums binary"
    out = by_group(by_group(df.mapInArrow(fill, schema), ["part", "salt"], schema, add), ["part"], schema, add).collect()
    total = np.zeros((parts, width), np.int64)
    for row in out:
        total[row["part"]] = np.frombuffer(row["sums"], np.int64)
    return total.ravel()[:size]
