"""Operator 9, shards of near equal bytes by sampled splitters.

1. One pass over the texts leaves a narrow table (id, size, checksum, key),
   written to the shared checkpoint folder. The key is a hash of the text, so
   equal texts are neighbours; a hash of the id orders rows within a key, and a
   hash of the row's number in the table those that repeat id and text.
2. A size-weighted sample of keys, PER_RANGE for each range, gives quantiles: the
   splitters. There is a range for each ROWS rows. One that holds far more of the
   sample than its share (one key with very many rows, say) is subdivided by the
   quantiles of the other two hashes. A row's range follows from the splitters
   alone, by binary search.
3. Records are dealt out by range and sorted within it, running sums of sizes
   are taken there, and the exact totals of the ranges before give each row its
   place on the line of all bytes. The shard is that place times the number of
   shards over all bytes: shards differ by about one record.

Null and empty texts have size 1 and checksum 0. Repeated rows are placed each
for itself; null ids are placed as one more id. An empty table gives an empty
result. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

SHARDS = 16
#: Sampled keys for each range: the driver holds some 20 bytes for each; rows to a range, about; ranges at least, in a table that has the rows.
PER_RANGE, ROWS, FEWEST = 40, 1_000_000, 1024


def after(bounds: np.ndarray, k2: np.ndarray, k3: np.ndarray) -> np.ndarray:
    """How many of the ascending pairs in bounds are no greater than each pair (k2, k3)."""
    at, upto = np.searchsorted(bounds[:, 0], k2, "left"), np.searchsorted(bounds[:, 0], k2, "right")
    for b in np.unique(at[upto > at]):
        own = (at == b) & (upto > at)
        at[own] += np.searchsorted(bounds[b : int(upto[own][0]), 1], k3[own], "right")
    return at


def splitters(sample: pd.DataFrame, ranges: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """First-level boundaries, and for each overfull range the second-level ones, pairs of the other keys."""
    k1, rest = np.sort(sample["k1"].to_numpy(np.int64)), sample[["k2", "k3"]].to_numpy(np.int64).reshape(-1, 2)
    if not len(k1):
        return np.zeros(0, np.int64), {}
    at = np.arange(1, ranges) * len(k1) // ranges
    first = np.unique(k1[at])
    held = np.searchsorted(first, sample["k1"].to_numpy(np.int64), "right")
    counts = np.bincount(held, minlength=len(first) + 1)
    share = max(1, len(k1) // ranges)
    second = {}
    for r in np.flatnonzero(counts > 2 * share):
        own = rest[held == r]
        own = own[np.lexsort((own[:, 1], own[:, 0]))]
        parts = int(counts[r] // share)
        second[int(r)] = np.unique(own[np.arange(1, parts) * len(own) // parts], axis=0)
    return first, second


def ranged(first: np.ndarray, second: dict[int, np.ndarray]):
    """A column function from the three keys to the number of the range."""
    width = max([0, *map(len, second.values())]) + 1

    @F.pandas_udf("long")
    def of(k1: pd.Series, k2: pd.Series, k3: pd.Series) -> pd.Series:
        at = np.searchsorted(first, k1.to_numpy(np.int64), "right")
        sub = np.zeros(len(at), np.int64)
        for r in np.intersect1d(np.unique(at), np.array(list(second), np.int64)):
            own = at == r
            sub[own] = after(second[int(r)], k2.to_numpy(np.int64)[own], k3.to_numpy(np.int64)[own])
        return pd.Series(at.astype(np.int64) * width + sub)

    return of


def sharded(docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text", per_range: int = PER_RANGE, rows: int = ROWS, fewest: int = FEWEST) -> DataFrame:
    """id, size, text_crc32, key, range, shard and slot (gapless from 0 in a shard) for every row of docs."""
    text = F.coalesce(docs[text_column], F.lit(""))
    narrow = checkpointed(docs.select(
        docs[id_column].alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"), F.xxhash64(docs[id_column].cast("string"), text).alias("k2"), F.xxhash64(F.monotonically_increasing_id()).alias("k3"),
    ))
    total, n = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = max(fewest, -(-n // rows))
    drawn = narrow.where(F.rand(7) < F.lit(float(per_range * ranges)) * F.col("size") / F.lit(float(max(total, 1)))).select("k1", "k2", "k3").toPandas()
    placed = narrow.withColumn("range", ranged(*splitters(drawn, min(ranges, max(1, len(drawn) // 8))))("k1", "k2", "k3"))
    order = Window.partitionBy("range").orderBy("k1", "k2", "k3")
    ordered = placed.withColumns({"upto": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)), "rank": F.row_number().over(order)})
    # The ranges are few by construction: their totals fit one task.
    before = (
        placed.groupBy("range").agg(F.sum("size").alias("bytes"))
        .withColumn("before", F.sum("bytes").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
        .select("range", F.coalesce("before", F.lit(0)).alias("before"))
    )
    centre = F.col("before") + F.col("upto") - F.col("size") / 2
    with_shard = ordered.join(F.broadcast(before), "range").withColumn("shard", F.least(F.lit(shards - 1), F.floor(centre * shards / total)).cast("int"))
    # A shard's rows in a range are consecutive there, and ranges ascend: offsets need counts only.
    parts = with_shard.groupBy("range", "shard").agg(F.min("rank").alias("head"), F.count("*").alias("n"))
    starts = parts.select(
        "range", "shard", "head",
        F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
    )
    return with_shard.join(F.broadcast(starts), ["range", "shard"]).select(
        F.col("id").alias(id_column), "size", "text_crc32", "k1", "range", "shard", (F.col("start") + F.col("rank") - F.col("head")).cast("long").alias("slot")
    )


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharded(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
