"""What the operators share: reading tables, checkpoints, walking Arrow batches."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.materialize import united  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Local sessions without that setting (tests) get a folder of their own; a
    cluster without it is an error, as a machine-local folder is not shared.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            where = tempfile.mkdtemp(prefix="tallyweave-checkpoints-")
        context.setCheckpointDir(where)
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def held_out(id_column: str = "doc_id") -> Column:
    """Whether labels of a row are kept for testing: a fifth, by the id's text."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0


#: CRC-32 in DuckDB's SQL, for the tables' SQL: a table of a row with tbl, and the sum of an ASCII text where that row is joined.
CRC32_TABLE = "SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl"
CRC32_SQL = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295)"


def slices(array: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array that hold about most_bytes each, a longer text alone."""
    n = len(array)
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, first = np.concatenate([[0], np.cumsum(sizes)]), 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(total, total[first] + most_bytes, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def each_text(array: pa.Array) -> Iterator[str | None]:
    """The texts of a batch as strings, a few megabytes of them at a time."""
    for first, last in slices(array, 4 << 20):
        yield from array.slice(first, last - first).to_pylist()


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, null as empty, and where each text starts, with the end."""
    if array.null_count:
        array = pc.fill_null(array, "")
    wide = pa.types.is_large_string(array.type)
    _, at, data = array.buffers()
    if at is None or not len(array):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def by_batch(df: DataFrame, schema: str, rows: Callable[[pa.RecordBatch], pa.RecordBatch | None], ready: Callable[[], None] | None = None) -> DataFrame:
    """rows() applied to each Arrow batch of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ready:
            ready()
        for batch in batches:
            out = rows(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)
