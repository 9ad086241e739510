"""Files as they arrive, each content once: a file stream whose batches pass the manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.reads import fresh
from ..schemas import MANIFEST


def arriving(spark: SparkSession, folder: str, suffix: str = ".csv") -> DataFrame:
    """(path, file_name, file_sha, content) of files as they come below a folder."""
    rows = spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(folder)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.sha2("content", 256).alias("file_sha"), "content")


def ingest(spark: SparkSession, folder: str, ledger: str, manifest: str, state: str, parse: Callable[[DataFrame], DataFrame], suffix: str = ".csv") -> StreamingQuery:
    """Parse what is new and append it to the ledger, then note it in the manifest.

    Both are Parquet folders with a partition a batch, which a repeated batch overwrites: so a batch that is run again changes nothing.
    """

    def batch(files: DataFrame, number: int) -> None:
        own = files.sparkSession
        try:
            done = own.read.schema(MANIFEST).parquet(manifest).where(f"batch <> {number}")
        except Exception as e:  # nothing was noted yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = own.createDataFrame([], MANIFEST)
        new = fresh(files.dropDuplicates(["file_sha"]), done)
        parse(new).write.mode("overwrite").parquet(f"{ledger}/batch={number}")
        noted = new.select("file_sha", "file_name", F.lit("SUCCESS").alias("status"), F.current_timestamp().alias("processed_at"))
        noted.write.mode("overwrite").parquet(f"{manifest}/batch={number}")

    return arriving(spark, folder, suffix).writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()


def event_windows(events: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and kind, of a stream or a table; late rows are awaited so long."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, width), "event_type").agg(F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(20,6)")).alias("total"))
