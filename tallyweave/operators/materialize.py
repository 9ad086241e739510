"""Cutting a plan where several of its parts read one intermediate table, and putting tables together."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Local sessions without that setting get a folder of their own; on a cluster it must be set.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            where = tempfile.mkdtemp(prefix="tallyweave-")
        context.setCheckpointDir(where)
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, computed once, as compressed columns in the shared folder, which outlives executors; a reader takes the columns that it needs."""
    path = new_folder(df.sparkSession, "stored")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a stored table that a join may still broadcast.
FEW = 100_000


def dealt(table: DataFrame) -> DataFrame:
    """A stored table for a join, dealt out by its keys if it has many rows; the planner goes by packed bytes, and a sorted key packs into one, so
    it would send millions of them through the driver."""
    return table.hint("merge") if table.count() > FEW else table


_PARTITIONED_UNION = "spark.sql.unionOutputPartitioning"


def united(df: DataFrame, other: DataFrame, allowMissingColumns: bool = False) -> DataFrame:
    """df and other by name, for DataFrame.transform().

    Spark 4.1 may take a union for partitioned by keys that one of its sides is not partitioned by, and then leaves out an
    exchange that an aggregation above needs (tax.quarantined() under a join gave 1656 wrong sums of 18673); so that guess is turned
    off in the session.
    """
    conf = df.sparkSession.conf
    if conf.get(_PARTITIONED_UNION, "true") != "false":
        conf.set(_PARTITIONED_UNION, "false")
    return df.unionByName(other, allowMissingColumns=allowMissingColumns)
