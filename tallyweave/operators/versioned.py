"""A keyed table in versions: merges rewrite the files that hold a key, and earlier versions stay readable.

A version is a manifest, a small table of files with their bucket, number of
rows, and the least and greatest first key. Rows are dealt into buckets by a
hash of their keys and ranged by them, a large bucket in many files; these carry Bloom filters of the
first key, which equality and IN filters of readers use.

A merge looks for the files it must touch: of buckets that it has keys for, with
a range of keys that meets its own, and then by the key columns of those alone.
Only touched files are read whole and written anew, with the rows that are added;
all others pass into the next version by name. The manifest is written aside and
then moved into place, which is what makes the version: a merge that is cut off
before that leaves the version before as it was, and of two merges at a time the
second fails.

Rows whose key is null are never matched, so merging them adds them. A key twice
among new rows is an error. The driver holds the names of files, as many as the
table has.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .materialize import dealt, stored, united
from .store import deleted, upserted


@dataclass(frozen=True)
class Table:
    """Where a table lies, its columns, keys and number of buckets."""

    path: str
    schema: StructType
    keys: tuple[str, ...]
    buckets: int = 16

    def versions(self, spark: SparkSession) -> list[int]:
        path = _hadoop(spark).Path(f"{self.path}/versions")
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        return sorted(int(n) for n in (x.getPath().getName() for x in system.listStatus(path)) if n.isdigit())

    def manifest(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """(file, bucket, rows, low, high) of a version, the last one by default."""
        kind = self.schema[self.keys[0]].dataType.simpleString()
        held = self.versions(spark)
        if version is not None and version not in held:
            raise ValueError(f"no version {version} of {self.path}")
        schema = f"file string, bucket int, rows long, low {kind}, high {kind}"
        return spark.read.schema(schema).parquet(f"{self.path}/versions/{held[-1] if version is None else version}") if held else spark.createDataFrame([], schema)

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        return self._files(spark, [r["file"] for r in self.manifest(spark, version).select("file").collect()])

    def _files(self, spark: SparkSession, names: list[str]) -> DataFrame:
        return spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{x}" for x in names)) if names else spark.createDataFrame([], self.schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _written(self, spark: SparkSession, rows: DataFrame) -> DataFrame:
        """Write rows as new files; their manifest."""
        batch = uuid.uuid4().hex
        dealt = rows.select(*self.schema.names, self._bucket().alias("_bucket")).repartitionByRange("_bucket", *self.keys).sortWithinPartitions("_bucket", *self.keys)
        dealt.write.partitionBy("_bucket").option(f"parquet.bloom.filter.enabled#{self.keys[0]}", "true").parquet(f"{self.path}/data/{batch}")
        held = spark.read.schema(StructType([*self.schema.fields, StructField("_bucket", IntegerType())])).parquet(f"{self.path}/data/{batch}")
        name = F.element_at(F.split("_metadata.file_path", "/data/"), -1)
        key = F.col(self.keys[0])
        return held.groupBy(name.alias("file"), F.col("_bucket").alias("bucket")).agg(F.count("*").alias("rows"), F.min(key).alias("low"), F.max(key).alias("high"))

    def _commit(self, spark: SparkSession, manifest: DataFrame, version: int) -> int:
        """Make a manifest the given version, which must not be there yet."""
        aside = f"{self.path}/versions/_{uuid.uuid4().hex}"
        manifest.coalesce(1).write.parquet(aside)
        fs, conf = _hadoop(spark), spark.sparkContext._jsc.hadoopConfiguration()
        none = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        target = fs.Path(f"{self.path}/versions/{version}")
        # Fails where the target is there.
        fs.FileContext.getFileContext(target.toUri(), conf).rename(fs.Path(aside), target, none)
        return version

    def _touched(self, spark: SparkSession, keys: DataFrame) -> list[str]:
        """The files of the last version that hold any of the keys."""
        asked = keys.groupBy(self._bucket().alias("bucket")).agg(F.min(self.keys[0]).alias("_low"), F.max(self.keys[0]).alias("_high"))
        near = self.manifest(spark).join(asked, "bucket").where((F.col("high") >= F.col("_low")) & (F.col("low") <= F.col("_high")))
        names = [r["file"] for r in near.select("file").collect()]
        if not names:
            return []
        held = self._files(spark, names).select(*self.keys, F.element_at(F.split("_metadata.file_path", "/data/"), -1).alias("_file"))
        return [r["_file"] for r in held.join(keys, list(self.keys), "left_semi").select("_file").distinct().collect()]

    def _replaced(self, spark: SparkSession, names: list[str], rows: DataFrame) -> int:
        version = (self.versions(spark) or [-1])[-1] + 1
        kept = self.manifest(spark).where(~F.col("file").isin(names)) if names else self.manifest(spark)
        return self._commit(spark, kept.transform(united, self._written(spark, rows)), version)

    def merge(self, new: DataFrame) -> int:
        """The next version: rows of new in place of those with their keys, the others added. Its number."""
        spark = new.sparkSession
        new = dealt(stored(new.select(*self.schema.names)))
        names = self._touched(spark, new.select(*self.keys))
        return self._replaced(spark, names, upserted(self._files(spark, names), new, list(self.keys)))

    def delete(self, keys: DataFrame) -> int:
        """The next version, without the rows of these keys. Its number."""
        spark = keys.sparkSession
        keys = dealt(stored(keys.select(*self.keys).distinct()))
        names = self._touched(spark, keys)
        return self._replaced(spark, names, self._files(spark, names).join(keys, list(self.keys), "left_anti"))

    def delete_where(self, spark: SparkSession, where: Column) -> int:
        """The next version, without the rows for which a condition holds; files without any are left alone."""
        held = self._files(spark, [r["file"] for r in self.manifest(spark).select("file").collect()])
        found = held.where(F.coalesce(where, F.lit(False))).select(F.element_at(F.split("_metadata.file_path", "/data/"), -1).alias("file")).distinct()
        names = [r["file"] for r in found.collect()]
        return self._replaced(spark, names, deleted(self._files(spark, names), where))


def _hadoop(spark: SparkSession):
    return spark.sparkContext._jvm.org.apache.hadoop.fs


def create(rows: DataFrame, path: str, keys: tuple[str, ...], buckets: int = 16) -> Table:
    """A table with rows as version 0; nothing may be at the path yet."""
    table = Table(path, rows.schema, tuple(keys), buckets)
    if table.versions(rows.sparkSession):
        raise ValueError(f"there is a table at {path}")
    table.merge(rows)
    return table
