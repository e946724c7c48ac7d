"""Key-value tables as logs of cells: puts append, reads take the latest; nothing is rewritten in place."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "key string, col string, value string, version bigint, deleted boolean"


def latest(log: DataFrame) -> DataFrame:
    """(key, col, value): the cells as they are now: of each cell the entry of the highest version, unless it or a later
    entry of the whole row (null col) deletes it. Aggregates with map-side partial results, no sort."""
    cell = log.where(F.col("col").isNotNull()).groupBy("key", "col").agg(F.max(F.struct("version", "value", "deleted")).alias("e"))
    row = log.where(F.col("col").isNull()).groupBy("key").agg(F.max("version").alias("_gone"))
    out = cell.join(row, "key", "left").where(~F.col("e.deleted") & (F.col("_gone").isNull() | (F.col("e.version") > F.col("_gone"))))
    return out.select("key", "col", F.col("e.value").alias("value"))


def at_version(log: DataFrame, version: int) -> DataFrame:
    """(key, col, value) written by exactly this version."""
    return log.where((F.col("version") == version) & ~F.col("deleted") & F.col("col").isNotNull()).select("key", "col", "value")


def conditional(current: DataFrame, puts: DataFrame) -> DataFrame:
    """(key, result, value) of puts (key, col, value, if_col, equals): OK and the new value where the present value of
    ``if_col`` equals ``equals``, else FAIL and the old one."""
    test = current.select(F.col("key"), F.col("col").alias("if_col"), F.col("value").alias("_is"))
    old = current.select("key", "col", F.col("value").alias("_old"))
    joined = puts.join(test, ["key", "if_col"], "left").join(old, ["key", "col"], "left")
    ok = F.coalesce(F.col("_is") == F.col("equals"), F.lit(False))
    return joined.select("key", F.when(ok, "OK").otherwise("FAIL").alias("result"), F.when(ok, F.col("value")).otherwise(F.col("_old")).alias("value"))


def delete_rows(current: DataFrame, keys: DataFrame) -> DataFrame:
    return current.join(keys.select("key"), "key", "left_anti")


def scan(df: DataFrame, start: str | None = None, end: str | None = None, key: str = "key") -> DataFrame:
    """The rows with start <= key < end; the range reaches the scan."""
    if start is not None:
        df = df.where(F.col(key) >= start)
    return df.where(F.col(key) < end) if end is not None else df


def get_row(df: DataFrame, key: Column | str | int, name: str = "key") -> DataFrame:
    return df.where(F.col(name) == key).limit(1)


def get_rows(df: DataFrame, keys: DataFrame, name: str = "key") -> DataFrame:
    """The rows whose key is among ``keys``: many point reads as one join."""
    return df.join(keys.select(name).distinct(), name, "left_semi")


def exist_rows(df: DataFrame, keys: DataFrame, name: str = "key") -> DataFrame:
    """(key, there) for each of the different ``keys``."""
    there = df.select(name).distinct().withColumn("_there", F.lit(True))
    return keys.select(name).distinct().join(there, name, "left").select(name, F.coalesce("_there", F.lit(False)).alias("there"))


class KVTable:
    """A named table as a folder of log files. Versions are given by the writer; where they are not, they are
    microseconds of the clock, larger than the last one of this object, and no entry needs to be read to write
    another."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def exists(self) -> bool:
        p, fs = self._fs()
        return fs.exists(p)

    def log(self) -> DataFrame:
        """All entries; a table that isn't there is empty."""
        return self.spark.read.schema(LOG).parquet(self.path) if self.exists() else self.spark.createDataFrame([], LOG)

    def next_version(self) -> int:
        self._last = max(getattr(self, "_last", 0) + 1, time.time_ns() // 1000)
        return self._last

    def put(self, cells: DataFrame, version: int | None = None) -> int:
        """Appends (key, col, value) rows, or (key, col, value, version) as they are."""
        v = self.next_version() if version is None else version
        if "version" not in cells.columns:
            cells = cells.withColumn("version", F.lit(v).cast("bigint"))
        cells.select("key", "col", "value", "version", F.lit(False).alias("deleted")).write.mode("append").parquet(self.path)
        return v

    def put_row(self, key: str, row: dict[str, str]) -> int:
        """Replaces all columns of a row."""
        self.delete_row(key)
        return self.put(self.spark.createDataFrame([(key, c, x) for c, x in row.items()], "key string, col string, value string"))

    def delete_row(self, key: str) -> int:
        v = self.next_version()
        self.spark.createDataFrame([(key, None, None, v, True)], LOG).write.mode("append").parquet(self.path)
        return v

    def rows(self) -> DataFrame:
        return latest(self.log())

    def get(self, key: str, col: str, version: int | None = None) -> str | None:
        """One cell; one that isn't there is null. The key and column filters reach the scan."""
        log = self.log().where((F.col("key") == key) & (F.col("col").isNull() | (F.col("col") == col)))
        found = (at_version(log, version) if version is not None else latest(log)).first()
        return found["value"] if found else None

    def exists_row(self, key: str) -> bool:
        return latest(self.log().where(F.col("key") == key)).limit(1).count() > 0

    def count(self) -> int:
        return self.rows().select("key").distinct().count()

    def compact(self, target: str) -> KVTable:
        """Writes the present cells to another folder, sorted by key so that ranges skip row groups."""
        now = self.rows().withColumn("version", F.lit(1).cast("bigint")).withColumn("deleted", F.lit(False))
        now.repartitionByRange("key").sortWithinPartitions("key").select("key", "col", "value", "version", "deleted").write.parquet(target)
        return KVTable(self.spark, target)

    def rename(self, target: str) -> KVTable:
        p, fs = self._fs()
        to = self.spark._jvm.org.apache.hadoop.fs.Path(target)
        if not fs.exists(p):
            raise FileNotFoundError(self.path)
        if fs.exists(to):
            raise FileExistsError(target)
        fs.rename(p, to)
        return KVTable(self.spark, target)

    def drop(self) -> None:
        p, fs = self._fs()
        fs.delete(p, True)
