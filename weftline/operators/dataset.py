"""A small dataset API over DataFrames: bags of values, and bags of (key, value) pairs. Everything is lazy; functions
are column expressions, so that filters and columns reach the scan and nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import cut

Expr = Callable[[Column], Column]


class Dataset:
    """A bag of values: a DataFrame with one column, ``value``. Null values are dropped where functions make them."""

    def __init__(self, df: DataFrame):
        self.df = df.select("value")

    @classmethod
    def parallelize(cls, spark: SparkSession, values: list) -> Dataset:
        return cls(spark.createDataFrame([(v,) for v in values], "value string"))

    @classmethod
    def from_table(cls, df: DataFrame, row: Column) -> Dataset:
        """One value of each row; rows that give null are dropped."""
        return cls(df.select(row.alias("value")).where(F.col("value").isNotNull()))

    def flat_map(self, f: Expr) -> Dataset:
        """``f`` gives an array; null arrays and null elements give nothing."""
        return Dataset(self.df.select(F.explode(f(F.col("value"))).alias("value")).where(F.col("value").isNotNull()))

    def map(self, f: Expr) -> Dataset:
        return Dataset(self.df.select(f(F.col("value")).alias("value")).where(F.col("value").isNotNull()))

    def map_to_pair(self, key: Expr, value: Expr) -> PairDataset:
        return PairDataset(self.df.select(key(F.col("value")).alias("key"), value(F.col("value")).alias("value")).where(F.col("key").isNotNull()))

    def flat_map_to_pair(self, f: Expr) -> PairDataset:
        """``f`` gives an array of structs of key and value; null pairs are dropped."""
        pairs = self.df.select(F.explode(f(F.col("value"))).alias("p")).where(F.col("p").isNotNull())
        return PairDataset(pairs.select(F.col("p.key").alias("key"), F.col("p.value").alias("value")))

    def filter(self, f: Expr, distinct: bool = False) -> Dataset:
        """Keeps the bag; ``distinct`` also drops repeated values, as the older API did."""
        out = self.df.where(f(F.col("value")))
        return Dataset(out.distinct() if distinct else out)

    def sample(self, fraction: float, seed: int = 0) -> Dataset:
        return Dataset(self.df.sample(False, fraction, seed))

    def sample_by_hash(self, fraction: float) -> Dataset:
        """The same values on every run: those whose MD5 falls below the fraction."""
        h = F.conv(F.substring(F.md5(F.col("value").cast("string")), 1, 8), 16, 10).cast("bigint")
        return Dataset(self.df.where(h < int(fraction * (1 << 32))))

    def group_by(self, key: Expr) -> PairDataset:
        """A pair for each value; nothing is concatenated. Values with a null key are dropped."""
        return self.map_to_pair(key, lambda v: v)

    def distinct(self) -> Dataset:
        return Dataset(self.df.distinct())

    def intersection(self, other: Dataset) -> Dataset:
        return Dataset(self.df.intersect(other.df))

    def fold(self, agg: Callable[[Column], Column]) -> DataFrame:
        """One row from an aggregate such as ``F.sum``; partial results on the map side, no zero counted twice."""
        return self.df.agg(agg(F.col("value")).alias("value"))

    def count(self) -> int:
        return self.df.count()

    def take(self, n: int) -> list:
        return [r[0] for r in self.df.limit(n).collect()]

    def collect(self) -> list:
        return [r[0] for r in self.df.collect()]

    def map_batches(self, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Dataset:
        """For code that is no column expression: ``f`` gets the values in Arrow batches (column ``value``) and gives
        batches of a column ``value`` of strings; null values are dropped."""
        return Dataset(self.df.mapInArrow(f, "value string").where(F.col("value").isNotNull()))

    def save_as_table(self, name: str, path: str | None = None) -> None:
        """Fails if the table exists. With a ``path`` the files lie there and stay when the table is dropped."""
        _save(self.df, name, path)

    def for_each_partition(self, f: Callable) -> None:
        """Side effects on the executors, for a partition at a time; a task that runs again repeats them."""
        self.df.foreachPartition(f)


class PairDataset:
    """A bag of (key, value) pairs."""

    def __init__(self, df: DataFrame):
        self.df = df.select("key", "value")

    def flat_map(self, f: Callable[[Column, Column], Column]) -> Dataset:
        return Dataset(self.df.select(F.explode(f(F.col("key"), F.col("value"))).alias("value")).where(F.col("value").isNotNull()))

    def flat_map_to_pair(self, f: Callable[[Column, Column], Column]) -> PairDataset:
        pairs = self.df.select(F.explode(f(F.col("key"), F.col("value"))).alias("p")).where(F.col("p").isNotNull())
        return PairDataset(pairs.select(F.col("p.key").alias("key"), F.col("p.value").alias("value")))

    def join(self, other: PairDataset, separator: str = ",") -> PairDataset:
        """Inner join on the key: all combinations of a key's values, joined by the separator."""
        right = other.df.select("key", F.col("value").alias("_right"))
        return PairDataset(self.df.join(right, "key").select("key", F.concat_ws(separator, "value", "_right").alias("value")))

    def fold_by_key(self, agg: Callable[[Column], Column]) -> PairDataset:
        """One pair for each key from an aggregate such as ``F.sum``: partial results before the shuffle."""
        return PairDataset(self.df.groupBy("key").agg(agg(F.col("value")).alias("value")))

    def fold_ordered(self, zero: Column, f: Callable[[Column, Column], Column]) -> PairDataset:
        """A fold that needs all values of a key one after the other, in ascending order of the values (bags keep no order of
        arrival). A key's values come together in one task: only for keys whose number of values is bounded."""
        values = F.array_sort(F.collect_list("value"))
        return PairDataset(self.df.groupBy("key").agg(F.aggregate(values, zero, f).alias("value")))

    def count(self) -> int:
        return self.df.count()

    def collect(self) -> list[tuple]:
        return [(r["key"], r["value"]) for r in self.df.collect()]

    def save_as_table(self, name: str, path: str | None = None) -> None:
        """One row for each key; of several values the largest stays, on every run the same. Fails if the table exists."""
        _save(self.df.groupBy("key").agg(F.max("value").alias("value")), name, path)

    def map_batches(self, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> PairDataset:
        """As ``Dataset.map_batches``, over columns ``key`` and ``value``, both strings in the result."""
        return PairDataset(self.df.mapInArrow(f, "key string, value string"))

    def for_each_partition(self, f: Callable) -> None:
        """Side effects on the executors, for a partition of rows (key, value) at a time; a task that runs again repeats
        them."""
        self.df.foreachPartition(f)


class JobOutput:
    """What a job says to its caller, in order; "No output" if it said nothing."""

    def __init__(self):
        self.said: list[str] = []

    def output(self, text: str | None) -> None:
        if text is not None:
            self.said.append(text)

    def text(self) -> str:
        return "".join(self.said) or "No output"


def _save(df: DataFrame, name: str, path: str | None) -> None:
    writer = df.write.mode("errorifexists")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def default_join(left: DataFrame, right: DataFrame, on: str, defaults: dict[str, Column]) -> DataFrame:
    """Left join in which missing values of the right side get defaults."""
    out = left.join(right, on, "left")
    return out.select(*left.columns, *[F.coalesce(F.col(c), defaults[c]).alias(c) if c in defaults else F.col(c) for c in right.columns if c != on])


def append_capped(df: DataFrame, key: str, value: str, order: list[Column | str], most: int, chunk: int | None = None) -> DataFrame:
    """(key, list), or (key, chunk, list): the first ``most`` distinct values of each key in the given order, in chunks.

    The cut comes before the shuffle too (a window group limit), so no task holds more than ``most`` values of a key
    from each input part."""
    from pyspark.sql import Window

    once = df.groupBy(key, value).agg(*[F.min(c if isinstance(c, str) else c).alias(f"_o{i}") for i, c in enumerate(order)])
    w = Window.partitionBy(key).orderBy(*[f"_o{i}" for i in range(len(order))], value)
    kept = once.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    by = [key]
    if chunk:
        kept = kept.withColumn("chunk", ((F.col("_n") - 1) / chunk).cast("int"))
        by.append("chunk")
    items = F.array_sort(F.collect_list(F.struct("_n", value)))
    return kept.groupBy(*by).agg(F.transform(items, lambda s: s[value]).alias("list"))


def per_key_limit(df: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key."""
    from pyspark.sql import Window

    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def page_of(df: DataFrame, order: list[Column], page: int, size: int = 10) -> DataFrame:
    """Page ``page`` (from 1) in the given order; pages beyond the last give the last one, below 1 the first.

    The rows up to the end of the page are a top-k, computed once and written; how many there are tells whether the
    page is beyond the last."""
    page = max(page, 1)
    top = cut(df.orderBy(*order).limit(page * size), "page")
    last = max(1, -(-top.count() // size))
    return top.orderBy(*order).offset((min(page, last) - 1) * size).limit(size)
