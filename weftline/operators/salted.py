"""Per-key results when a handful of keys own most rows: two-stage salted aggregation (problem 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_word(word: Column) -> Column:
    """A word without outer blanks, in lower case."""
    return F.lower(F.regexp_replace(word, r"^\s+|\s+$", ""))


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """(key, rows, all_rows): the keys that have at least ``share`` of all rows of ``df``; null keys and their rows
    belong to the total, but a null key never comes out.

    One counting pass with map-side partial counts, so a heavy key sends one row per task. At most ``1 / share``
    rows come out, whatever the data: that is the proven bound of everything that is broadcast from here."""
    counts = df.groupBy(key).agg(F.count("*").alias("rows"))
    total = df.agg(F.count("*").alias("all_rows"))
    # The broadcast side is one row.
    return counts.join(F.broadcast(total), F.col("rows") >= F.lit(share) * F.col("all_rows")).where(F.col(key).isNotNull())


def salted_counts(df: DataFrame, key: str, item: str, value: str, share: float = 1e-4) -> DataFrame:
    """(key, rows, items, total): per key its rows, its distinct ``item`` values and the sum of ``value`` over them.

    Repeated rows of a (key, item) count once in ``items``, and with their largest ``value`` in ``total``; a null
    value counts as 0, a null item as no item, a null key gives no row; an empty table gives no rows. Other columns
    of ``df`` do not matter, whatever their names.

    A key with at least ``share`` of all rows gets a salt, a hash of the item, over as many groups as it has times
    that share: every group of stage one then holds about ``share`` of the rows at most, at any size of the table.
    Groups of a key have no item in common, so their partial results simply add up in stage two. The salt is a hash
    and not a random number because a task that runs again, after an executor is lost, must send each row to the
    same place. One shuffle carries the rows; what follows are partial results."""
    slim = df.select(F.col(key).alias("_k"), F.col(item).alias("_i"), F.col(value).alias("_v"))
    heavy = heavy_keys(slim.select("_k"), "_k", share).select(
        F.col("_k").alias("_hk"), F.ceil(F.col("rows") / (F.lit(share) * F.col("all_rows"))).alias("_salts")
    )
    # Rows without an item need not meet: they are spread by the part they are read in.
    by = F.when(F.col("_i").isNull(), F.spark_partition_id().cast("bigint")).otherwise(F.xxhash64("_i"))
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(by, F.col("_salts"))).otherwise(F.lit(0)).cast("int")
    # heavy has at most 1 / share rows.
    spread = slim.where(F.col("_k").isNotNull()).join(F.broadcast(heavy), F.col("_k") == F.col("_hk"), "left")
    spread = spread.select("_k", salt.alias("_s"), "_i", "_v").repartition("_k", "_s")
    once = spread.groupBy("_k", "_s", "_i").agg(F.count("*").alias("_n"), F.max("_v").alias("_v"))
    partial = once.groupBy("_k", "_s").agg(
        F.sum("_n").alias("_n"),
        F.count("_i").alias("_d"),
        F.sum(F.when(F.col("_i").isNotNull(), F.coalesce("_v", F.lit(0)))).alias("_t"),
    )
    return partial.groupBy(F.col("_k").alias(key)).agg(
        F.sum("_n").cast("bigint").alias("rows"),
        F.sum("_d").cast("bigint").alias("items"),
        F.coalesce(F.sum("_t"), F.lit(0)).cast("bigint").alias("total"),
    )
