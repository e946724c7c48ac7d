"""Ranks and numbers inside groups of any size, without one task ever holding a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_bucket(score: Column, bits: int = 8) -> Column:
    """An order-preserving integer of a non-negative double: its exponent and the first ``bits`` bits of its
    mantissa. Buckets are of equal relative width, so heavy-tailed scores spread over many of them."""
    # Positive doubles compare like their IEEE bit patterns; log2 gives the same order without casting bits.
    return F.when(score > 0, F.floor(F.log2(score) * (1 << bits))).otherwise(F.lit(-(2000 << bits))).cast("bigint")


def rank_by_score(df: DataFrame, keys: list[str], score: str, out: str) -> DataFrame:
    """Adds ``out``: the competition rank of ``score`` (highest first) among the rows of the same ``keys``; see
    ``rank_table``."""
    return null_safe_join(df, rank_table(df, keys, score, out), [*keys, score])


def rank_table(df: DataFrame, keys: list[str], score: str, out: str, bits: int = 8, fine_bits: int = 20) -> DataFrame:
    """(keys, score, out): the competition rank of each different ``score`` (highest first) among the rows of the same
    ``keys``.

    Equal scores get the same rank; a null score ranks after every other one, all of them equal. Scores must be null or
    not negative. Rows are first counted per (keys, score) with map-side partial sums, then ranked in three levels:
    over buckets of the score's magnitude, over finer buckets inside those, and over the different scores inside a fine
    bucket. No step collects all rows of a key: the first level sees one row per bucket, the second at most
    2 ** (fine_bits - bits) rows, the last the different scores of one relative width of 2 ** -fine_bits."""
    counts = df.groupBy(*keys, score).agg(F.count("*").alias("_n"))
    bucket = lambda n: F.coalesce(order_bucket(F.col(score), n), F.lit(-(4000 << n)).cast("bigint"))
    counts = counts.withColumn("_f", bucket(fine_bits)).withColumn("_b", F.shiftright(F.col("_f"), fine_bits - bits))
    fine = counts.groupBy(*keys, "_b", "_f").agg(F.sum("_n").alias("_fn"))
    coarse = fine.groupBy(*keys, "_b").agg(F.sum("_fn").alias("_bn"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.withColumn("_above", F.coalesce(F.sum("_bn").over(before(Window.partitionBy(*keys).orderBy(F.col("_b").desc()))), F.lit(0))).drop("_bn")
    fine = fine.withColumn("_over", F.coalesce(F.sum("_fn").over(before(Window.partitionBy(*keys, "_b").orderBy(F.col("_f").desc()))), F.lit(0))).drop("_fn")
    fine = null_safe_join(fine, coarse, [*keys, "_b"]).withColumn("_up", F.col("_above") + F.col("_over")).select(*keys, "_f", "_up")
    inside = Window.partitionBy(*keys, "_f").orderBy(F.col(score).desc_nulls_last())
    counts = counts.withColumn("_in", F.coalesce(F.sum("_n").over(before(inside)), F.lit(0)))
    return null_safe_join(counts, fine, [*keys, "_f"]).select(*keys, score, (F.col("_up") + F.col("_in") + 1).cast("bigint").alias(out))


def number_rows(df: DataFrame, keys: list[str], by: list[str], out: str, salts: int | None = None) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... over the rows of the same ``keys``, in an arbitrary but repeatable order.

    Rows are spread by a hash of ``by`` over ``salts`` parts of each key; each part is numbered by itself and
    shifted by the sizes of the parts before it, so a key with a third of all rows is numbered by many tasks.
    ``by`` must identify a row; by default there are as many salts as a shuffle has partitions, 256 at least.
    """
    salts = salts or max(256, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = df.withColumn("_s", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(*keys, "_s").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_o", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    inside = Window.partitionBy(*keys, "_s").orderBy(*by)
    numbered = salted.withColumn("_r", F.row_number().over(inside) - 1)
    return null_safe_join(numbered, offsets, [*keys, "_s"]).withColumn(out, (F.col("_r") + F.col("_o")).cast("bigint")).drop("_s", "_r", "_o")


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in which nulls match nulls; the columns of ``on`` come out once, from the left."""
    r = right.select([F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = None
    for c in on:
        one = left[c].eqNullSafe(r[f"_r_{c}"])
        cond = one if cond is None else cond & one
    return left.join(r, cond).drop(*[f"_r_{c}" for c in on])
