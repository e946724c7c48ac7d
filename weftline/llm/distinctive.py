"""How distinctive a term is per record (problem 6): tf-idf from distributed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.salted import heavy_keys, normal_word


def distinct_terms(postings: DataFrame) -> DataFrame:
    """(url, word, tf): each word of each page once, without outer blanks and in lower case. Of repeated rows, also in
    other spellings, the largest tf counts; a null or non-positive tf counts as 1; null words, blank words and null
    urls are left out."""
    w = postings.select("url", normal_word(F.col("word")).alias("word"), F.greatest(F.coalesce(F.col("tf"), F.lit(1)), F.lit(1)).cast("bigint").alias("tf"))
    # By url alone, so that a page's words end up together and later counts of pages see each url once.
    return w.where(F.col("url").isNotNull() & (F.col("word") != "")).repartition("url").groupBy("url", "word").agg(F.max("tf").alias("tf"))


def term_scores(terms: DataFrame, only: DataFrame | None = None, share: float = 1e-4, spread: int = 1024) -> DataFrame:
    """(url, word, tf, df, score) of distinct (url, word, tf) rows; of the urls of ``only``, if given, with counts over
    all pages all the same. The rows are read several times: give a written table.

    score = tf / (terms of the page) * ln((1 + pages) / (1 + df)): smoothed, so that a word of every page scores 0
    and a new word is defined, and normalised by the page's length, the sum of its tf. An empty table gives no rows.

    ``df`` comes from map-side partial counts and is joined back. A word with at least ``share`` of all rows would
    pull its rows into one task in that join, so those words (1 / share of them at most) are broadcast, and their
    rows travel under ``spread`` placeholder keys, which match nothing, instead of their own key."""
    pages = terms.select("url").distinct().agg(F.count("*").alias("_n"))
    df = terms.groupBy("word").agg(F.count("*").alias("df"))
    heavy = heavy_keys(terms.select("word"), "word", share).select(F.col("word").alias("_hw"), F.col("rows").alias("_hdf"))
    wanted = terms if only is None else terms.join(only.select("url"), "url", "left_semi")
    sized = wanted.withColumn("_len", F.sum("tf").over(Window.partitionBy("url")))
    marked = sized.join(F.broadcast(heavy), F.col("word") == F.col("_hw"), "left")  # at most 1 / share rows
    key = F.when(F.col("_hw").isNull(), F.col("word")).otherwise(F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("url"), F.lit(spread)).cast("string")))
    joined = marked.withColumn("_key", key).join(df.select(F.col("word").alias("_key"), "df"), "_key", "left")
    counted = joined.withColumn("df", F.coalesce("_hdf", "df")).join(F.broadcast(pages))  # one row
    score = F.col("tf") / F.col("_len") * F.log((F.lit(1.0) + F.col("_n")) / (F.lit(1.0) + F.col("df")))
    return counted.select("url", "word", "tf", "df", score.alias("score"))


def most_distinctive(scores: DataFrame, keys: DataFrame, n: int = 1) -> DataFrame:
    """The ``n`` best words of each url of ``keys``; ties by word. A url without terms gives no row, a repeated key
    counts once."""
    w = Window.partitionBy("url").orderBy(F.col("score").desc(), "word")
    wanted = scores.join(keys.select("url").where(F.col("url").isNotNull()), "url", "left_semi")
    return wanted.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
