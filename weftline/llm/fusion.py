"""One ranking from several differently-scaled scores (problem 1): reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ranking import null_safe_join, rank_table
from weftline.session import cut

#: The constant of the published method: how much the first places count beyond the following ones.
RRF_CONSTANT = 60


def usable(score):
    """The score as double; null where it is null, NaN, infinite or negative."""
    s = score.cast("double")
    return F.when((s >= 0) & ~F.isnan(s) & (s != float("inf")), s)


def fuse_rankings(df: DataFrame, keys: list[str], scores: list[str], k: int = RRF_CONSTANT) -> DataFrame:
    """Adds ``rank_<score>`` for each score and ``fused``, the sum of 1 / (k + rank) over the scores.

    Ranks are competition ranks inside ``keys``, highest score first; equal scores share a rank, and a score that is
    null, NaN, infinite or negative shares the rank after all usable ones, so scales and ranges never matter.
    Repeated rows are ranked as they come; an empty table gives no rows. The columns of ``df`` are all kept; a
    column that is already named ``fused`` or ``rank_<score>`` is replaced.

    ``df`` is computed and written once; each score's ranks are made from that table's keys and the score alone, one
    row for each different score, and joined with it."""
    base = cut(df.drop("fused", *[f"rank_{s}" for s in scores]), "candidates")
    out, fused = base, F.lit(0.0)
    for i, s in enumerate(scores):
        ranks = rank_table(base.select(*keys, usable(F.col(s)).alias(f"_u{i}")), keys, f"_u{i}", f"rank_{s}")
        out = null_safe_join(out.withColumn(f"_u{i}", usable(F.col(s))), ranks, [*keys, f"_u{i}"]).drop(f"_u{i}")
        fused = fused + F.lit(1.0) / (F.col(f"rank_{s}") + F.lit(k))
    return out.withColumn("fused", fused)


def query_candidates(terms: DataFrame, tfidf: DataFrame, page_meta: DataFrame) -> DataFrame:
    """(query_id, url, tfidf, pagerank): the pages that have a row for a query's word, each once, with its best usable
    tf-idf and the pagerank of its latest row. Words are compared without outer blanks and in lower case; null words
    and urls match nothing. Both joins shuffle: none of the tables has a bounded size."""
    norm = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    q = terms.select("query_id", norm(F.col("word")).alias("_w")).where(F.col("_w").isNotNull())
    rows = tfidf.select(norm(F.col("word")).alias("_w"), "url", usable(F.col("tfidf")).alias("tfidf")).where(F.col("_w").isNotNull() & F.col("url").isNotNull())
    meta = page_meta.select(F.col("url").alias("_u"), "ranked_at", "pagerank").where(F.col("url").isNotNull())
    hits = rows.join(q, "_w").select("query_id", "url", "tfidf")
    joined = hits.join(meta, F.col("url") == F.col("_u"), "left")
    # Grouping by (query_id, url) after a join on url needs no further shuffle.
    best = joined.groupBy("query_id", "url").agg(F.max("tfidf").alias("tfidf"), F.max(F.struct("ranked_at", usable(F.col("pagerank")).alias("p"))).alias("m"))
    return best.select("query_id", "url", "tfidf", F.col("m.p").alias("pagerank"))


def top_per_query(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of each query by fused score, ties by url. The limit is applied in each task before the
    shuffle, so no task sees all candidates of a query."""
    w = Window.partitionBy("query_id").orderBy(F.col("fused").desc(), "url")
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
