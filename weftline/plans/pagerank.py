"""PageRank over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import html as H
from weftline.functions.url import is_skippable_href, legacy_rank_url, normalize_url, resolve_url
from weftline.session import cut, remove

DAMPING, ROUNDS, TOLERANCE, LINKS_PER_PAGE = 0.85, 20, 0.001, 30


def links_of(found: DataFrame, most: int = LINKS_PER_PAGE, legacy: bool = False) -> DataFrame:
    """(src, dst, pos) of pages (url, hrefs): the first ``most`` different targets of each page, in canonical form,
    without the page itself. ``legacy`` gives targets as the older form of urls did, always with a port and without
    their query, which the canonical urls of pages rarely equal."""
    to_url = legacy_rank_url if legacy else resolve_url
    links = found.select("url", F.posexplode("hrefs").alias("pos", "href")).where(~is_skippable_href(F.col("href")))
    target = links.select(normalize_url(F.col("url")).alias("src"), to_url(F.col("url"), F.col("href")).alias("dst"), "pos").where(F.col("dst").isNotNull() & (F.col("dst") != F.col("src")))
    first = target.groupBy("src", "dst").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("src").orderBy("pos", "dst")
    return first.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def page_links(pages: DataFrame, most: int = LINKS_PER_PAGE, limit: int | None = H.PAGE_BYTES, legacy: bool = False) -> DataFrame:
    """``links_of`` pages (url, page, perhaps content_type), one row each."""
    charset = F.col("content_type") if "content_type" in pages.columns else None
    return links_of(pages.select("url", H.hrefs(H.page_text(F.col("page"), charset, limit)).alias("hrefs")), most, legacy)


def pagerank(vertices: DataFrame, edges: DataFrame, rounds: int = ROUNDS, tolerance: float | None = TOLERANCE, damping: float = DAMPING, cut_every: int = 4, initial: DataFrame | None = None) -> DataFrame:
    """(id, rank) of vertices (id) and distinct edges (src, dst).

    A vertex shares its rank over its out-links; what goes to no vertex is lost, and the rank of vertices without
    links is spread evenly. Stops after ``rounds``, or when no rank changes by ``tolerance`` or more (never, if None).
    An empty graph gives no rows. ``initial`` (id, rank) are the ranks of an earlier run to go on from; vertices that are
    new since start with an equal share.

    Edges with out-degrees are written once, bucketed by nothing but their source's hash; each round joins, sums with
    map-side partial sums, so that a target of very many links is no bottleneck, and makes one small aggregate of the
    greatest change and the dangling rank. Lineage is cut every few rounds in the shared folder; a written table of
    ranks goes when the next one is there."""
    v = cut(vertices.select("id").distinct(), "vertices")
    n = v.count()
    if n == 0:
        return v.withColumn("rank", F.lit(0.0))
    out_degree = edges.groupBy("src").agg(F.count("*").alias("_out"))
    e = cut(edges.join(out_degree, "src").select("src", "dst", "_out").repartition("src"), "edges")
    state = v.join(out_degree.select(F.col("src").alias("id"), F.lit(False).alias("_d")), "id", "left").select("id", F.coalesce("_d", F.lit(True)).alias("dangling"), F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("change"))
    if initial is not None:
        old = initial.select("id", F.col("rank").alias("_old"))
        state = state.join(old, "id", "left").select("id", "dangling", F.coalesce("_old", "rank").alias("rank"), "change")
    state = written = cut(state, "ranks")
    spread = state.agg(F.sum(F.when(F.col("dangling"), F.col("rank")))).first()[0] or 0.0
    for k in range(1, rounds + 1):
        shares = e.join(state.select(F.col("id").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("rank") / F.col("_out")).alias("_in"))
        new = F.lit((1 - damping) / n + damping * spread / n) + F.lit(damping) * F.coalesce("_in", F.lit(0.0))
        state = state.join(shares.withColumnRenamed("dst", "id"), "id", "left").select("id", "dangling", new.alias("rank"), F.abs(new - F.col("rank")).alias("change"))
        if k % cut_every == 0 or k == rounds or tolerance is not None:
            state = cut(state, "ranks")
            remove(written)
            written = state
        row = state.agg(F.max("change").alias("c"), F.sum(F.when(F.col("dangling"), F.col("rank"))).alias("s")).first()
        spread = row["s"] or 0.0
        if tolerance is not None and row["c"] < tolerance:
            break
    return state.select("id", "rank")
