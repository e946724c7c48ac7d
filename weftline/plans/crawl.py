"""The crawl as a batch: the frontier drained in rounds over a table of pages that plays the web."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import html as H
from weftline.functions.url import is_skippable_href, normalize_url, resolve_url, robots_allowed, robots_rules, should_crawl, unwrap_redirect, url_host, url_rest
from weftline.session import cut, remove, scratch

HOST_CAP, PAGE_CAP = 500, 50_000


def host_capped(urls: DataFrame, order: list[Column | str], cap: int = HOST_CAP, taken: DataFrame | None = None) -> DataFrame:
    """The first ``cap`` urls of each host, fewer by those that ``taken`` (url) has of it already; the limit is applied
    before the shuffle too."""
    host = F.coalesce(url_host(F.col("url")), F.lit(""))
    first = urls.withColumn("_host", host).withColumn("_n", F.row_number().over(Window.partitionBy("_host").orderBy(*order))).where(F.col("_n") <= cap)
    if taken is not None:
        counts = taken.groupBy(host.alias("_host")).agg(F.count("*").alias("_taken"))
        first = first.join(counts, "_host", "left").where(F.col("_n") + F.coalesce("_taken", F.lit(0)) <= cap).drop("_taken")
    return first.drop("_host", "_n")


def too_early(last_access: Column, now: Column, delay: Column) -> Column:
    """Whether a host was asked less than its delay ago; a host that was never asked isn't."""
    passed = (F.unix_millis(now) - F.unix_millis(last_access)).cast("double")
    return F.coalesce(passed < F.ceil(F.coalesce(delay, F.lit(1.0)) * 1000), F.lit(False))


def host_rules(hosts: DataFrame) -> DataFrame:
    """(host, rules): the robots rules of each host; none where its robots file could not be had (a status other than
    200 to 299), so that everything is allowed there."""
    fetched = F.col("robots_status").between(200, 299)
    return hosts.where(F.col("host").isNotNull()).select(F.lower("host").alias("host"), robots_rules(F.when(fetched, F.col("robots_txt"))).alias("rules"))


def robots_permitted(urls: DataFrame, hosts: DataFrame) -> DataFrame:
    """The rows of ``urls`` (url) that the rules of their host allow; hosts without a row allow everything."""
    rules = host_rules(hosts).select(F.col("host").alias("_rh"), "rules")
    joined = urls.join(rules, url_host(F.col("url")) == F.col("_rh"), "left")
    return joined.where(F.coalesce(robots_allowed(F.col("rules"), url_rest(F.col("url"))), F.lit(True))).select(*urls.columns)


def web_links(web: DataFrame) -> DataFrame:
    """(url, hrefs): the canonical url and all link targets of each page of ``web`` (url, page, perhaps content_type,
    stored_at and crawl_id); of several pages of a canonical url the one stored last. Links are taken from the whole
    pages where they lie; only links are shuffled."""
    charset = F.col("content_type") if "content_type" in web.columns else None
    order = [F.col(c).desc_nulls_last() for c in ("stored_at", "crawl_id") if c in web.columns]
    found = web.where(F.col("page").isNotNull()).select(normalize_url(F.col("url")).alias("url"), H.hrefs(H.page_text(F.col("page"), charset, limit=None)).alias("hrefs"), *[c for c in ("stored_at", "crawl_id") if c in web.columns])
    w = Window.partitionBy("url").orderBy(*order, F.col("hrefs").desc())
    return found.where(F.col("url").isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select("url", "hrefs")


def crawl(web: DataFrame, seeds: DataFrame, rounds: int | None = None, host_cap: int = HOST_CAP, page_cap: int | None = PAGE_CAP, hosts: DataFrame | None = None) -> DataFrame:
    """(url, depth): the pages of ``web`` (see ``web_links``) reached from the seeds, breadth first. Seeds bypass the
    policy, but not the robots rules of ``hosts`` (host, robots_status, robots_txt), if given.

    Ends when the frontier is empty, after ``rounds``, if given, or before a round that ``page_cap`` pages precede; as in
    the reference, the round that reaches it is taken whole. Delays between requests shift pages to later rounds of a
    live crawl and lose none, so they do not matter here; ``streaming.incremental.throttle`` gives their times.

    A round takes the pages of its frontier, their links in canonical form, and leaves out what was seen. Only urls with
    a page count towards the cap of their host, over all rounds; a url beyond it is dropped for good, because its host
    has all its pages by then. Links, frontier, fetched and seen urls are written, so that neither lineage nor driver
    grows."""
    spark = web.sparkSession
    pages = cut(web_links(web), "links")
    frontier = cut(seeds.select(normalize_url(F.col("url")).alias("url")).where(F.col("url").isNotNull()).distinct(), "frontier")
    done, folder, old = None, scratch(spark, "fetched"), scratch(spark, "seen")
    for depth in count() if rounds is None else range(rounds):
        frontier.write.parquet(f"{old}/depth={depth}")
        seen = spark.read.schema("url string, depth int").parquet(old)
        there = frontier.join(pages.select("url"), "url", "left_semi")
        if hosts is not None:
            there = robots_permitted(there, hosts)
        host_capped(there, ["url"], host_cap, done).write.parquet(f"{folder}/depth={depth}")
        remove(frontier)
        done = spark.read.schema("url string, depth int").parquet(folder)
        if page_cap is not None and done.count() >= page_cap:
            break
        fetched = pages.join(done.where(F.col("depth") == depth), "url", "left_semi")
        links = fetched.select("url", F.explode("hrefs").alias("href")).where(~is_skippable_href(F.col("href")))
        new = links.select(resolve_url(F.col("url"), unwrap_redirect(F.col("href"))).alias("url")).where(F.col("url").isNotNull())
        frontier = cut(new.where(should_crawl(F.col("url"))).distinct().join(seen, "url", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
    return done
