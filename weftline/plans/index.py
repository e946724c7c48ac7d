"""The inverted index with capped document frequencies, and the term weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import html as H
from weftline.functions.text import document_terms
from weftline.operators.salted import heavy_keys
from weftline.session import cut

MAX_URLS, MAX_SHARE, MIN_COUNT, TERMS_PER_PAGE = 100, 0.15, 2, 60
PARTS = ("index", "weights")


def latest(crawl: DataFrame, url: Column | None = None, **columns: Column) -> DataFrame:
    """(url, the given columns): of each url what they give for the page that was stored last; fetches without a page do
    not count. The columns are computed where the pages lie, for repeated fetches in vain, and only they are shuffled
    to find the latest: the pages themselves never are."""
    w = Window.partitionBy("url").orderBy(F.col("stored_at").desc_nulls_last(), F.col("crawl_id").desc())
    key = F.col("url") if url is None else url
    seen = crawl.where(F.col("page").isNotNull()).select(key.alias("url"), "stored_at", "crawl_id", *[c.alias(n) for n, c in columns.items()])
    return seen.where(F.col("url").isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select("url", *columns)


def cached_pages(crawl: DataFrame, urls: DataFrame) -> DataFrame:
    """(url, html): the stored page of each of ``urls`` (url) that has one, whole and decoded. Rows of other urls are left
    out before anything is decoded; few urls are sent to the scan by Spark itself."""
    asked = crawl.join(urls.select("url").where(F.col("url").isNotNull()).distinct(), "url", "left_semi")
    return latest(asked, html=H.page_text(F.col("page"), F.col("content_type"), None))


def cached_page(crawl: DataFrame, url: str) -> DataFrame:
    """(url, html) of one url, no row if it has no page; the comparison reaches the scan."""
    return latest(crawl.where(F.col("url") == url), html=H.page_text(F.col("page"), F.col("content_type"), None))


def document_frequency_cap(pages: Column) -> Column:
    """How many pages a word keeps: 15 % of all, 100 at most, and 100 where 15 % is none."""
    share = F.floor(pages * MAX_SHARE)
    return F.greatest(F.lit(1), F.least(F.lit(MAX_URLS), F.when(share == 0, F.lit(MAX_URLS)).otherwise(share))).cast("bigint")


def inverted_index(counts: DataFrame, total_pages: DataFrame) -> DataFrame:
    """(word, url, tf) of the words that occur at least twice on the page, for each word the first urls up to the cap.

    ``total_pages`` is one row with ``pages``. The cap is a window group limit, so a word of all pages sends no more
    than its cap from each input part."""
    total = total_pages.select(document_frequency_cap(F.col("pages")).alias("_cap"))
    w = Window.partitionBy("word").orderBy("url")
    # A constant bound comes first, so that the limit goes below the shuffle; the cap itself is never above it.
    ranked = counts.where(F.col("tf") >= MIN_COUNT).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= MAX_URLS)
    return ranked.join(F.broadcast(total), F.col("_n") <= F.col("_cap")).select("word", "url", "tf")  # one row


def vocabulary(index: DataFrame) -> DataFrame:
    return index.groupBy("word").agg(F.count("*").alias("df"))


def tfidf(counts: DataFrame, vocab: DataFrame, total_pages: DataFrame) -> DataFrame:
    """(word, url, tf, idf, tfidf): of each page the 60 most frequent words, those of them in the index with a positive
    weight; tf = 1 + ln(count), idf = ln((pages + 1) / (df + 1)).

    The rows of words that are everywhere would meet in one task of the join; they travel under spread keys and take
    their df from the broadcast list of heavy words, which has at most 1 / share rows."""
    w = Window.partitionBy("url").orderBy(F.col("tf").desc(), "word")
    top = counts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= TERMS_PER_PAGE).select("url", "word", F.col("tf").alias("_c"))
    share = 1e-3
    heavy = heavy_keys(top.select("word"), "word", share).select("word").join(vocab, "word").select(F.col("word").alias("_hw"), F.col("df").alias("_hdf"))
    marked = top.join(F.broadcast(heavy), F.col("word") == F.col("_hw"), "left")
    key = F.when(F.col("_hw").isNull(), F.col("word")).otherwise(F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("url"), F.lit(1024)).cast("string")))
    joined = marked.withColumn("_key", key).join(vocab.select(F.col("word").alias("_key"), "df"), "_key", "left")
    sized = joined.withColumn("df", F.coalesce("_hdf", "df")).where(F.col("df") > 0).join(F.broadcast(total_pages))
    tf, idf = 1 + F.log(F.col("_c").cast("double")), F.log((F.col("pages") + 1.0) / (F.col("df") + 1.0))
    return sized.select("word", "url", tf.alias("tf"), idf.alias("idf"), (tf * idf).alias("tfidf")).where(F.col("idf") > 0)


def page_counts(crawl: DataFrame, limit: int | None = H.PAGE_BYTES, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """(url, part, word, tf): the words of each url's latest page for each wanted part, with its own body text and least
    length, and a row of the part "page" for every page. Words are taken from the pages where they lie and shuffled
    once, by url, to find the latest; they are counted there without another shuffle. Written, because later steps
    read it several times."""
    text, size = H.page_text(F.col("page"), F.col("content_type"), limit), F.octet_length("page")
    none = F.array().cast("array<string>")
    of = {
        "index": F.when((size >= H.LEAST_BYTES["index"]) & F.col("url").rlike("^(?i)https?://"), document_terms(H.body_for_index(text))).otherwise(none),
        "weights": F.when(size >= H.LEAST_BYTES["tfidf"], document_terms(H.body_for_tfidf(text))).otherwise(none),
    }
    names = [F.lit(p) for p in (*parts, "page")]
    pages = latest(crawl, m=F.map_from_arrays(F.array(*names), F.array(*[of[p] for p in parts], F.array(F.lit("")))))
    words = pages.select("url", F.explode("m").alias("part", "words")).select("url", "part", F.explode("words").alias("word"))
    return cut(words.groupBy("url", "part", "word").agg(F.count("*").alias("tf")), "counts")


def _part(counts: DataFrame, name: str) -> DataFrame:
    return counts.where(F.col("part") == name).select("url", "word", "tf")


def page_total(counts: DataFrame) -> DataFrame:
    return counts.where("part = 'page'").agg(F.count("*").alias("pages"))


def build_index(crawl: DataFrame, limit: int | None = H.PAGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(index, vocabulary) of a crawl: only what they need is taken from the pages."""
    counts = page_counts(crawl, limit, ("index",))
    index = inverted_index(_part(counts, "index"), page_total(counts))
    return index, vocabulary(index)


def build(crawl: DataFrame, limit: int | None = H.PAGE_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, vocabulary, weights) of a crawl. The words of the pages are counted and written now, the rest is lazy.
    ``limit`` bytes of a page are read, all if None."""
    counts = page_counts(crawl, limit)
    total = page_total(counts)
    index = inverted_index(_part(counts, "index"), total)
    vocab = vocabulary(index)
    return index, vocab, tfidf(_part(counts, "weights"), vocab, total)
