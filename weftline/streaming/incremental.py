"""Incremental index maintenance and per-host throttling with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import html as H
from weftline.functions.text import document_terms
from weftline.plans import index as I

_FETCH = "url string, stored_at timestamp, crawl_id bigint"


def _run(stream: DataFrame, path: str, sink) -> None:
    q = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()


def maintain_index(stream: DataFrame, path: str, limit: int | None = H.PAGE_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs a stream of crawl rows to its present end and returns (index, vocabulary, weights) of all rows so far: the
    same as ``plans.index.build`` over them.

    New files only are read when it runs again with the same ``path``: the checkpoint knows the old ones. Each
    micro-batch appends the fetch and the word counts of each of its urls; a batch that is repeated after a failure
    overwrites its own folders. The result takes the counts of each url's latest fetch: fetches are narrow rows, and
    caps and weights are made from counts, never from pages. ``limit`` bytes of a page are read, all if None."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        text, size = H.page_text(F.col("page"), F.col("content_type"), limit), F.octet_length("page")
        none = F.array().cast("array<string>")
        of_index = F.when((size >= H.LEAST_BYTES["index"]) & F.col("url").rlike("^(?i)https?://"), document_terms(H.body_for_index(text))).otherwise(none)
        of_weights = F.when(size >= H.LEAST_BYTES["tfidf"], document_terms(H.body_for_tfidf(text))).otherwise(none)
        when = F.struct(F.col("stored_at").alias("s"), F.col("crawl_id").alias("c"))
        words = F.map_from_arrays(F.array(F.lit("index"), F.lit("weights"), F.lit("page")), F.array(of_index, of_weights, F.array(F.lit(""))))
        pages = I.latest(batch, f=when, m=words)
        each = pages.select("url", F.col("f.s").alias("stored_at"), F.col("f.c").alias("crawl_id"), F.explode("m").alias("part", "words"))
        counts = each.select("url", "stored_at", "crawl_id", "part", F.explode("words").alias("word"))
        counts = counts.groupBy("url", "stored_at", "crawl_id", "part", "word").agg(F.count("*").alias("tf"))
        counts.write.mode("overwrite").parquet(f"{path}/parts/batch={batch_id}")

    _run(stream, path, sink)
    parts = stream.sparkSession.read.schema(f"{_FETCH}, part string, word string, tf bigint, batch int").parquet(f"{path}/parts")
    w = Window.partitionBy("url").orderBy(F.col("stored_at").desc_nulls_last(), F.col("crawl_id").desc(), F.col("batch").desc())
    newest = parts.where("part = 'page'").withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select("url", "batch")
    counts = parts.where("part <> 'page'").join(newest, ["url", "batch"]).select("url", "part", "word", "tf")
    total = newest.agg(F.count("*").alias("pages"))
    of = lambda name: counts.where(F.col("part") == name).select("url", "word", "tf")
    index = I.inverted_index(of("index"), total)
    vocab = I.vocabulary(index)
    return index, vocab, I.tfidf(of("weights"), vocab, total)


def index_incrementally(stream: DataFrame, path: str, limit: int | None = H.PAGE_BYTES) -> DataFrame:
    """(word, url, tf): the index of ``maintain_index``."""
    return maintain_index(stream, path, limit)[0]


def millis(delay: Column, default: float = 1.0) -> Column:
    """A delay in seconds as whole milliseconds; the default where it is null, not finite or negative."""
    d = delay.cast("double")
    usable = d.isNotNull() & ~F.isnan(d) & (d >= 0) & (d < float("inf"))
    return F.ceil(F.when(usable, d).otherwise(F.lit(default)) * 1000).cast("bigint")


def grant_times(requests: DataFrame, last: DataFrame | None = None, slice_ms: int = 3_600_000) -> DataFrame:
    """(host, at, ms, granted) of requests (host, at: bigint milliseconds, ms: the host's delay): when each is let through,
    in order of time: at once, or when the delay since the host's previous grant has passed; none is lost. ``last``
    (host, last) are the grants of earlier calls.

    With the requests of a host numbered k = 1, 2, ... the k-th grant is k * ms + max over j <= k of (at_j - j * ms), a
    running maximum. It is taken inside slices of time, then over the slices of a host, of which each is one row, so
    that no task ever holds all requests of a busy host."""
    r = requests.withColumn("_s", F.floor(F.col("at") / slice_ms))
    inside = Window.partitionBy("host", "_s").orderBy("at")
    r = r.withColumn("_k", F.row_number().over(inside))
    r = r.withColumn("_m", F.max(F.col("at") - F.col("_k") * F.col("ms")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    per = r.groupBy("host", "_s").agg(F.count("*").alias("_n"), F.max("_m").alias("_top"), F.max("ms").alias("_ms"))
    before = Window.partitionBy("host").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # Numbers of a slice are shifted by all requests before it, and so are the maxima of the slices before.
    per = per.withColumn("_max", F.max(F.col("_top") - F.col("_before") * F.col("_ms")).over(before))
    if last is not None:
        per = per.join(last.select("host", "last"), "host", "left").withColumn("_max", F.greatest("_max", "last")).drop("last")
    offsets = per.select("host", "_s", "_before", "_max")
    g = r.join(offsets, ["host", "_s"])
    k = F.col("_k") + F.col("_before")
    return g.select("host", "at", "ms", (k * F.col("ms") + F.greatest(F.col("_m") - F.col("_before") * F.col("ms"), F.col("_max"))).alias("granted"))


def throttle(stream: DataFrame, path: str, host: str = "host", at: str = "ts", delay: str = "delay") -> DataFrame:
    """Runs a stream of requests to its present end and returns (host, requests, waited, last): how many requests each
    host got, how many of them had to wait for its delay, and when the last one was let through, in milliseconds.

    The state is the last grant of each host, a row each, written with every micro-batch and read by the next; a batch
    that is repeated after a failure overwrites its own folders. A host has one delay in all requests of a micro-batch.
    Runs on with the same ``path``."""
    spark = stream.sparkSession
    state = "host string, last bigint, batch int"

    def sink(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        r = batch.select(F.col(host).alias("host"), F.unix_millis(F.col(at).cast("timestamp")).alias("at"), millis(F.col(delay)).alias("ms")).where("host is not null and at is not null")
        last = session.read.schema(state).parquet(f"{path}/last").where(F.col("batch") == batch_id - 1) if batch_id else None
        per = grant_times(r, last).groupBy("host").agg(F.count("*").alias("requests"), F.sum((F.col("granted") > F.col("at")).cast("bigint")).alias("waited"), F.max("granted").alias("last"))
        per.write.mode("overwrite").parquet(f"{path}/parts/batch={batch_id}")
        now = session.read.schema("host string, last bigint").parquet(f"{path}/parts/batch={batch_id}")
        if last is not None:
            now = now.unionByName(last.select("host", "last")).groupBy("host").agg(F.max("last").alias("last"))
        now.select("host", "last").write.mode("overwrite").parquet(f"{path}/last/batch={batch_id}")

    _run(stream, path, sink)
    parts = spark.read.schema("host string, requests bigint, waited bigint, last bigint, batch int").parquet(f"{path}/parts")
    return parts.groupBy("host").agg(F.sum("requests").alias("requests"), F.sum("waited").alias("waited"), F.max("last").alias("last"))
