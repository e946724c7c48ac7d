from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from weftline.plans import catalog
from weftline.plans import crawl as C
from weftline.plans import index as I
from weftline.plans import pagerank as P
from weftline.plans import search as S


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_cap(spark):
    got = [spark.range(1).select(I.document_frequency_cap(F.lit(n))).first()[0] for n in (1, 6, 7, 100, 1000)]
    assert got == [100, 100, 1, 15, 100]


def test_index_and_weights(spark):
    body = lambda s: f"<html><body>{s}{' filler' * 20}</body></html>".encode()
    data = [(i, f"http://h/{i}", "text/html", body("cat cat dog " + ("bird bird" if i == 1 else "")), None) for i in range(9)]
    crawl = spark.createDataFrame([(c, u, t, bytearray(p), s) for c, u, t, p, s in data], "crawl_id bigint, url string, content_type string, page binary, stored_at timestamp")
    index, vocab, weights = I.build(crawl)
    assert {r["word"]: r["df"] for r in vocab.collect()} == {"cat": 1, "filler": 1, "bird": 1}  # 15 % of 9 pages
    w = {(r["word"], r["url"]): r for r in weights.collect()}
    assert len(w) == 9 + 9 + 1
    r = w["bird", "http://h/1"]
    assert r["tf"] == pytest.approx(1 + math.log(2)) and r["idf"] == pytest.approx(math.log(10 / 2)) and r["tfidf"] == pytest.approx(r["tf"] * r["idf"])
    assert index.where("word = 'dog'").count() == 0
    assert I.build(crawl.limit(0))[2].count() == 0


def test_pagerank_first_round(spark):
    v = spark.createDataFrame([("A",), ("B",), ("C",)], "id string")
    e = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C")], "src string, dst string")
    one = {r["id"]: r["rank"] for r in P.pagerank(v, e, rounds=1, tolerance=None).collect()}
    assert one["A"] == pytest.approx(0.144444, abs=1e-6) and one["B"] == pytest.approx(0.286111, abs=1e-6) and one["C"] == pytest.approx(0.569444, abs=1e-6)
    full = P.pagerank(v, e, rounds=20, tolerance=1e-6).agg(F.sum("rank")).first()[0]
    assert full == pytest.approx(1.0)
    leak = P.pagerank(v.limit(1).select(F.lit("A").alias("id")), e.limit(1).select(F.lit("A").alias("src"), F.lit("X").alias("dst")), rounds=1, tolerance=None).first()
    assert leak["rank"] == pytest.approx(0.15)
    assert P.pagerank(v.limit(0), e).count() == 0


def test_links(spark):
    pages = spark.createDataFrame([("http://h/a/", bytearray(b'<a href="b">x</a><a href=\'/c#q\'>y</a><A HREF=b>z</A><a href="mailto:m">m</a><a href="">e</a><a href="/a/">self</a>'))], "url string, page binary")
    assert [(r["dst"], r["pos"]) for r in P.page_links(pages).orderBy("pos").collect()] == [("http://h/a/b", 0), ("http://h/c", 1)]


def test_whole_pages_on_demand(spark):
    pages = spark.createDataFrame([("http://h/1", bytearray(b"<p>" + b"x" * 30_000 + b'<a href="/2">'))], "url string, page binary")
    assert P.page_links(pages).count() == 0 and P.page_links(pages, limit=None).count() == 1


def test_score(spark):
    f = lambda url, city=None, title="cat": spark.range(1).select(S.score(F.lit(0.1), F.lit(2.0), F.lit(title), F.lit(url), F.lit("s"), ["cat", "zebra"], F.lit(1.0), city)).first()[0]
    assert f("http://x/") == pytest.approx(0.977890, abs=1e-6)
    assert f("http://x/", "x/") == pytest.approx(1.173468, abs=1e-6)
    assert f("http://x/" + "y" * 171) == pytest.approx(0.977890 / 2, abs=1e-6)


def test_search_needs_all_words_and_dedups_titles(spark):
    post = spark.createDataFrame([("cat", "u1", 1), ("dog", "u1", 1), ("cat", "u2", 1), ("cat", "u3", 1), ("dog", "u3", 1)], "word string, url string, tf int")
    wt = spark.createDataFrame([("cat", "u1", 1.0), ("cat", "u3", 3.0)], "word string, url string, tfidf double")
    meta = spark.createDataFrame([("u1", "Home ", None, None), ("u3", "home", "s", float("nan"))], "url string, title string, snippet string, pagerank double")
    assert [r["url"] for r in S.search(post, wt, meta, "the cat DOG").collect()] == ["u3"]
    assert S.search(post, wt, meta, "the").count() == 0
    blank = spark.createDataFrame([("a", "Home ", 1.0), ("b", "home", 2.0), ("c", "", 1.0), ("d", "", 1.0)], "url string, title string, score double")
    assert S.best_per_title(blank).count() == 3


def test_spell_and_complete(spark):
    words = spark.createDataFrame([("bat",), ("cat",), ("cart",)], "word string")
    t = spark.createDataFrame([("caat",), ("cat",), ("zzzzz",)], "token string")
    assert rows(S.spell(words, t)) == [("caat", "cart"), ("cat", "cat"), ("zzzzz", "zzzzz")]
    assert [r[0] for r in S.complete(words, " CA").collect()] == ["cart", "cat"] and S.complete(words, "").count() == 0


def test_crawl_rounds(spark):
    web = spark.createDataFrame([("http://h/1", bytearray(b'<a href="/2">')), ("http://h/2", bytearray(b'<a href="/1"><a href="/3"><a href="/login">')), ("http://h/3", bytearray(b""))], "url string, page binary")
    seeds = spark.createDataFrame([("HTTP://H/1#x",), (None,), ("http://h/1",)], "url string")
    assert rows(C.crawl(web, seeds, 5)) == [("http://h/1", 0), ("http://h/2", 1), ("http://h/3", 2)]
    assert rows(C.crawl(web, seeds, 1)) == [("http://h/1", 0)]


def test_crawl_caps_pages_and_not_urls(spark):
    web = spark.createDataFrame([(f"http://h/{c}", bytearray(b'<a href="/a"><a href="/s"><a href="/t"><a href="http://g/1">')) for c in "prst"] + [("http://g/1", bytearray(b""))], "url string, page binary")
    seeds = spark.createDataFrame([(f"http://h/{c}",) for c in "abcdpr"], "url string")
    assert rows(C.crawl(web, seeds, 3, 2)) == [("http://g/1", 1), ("http://h/p", 0), ("http://h/r", 0)]  # a to d have no page
    assert rows(C.crawl(web, seeds, 3, 3)) == [("http://g/1", 1), ("http://h/p", 0), ("http://h/r", 0), ("http://h/s", 1)]


def test_links_of_long_pages(spark, tmp_path):
    page = bytearray(b"<p>" + b"x" * 30_000 + b'<a href="/2">')
    web = spark.createDataFrame([("http://h/1", page), ("http://h/2", bytearray(b""))], "url string, page binary")
    assert rows(C.crawl(web, web.select("url").limit(1), 2)) == [("http://h/1", 0), ("http://h/2", 1)]
    spark.createDataFrame([(1, "http://h/1", "text/html", page, None)], "crawl_id bigint, url string, content_type string, page binary, stored_at timestamp").write.parquet(f"{tmp_path}/crawl.parquet")
    assert rows(catalog.QUERIES["html_links"](spark, str(tmp_path))) == [("http://h/1", 0, "/2")]


def test_crawl_runs_until_the_frontier_is_empty(spark):
    link = {1: "https://URLdefense.com/v3/__http%3A%2F%2Fh%2F2__;!x", 2: "/3", 3: "/4?of=urldefense", 5: "/6"}
    web = spark.createDataFrame([(f"http://h/{i}", bytearray(f'<a href="{link.get(i, "")}">'.encode())) for i in (1, 2, 3, 5)] + [("http://h/4?of=urldefense", bytearray(b'<a href="/5">'))], "url string, page binary")
    seeds = spark.createDataFrame([("http://h/1",)], "url string")
    assert rows(C.crawl(web, seeds)) == [("http://h/1", 0), ("http://h/2", 1), ("http://h/3", 2), ("http://h/4?of=urldefense", 3), ("http://h/5", 4)]
    assert rows(C.crawl(web, seeds, page_cap=2)) == [("http://h/1", 0), ("http://h/2", 1)]


def test_incremental_index_equals_batch(spark, tmp_path):
    from weftline.streaming.incremental import index_incrementally

    page = lambda i: (i, f"http://h/{i}", "text/html", bytearray(b"<body>" + f"cat cat w{chr(97 + i)} w{chr(97 + i)} ".encode() + b"x " * 80 + b"</body>"), None)
    schema = "crawl_id bigint, url string, content_type string, page binary, stored_at timestamp"
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([page(0), page(1)], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    first = rows(index_incrementally(stream, out))
    spark.createDataFrame([page(1), page(2)], schema).coalesce(1).write.mode("append").parquet(src)
    both = rows(index_incrementally(stream, out))
    assert set(first) < set(both) and {r[1] for r in both} == {"http://h/0", "http://h/1", "http://h/2"} and len(both) == len(set(both))


def test_incremental_index_takes_the_latest_fetch_and_the_cap(spark, tmp_path):
    from weftline.streaming.incremental import maintain_index

    page = lambda w: bytearray(b"<body>" + f"{w} {w} ".encode() + b"x " * 80 + b"</body>")
    ts = lambda k: f"timestamp '2025-01-0{k} 00:00:00'"
    schema = "crawl_id bigint, url string, content_type string, page binary"
    src = f"{tmp_path}/in"
    for k, rows_ in ((2, [(1, "http://h/1", None, page("new"))]), (1, [(2, "http://h/1", None, page("old"))] + [(10 + i, f"http://h/{10 + i}", None, page("cat")) for i in range(8)])):
        spark.createDataFrame(rows_, schema).withColumn("stored_at", F.expr(ts(k))).coalesce(1).write.mode("append").parquet(src)
    whole = spark.read.parquet(src)
    for once in (1, 8):
        stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", once).parquet(src)
        got = maintain_index(stream, f"{tmp_path}/out{once}")
        for a, b in zip(got, I.build(whole)):
            assert rows(a) == rows(b)
    assert {r["word"]: r["df"] for r in got[1].collect()} == {"new": 1, "cat": 1, "x": 1}


def test_throttle(spark, tmp_path):
    from weftline.streaming.incremental import throttle

    data = [("a", 0), ("a", 500), ("a", 1000), ("b", 0), ("a", 1500), ("a", 9000)]
    spark.createDataFrame(data, "h string, t bigint").selectExpr("h as host", "timestamp_millis(t) as ts", "double(1) as delay").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("host string, ts timestamp, delay double").parquet(f"{tmp_path}/in")
    assert rows(throttle(stream, f"{tmp_path}/out")) == [("a", 5, 3, 9000), ("b", 1, 0, 0)]
    spark.createDataFrame([("a", 9100), ("c", 5)], "h string, t bigint").selectExpr("h as host", "timestamp_millis(t) as ts", "double(1) as delay").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert rows(throttle(stream, f"{tmp_path}/out")) == [("a", 6, 4, 10000), ("b", 1, 0, 0), ("c", 1, 0, 5)]


def test_grant_times_equal_a_loop(spark):
    import random

    from weftline.streaming.incremental import grant_times

    rnd = random.Random(3)
    data = [(h, rnd.randrange(60_000), ms) for h, ms in (("a", 700), ("b", 2500), ("c", 0)) for _ in range(40)]
    want, state = [], {"b": 30_000}
    last = spark.createDataFrame(list(state.items()), "host string, last bigint")
    for h, t, ms in sorted(data):
        state[h] = max(t, state[h] + ms) if h in state else t
        want.append((h, t, ms, state[h]))
    got = grant_times(spark.createDataFrame(data, "host string, at bigint, ms bigint"), last, slice_ms=5_000)
    assert rows(got) == sorted(want, key=repr)


def test_delays(spark):
    from weftline.streaming.incremental import millis

    d = spark.createDataFrame([(None,), (-1.0,), (float("nan"),), (float("inf"),), (0.0,), (1.2345,)], "d double")
    assert [r[0] for r in d.select(millis(F.col("d"))).collect()] == [1000, 1000, 1000, 1000, 0, 1235]


def test_crawl_obeys_robots(spark):
    web = spark.createDataFrame([("http://h/1", bytearray(b'<a href="/no/2"><a href="/no/but/3">')), ("http://h/no/2", bytearray(b"")), ("http://h/no/but/3", bytearray(b""))], "url string, page binary")
    hosts = spark.createDataFrame([("H", 200, "User-agent: *\r\nDisallow: /no\nAllow: /no/but")], "host string, robots_status int, robots_txt string")
    seeds = spark.createDataFrame([("http://h/1",)], "url string")
    assert rows(C.crawl(web, seeds, hosts=hosts)) == [("http://h/1", 0), ("http://h/no/but/3", 1)]
    missing = hosts.withColumn("robots_status", F.lit(404))
    assert C.crawl(web, seeds, hosts=missing).count() == 3


def test_crawl_reads_links_in_the_charset_of_the_page(spark):
    web = spark.createDataFrame([("http://h/1", "text/html; charset=ISO-8859-1", bytearray('<a href="/é">'.encode("latin-1"))), ("http://h/é", None, bytearray(b""))], "url string, content_type string, page binary")
    assert C.crawl(web, web.limit(1).select("url")).count() == 2


def test_pagerank_goes_on_from_earlier_ranks(spark):
    v = spark.createDataFrame([("A",), ("B",), ("C",)], "id string")
    e = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C")], "src string, dst string")
    two = dict(P.pagerank(v, e, 2, None).collect())
    again = dict(P.pagerank(v, e, 1, None, initial=P.pagerank(v, e, 1, None)).collect())
    assert again == pytest.approx(two)


def test_spell_without_broadcast(spark):
    words = spark.createDataFrame([("bat",), ("cat",), ("cart",), ("horse",), ("a",)], "word string")
    t = spark.createDataFrame([("caat",), ("cat",), ("zzzzz",), ("hrose",), ("",)], "token string")
    assert rows(S.spell(words, t, few=0)) == rows(S.spell(words, t))


def test_word_filter_reaches_the_scan_of_a_stored_index(spark, tmp_path):
    post = spark.createDataFrame([(" Cat ", "u1", 1), ("dog", "u2", 2)], "word string, url string, tf int")
    S.store_index(post, f"{tmp_path}/p", F.lower(F.trim("word")))
    found = S.candidates(spark.read.parquet(f"{tmp_path}/p"), ["cat"])
    assert [r[0] for r in found.collect()] == ["u1"]
    assert "PushedFilters: [IsNotNull(word), EqualTo(word,cat)]" in found._jdf.queryExecution().toString() or "EqualTo(word,cat)" in found._jdf.queryExecution().toString()


def test_pages_are_never_shuffled(spark, tmp_path):
    schema = "crawl_id bigint, url string, content_type string, page binary, stored_at timestamp"
    spark.createDataFrame([(1, "http://h/1", None, bytearray(b"<p>x"), None)], schema).write.parquet(f"{tmp_path}/c")
    crawl = spark.read.parquet(f"{tmp_path}/c")
    plans = [
        I.latest(crawl, digest=F.md5("page")),
        P.links_of(I.latest(crawl, hrefs=F.split(F.col("page").cast("string"), "x"))),
        C.web_links(crawl),
    ]
    for df in plans:
        above = df._jdf.queryExecution().executedPlan().toString().split("Exchange")[:-1]
        assert above and all("page#" not in part for part in above)


def test_spread_asks_the_scan(spark, tmp_path):
    from weftline.session import scan_parts, spread

    spark.range(100).repartition(9).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    assert scan_parts(t.where("id > 3").select("id")) >= 1 and scan_parts(t.join(t, "id")) is None
    few = t.coalesce(1)
    assert spread(few, "id") is few  # a plan that is no plain scan
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    assert spread(spark.read.parquet(f"{tmp_path}/one"), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_written_tables_go_when_they_are_removed(spark):
    import os

    from weftline.session import cut, remove

    df = cut(spark.range(3))
    path = df._cut_path.removeprefix("file://")
    assert os.path.isdir(path) and df.count() == 3
    remove(df)
    remove(spark.range(1))
    assert not os.path.isdir(path)


def test_catalogue_is_complete():
    q, s = catalog.queries(), catalog.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 90
    assert set(q) - set(s) == {"sample_bernoulli"}
