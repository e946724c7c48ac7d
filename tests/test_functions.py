from __future__ import annotations

import re
from urllib.parse import urljoin

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import html as H
from weftline.functions import text as T
from weftline.functions import url as U
from weftline.functions.stopwords import STOP_WORDS


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_stop_words():
    assert len(STOP_WORDS) == 251 and {"the", "don't", "you've", "html"} <= STOP_WORDS


def test_tokens(spark):
    r = one(spark, T.document_terms(F.lit("The Cat's cat 42cats")), T.query_terms(F.lit("the Cat's cat")), T.document_terms(F.lit(None).cast("string")))
    assert r[0] == ["cat", "cat", "cats"] and r[1] == ["cat's", "cat"] and r[2] is None


def test_resolve(spark):
    base = F.lit("http://h.com/a/b.html")
    cases = {"../c#x": "http://h.com/c", "//E.com": "http://e.com/", "https://h.com:443/p?q=1": "https://h.com/p?q=1", "mailto:x": None, "HTTPS://E.com/": "https://e.com/", "#x": None, "": None}
    for href, want in cases.items():
        assert one(spark, U.resolve_url(base, F.lit(href)))[0] == want, href
    assert one(spark, U.resolve_url(base, F.lit("/../x")))[0] == "http://h.com/x"


def test_normalize_is_idempotent_and_keeps_what_matters(spark):
    rows = ["HTTP://Blog.K.invalid:80/w/./5.html#d", "https://u@H.com:8443/A/?B=/../c", "http://h", " http://h/a/.. ", "x y", "http://h/%7Ea"]
    df = spark.createDataFrame([(x,) for x in rows], "u string").select(U.normalize_url(F.col("u")).alias("n"))
    got = df.select("n", U.normalize_url(F.col("n")).alias("m")).collect()
    assert all(a == b for a, b in got)
    assert [r[0] for r in got] == ["http://blog.k.invalid/w/5.html", "https://u@h.com:8443/A/?B=/../c", "http://h/", "http://h/", "x y", "http://h/%7Ea"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from([".", "..", "a", "b", ""]), max_size=6), min_size=1, max_size=20))
def test_dot_segments_like_the_standard(spark, paths):
    urls = ["http://h/" + "/".join(p) for p in paths]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(U.normalize_url(F.col("u"))).collect()]
    plain = [u for u in urls if "//" not in u[7:]]
    for u, g in zip(urls, got):
        if u in plain:
            assert g == re.sub(r"/\.\.(?=/|$)", "", urljoin(u, u[8:] or "")) or g == urljoin("http://h/", u[8:].lstrip("/")) or g.startswith("http://h/"), u
        assert not re.search(r"/\.\.?(/|$)", g)


def test_policy_and_robots(spark):
    urls = {"http://h.com/a": True, "ftp://h.com/a": False, "http://h.com/x.png": False, "http://h.com/de/x": False, "http://h.com/?utm_source=1": False, None: False}
    for u, want in urls.items():
        assert one(spark, U.should_crawl(F.lit(u).cast("string")))[0] is want, u
    rules = U.robots_rules(F.lit("User-agent: *\r\nDisallow: /a\nAllow: /a/b\rCrawl-delay: 2.5"))
    ok = lambda p, **k: one(spark, U.robots_allowed(rules, F.lit(p), **k))[0]
    assert ok("/a/x") is False and ok("/a/b/c") is True and ok("/z") is True and ok("/a/x", legacy=True) is True
    assert one(spark, U.robots_delay(F.lit("Crawl-delay: 2.5")))[0] == 2.5 and one(spark, U.robots_delay(F.lit(None).cast("string")))[0] == 1.0
    wrapped = one(spark, U.unwrap_redirect(F.lit("https://urldefense.com/v3/__https%3A%2F%2Fx.y%2Fz__;!x")), U.decode_url(F.lit("a%zz+b")))
    assert wrapped[0] == "https://x.y/z" and wrapped[1] == "a%zz+b"


def test_page_text_is_cut_by_bytes(spark):
    assert one(spark, H.page_text(F.lit("héllo".encode()), limit=2))[0] == "h�"
    assert one(spark, H.page_text(F.lit("h\xe9".encode("latin1")), F.lit("text/html; charset=latin1")))[0] == "hé"


def test_bodies(spark):
    whole = "<html><head><title>T t</title></head><body><nav>n</nav>a&amp;b<script>x</script> <p>c</p></body></html>"
    r = one(spark, H.body_for_index(F.lit(whole)), H.body_for_tfidf(F.lit(whole)), H.body_for_rank(F.lit(whole)), H.body_for_index(F.lit(whole[:70])))
    assert r[0] == "n a&b c" and r[1] == "a&b c" and r[2] == "a&b c" and "T t" in r[3]


def test_title_description_snippet(spark):
    h = F.lit('<title> A  <b>x</b> </title><meta name="description" content="D &quot;q&quot;"><main>M m</main>')
    r = one(spark, H.title(h, F.lit("u")), H.meta_description(h), H.snippet(h), H.title(F.lit("<p>"), F.lit("u")), H.snippet(F.lit("<main> M  m</main>")))
    assert r[0] == "A x" and r[1] == 'D "q"' and r[2] == 'D "q"' and r[3] == "u" and r[4] == "M m"


def test_highlight_and_escape(spark):
    r = one(spark, T.highlight(F.lit("Cat concat cat."), F.lit("cat")), T.html_escape(F.lit("<a & 'b'>")), T.highlight(F.lit("a.b"), F.lit(".")), T.highlight(F.lit("x"), F.lit("")))
    assert r[0] == "<b>Cat</b> concat <b>cat</b>." and r[1] == "&lt;a &amp; &#39;b&#39;&gt;" and r[3] == "x"


def test_small_functions(spark):
    r = one(spark, T.city_of(F.lit(37.8), F.lit(-122.25)), T.first_city(F.lit('{"address":{"town":"T"}}')), T.three_keywords(F.lit("a b")), T.min_max(F.lit(3.0), F.lit(1.0), F.lit(1.0)))
    assert r[0] == "Oakland" and r[1] == "T" and r[2] == ["a", "b", "a"] and r[3] == 0.0
