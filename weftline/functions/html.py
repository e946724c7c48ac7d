"""HTML functions as column expressions: decoding, body text in three forms, title, description, snippet, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a page that are read, by default; and the least that a page must have to be read at all, for each job.
PAGE_BYTES = 20_000
LEAST_BYTES = {"index": 100, "rank": 100, "tfidf": 64}


def page_text(page: Column, content_type: Column | None = None, limit: int | None = PAGE_BYTES) -> Column:
    """The first ``limit`` bytes as text: as UTF-8 with replacement characters, or as Latin 1 where the content type
    says so; without a byte order mark. Null for a null page."""
    cut = F.substring(page, 1, limit) if limit else page
    text = F.make_valid_utf8(cut.cast("string"))
    if content_type is not None:
        latin = F.lower(content_type).rlike(r"charset\s*=\s*\"?(latin-?1|iso-?8859-1)")
        text = F.when(latin, F.decode(cut, "ISO-8859-1")).otherwise(text)
    return F.regexp_replace(text, "^﻿", "")


def _entities(t: Column, more: bool = False) -> Column:
    pairs = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")] + ([("&quot;", '"'), ("&#39;", "'")] if more else [])
    for a, b in pairs:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def _collapse(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"[ \t\n\x0B\f\r]+", " "))


def _body(t: Column) -> Column:
    """What stands between the body tags, if both are there; else everything."""
    inner = F.regexp_extract(t, r"(?is)<body[^>]*>(.*?)</body>", 1)
    return F.when(t.rlike(r"(?is)<body[^>]*>.*?</body>"), inner).otherwise(t)


def body_for_index(html: Column) -> Column:
    """Scripts and styles go only where they are on one line; then body, tags, entities, white space."""
    t = F.regexp_replace(html, r"(?i)<script[^>]*>.*?</script>", " ")
    t = F.regexp_replace(t, r"(?i)<style[^>]*>.*?</style>", " ")
    return _collapse(_entities(F.regexp_replace(_body(t), r"<[^>]+>", " ")))


def _strip(t: Column, tags: list[str]) -> Column:
    for tag in tags:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return t


def body_for_tfidf(html: Column) -> Column:
    """As for the index, over several lines, without comments; inside the body without nav, header, footer, aside."""
    t = F.regexp_replace(_strip(html, ["script", "style"]), r"(?s)<!--.*?-->", " ")
    return _collapse(_entities(F.regexp_replace(_strip(_body(t), ["nav", "header", "footer", "aside"]), r"<[^>]+>", " ")))


def body_for_rank(html: Column) -> Column:
    """Without head and site parts, not narrowed to the body; quotes are decoded too."""
    t = F.regexp_replace(_strip(html, ["script", "style"]), r"(?s)<!--.*?-->", " ")
    return _collapse(_entities(F.regexp_replace(_strip(t, ["head", "nav", "header", "footer", "aside"]), r"<[^>]+>", " "), more=True))


def clean_text(t: Column) -> Column:
    return _collapse(F.regexp_replace(t, r"<[^>]+>", " "))


def cap(t: Column, n: int) -> Column:
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def title(html: Column, url: Column) -> Column:
    """The first title, cleaned and capped at 120 characters; the url where there is none."""
    t = clean_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(t == "", url).otherwise(cap(t, 120))


def meta_description(html: Column) -> Column:
    """Of og:description, description and twitter:description the first that isn't blank; null if all are."""
    out = []
    for attr, name in (("property", "og:description"), ("name", "description"), ("name", "twitter:description")):
        tag = F.regexp_extract(html, rf"(?is)<meta\b[^>]*{attr}\s*=\s*[\"']{name}[\"'][^>]*>", 0)
        value = F.regexp_extract(tag, r"(?is)content\s*=\s*(\"[^\"]*\"|'[^']*')", 1)
        value = F.trim(_entities(F.regexp_replace(value, r"^[\"']|[\"']$", ""), more=True))
        out.append(F.when(value != "", value))
    return F.coalesce(*out)


def semantic_content(html: Column) -> Column:
    """Inside of the first main, article or section element that is closed; null if there is none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(html, rf"(?is)<{t}\b[^>]*>(.*?)</{t}>", 1), F.lit("")) for t in ("main", "article", "section")])


def snippet(html: Column) -> Column:
    """Description, else semantic content, else body text (its first 300 characters skipped where it is longer), at
    most 200 characters."""
    body = body_for_rank(html)
    body = F.when(F.length(body) > 300, F.substring(body, 301, 1 << 30)).otherwise(body)
    sem = F.nullif(clean_text(semantic_content(html)), F.lit(""))
    return cap(F.trim(F.coalesce(meta_description(html), sem, clean_text(body))), 200)


def hrefs(html: Column) -> Column:
    """The targets of all links in order, quoted or bare, repeated ones too."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"), 1)
    return F.transform(found, lambda h: F.trim(F.regexp_replace(h, r"^[\"']|[\"']$", "")))
