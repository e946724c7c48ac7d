"""URL functions as column expressions: parsing, normalising, link filtering, crawl policy, robots rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scheme, authority (user info is kept out of the host), rest.
_ABSOLUTE = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?(.*)$"


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://", 1))


def url_host(url: Column) -> Column:
    """Host in lower case, without user info and port; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))


def url_port(url: Column) -> Column:
    """Explicit port, else the scheme's default, else null."""
    explicit = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*?:(\d+)(?=[/?#]|$)", 1)
    return F.when(explicit != "", F.try_to_number(explicit, F.lit("999999")).cast("int")).when(url_scheme(url) == "http", F.lit(80)).when(url_scheme(url) == "https", F.lit(443))


def url_rest(url: Column) -> Column:
    """Path with query and fragment; ``/`` if there is none. A url without ``//`` is all path."""
    rest = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(.*)$", 1)
    return F.when(~url.rlike(r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://"), url).when(rest == "", F.lit("/")).otherwise(rest)


def remove_dot_segments(path: Column) -> Column:
    """Resolves ``.`` and ``..`` (RFC 3986, 5.2.4) of an absolute path without query; a ``..`` at the root is dropped.
    A dot segment at the end leaves its slash. Paths without dot segments skip the fold."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    last = F.element_at(parts, -1)
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)),
        lambda acc: F.concat(F.lit("/"), F.array_join(acc, "/"), F.when(last.isin(".", "..") & (F.size(acc) > 0), F.lit("/")).otherwise(F.lit(""))),
    )
    return F.when(path.rlike(r"/\.\.?(/|$)"), folded).otherwise(path)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used: expressions in expressions would grow
    with every use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalize_url(url: Column) -> Column:
    """Canonical form of an absolute url: outer blanks gone, scheme and host in lower case, no default port, no
    fragment, dot segments resolved, ``/`` for an empty path. Query, case of the path and a final slash are kept.
    Null for null, empty and blank urls; a text that is not an absolute url is only trimmed and loses its fragment."""
    return _let(F.regexp_replace(url, r"^\s+|\s+$|\s*#.*$", ""), _canonical)


def _canonical(u: Column) -> Column:
    def put_together(p: Column) -> Column:
        host = F.when(p.scheme == "http", F.regexp_replace(p.host, r":(80)?$", "")).when(p.scheme == "https", F.regexp_replace(p.host, r":(443)?$", "")).otherwise(F.regexp_replace(p.host, r":$", ""))
        path = F.when(p.path == "", F.lit("/")).otherwise(remove_dot_segments(p.path))
        return F.when((u == "") | u.isNull(), F.lit(None).cast("string")).when(p.scheme == "", u).otherwise(F.concat(p.scheme, F.lit("://"), p.user, host, path, p.query))

    parts = F.struct(
        F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)).alias("scheme"),
        F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?@]*@)", 1).alias("user"),
        F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?@]*@)?([^/?]*)", 1)).alias("host"),
        F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*([^?]*)", 1).alias("path"),
        F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^?]*(\?.*)$", 1).alias("query"),
    )
    return _let(parts, put_together)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute canonical form of ``href`` seen on the page ``base``; null for empty, ``mailto:`` and ``javascript:``
    links, for links that are only a fragment, and for anything that is not http(s) in the end."""
    bare = F.regexp_replace(href, r"^\s+|\s+$|\s*#.*$", "")
    parts = F.struct(
        bare.alias("h"),
        F.regexp_extract(base, r"^\s*([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1).alias("root"),
        F.regexp_extract(base, r"^\s*([A-Za-z][A-Za-z0-9+.\-]*):", 1).alias("scheme"),
        F.regexp_extract(base, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1).alias("path"),
    )

    def full(p: Column) -> Column:
        folder = F.when(p.path == "", F.lit("/")).otherwise(F.regexp_replace(p.path, r"[^/]*$", ""))
        out = (
            F.when(p.h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), p.h)
            .when(p.h.startswith("//"), F.concat(p.scheme, F.lit(":"), p.h))
            .when(p.h.startswith("/"), F.concat(p.root, p.h))
            .when(p.h.startswith("?"), F.concat(p.root, F.when(p.path == "", F.lit("/")).otherwise(p.path), p.h))
            .otherwise(F.concat(p.root, folder, p.h))
        )
        return F.when((p.h != "") & (p.root != ""), out)

    return _let(_let(_let(parts, full), _canonical), lambda x: F.when(x.rlike(r"^https?://[^/]"), x))


# Schemes of links that are never followed.
SKIPPED_HREFS = ["#", "mailto:", "tel:", "javascript:", "data:", "about:", "ftp:"]


def is_skippable_href(href: Column) -> Column:
    h = F.lower(F.regexp_replace(F.coalesce(href, F.lit("")), r"^\s+|\s+$", ""))
    out = h == ""
    for s in SKIPPED_HREFS:
        out = out | h.startswith(s)
    return out


def unwrap_redirect(url: Column) -> Column:
    """The url inside a mail-filter wrapper: what stands between two double underscores, percent-decoded; the url
    itself if it isn't wrapped, null if the inner part can't be decoded or is empty."""
    inner = F.regexp_extract(url, r"__(.+?)__", 1)
    return F.when(~F.lower(url).contains("urldefense.com"), url).when(inner == "", F.lit(None).cast("string")).otherwise(F.try_url_decode(inner))


def decode_url(url: Column) -> Column:
    """Percent-decoding for display, ``+`` as blank; malformed input stays as it is."""
    return F.coalesce(F.try_url_decode(url), url)


# Fixed values of the crawl policy: hosts that are never visited (exact match: sub-domains pass), ends of a path, parts
# of a url, folders of other languages.
BLOCKED_HOSTS = [
    "facebook.com", "www.facebook.com", "twitter.com", "www.twitter.com", "t.co", "instagram.com", "www.instagram.com",
    "linkedin.com", "www.linkedin.com", "youtube.com", "www.youtube.com", "tiktok.com", "www.tiktok.com", "reddit.com",
    "www.reddit.com", "quora.com", "www.quora.com", "medium.com", "www.medium.com", "pinterest.com", "www.pinterest.com",
    "m.baidu.com", "baidu.com", "translate.google.com",
    "doubleclick.net", "googletagmanager.com", "google-analytics.com", "adservice.google.com", "scorecardresearch.com", "taboola.com", "outbrain.com",
    "api.nytimes.com", "api.bbc.com", "static.nytimes.com", "cdn.cnn.com", "cdn.britannica.com", "akamaihd.net", "cloudfront.net", "fastly.net",
    "localhost", "127.0.0.1",
]
BLOCKED_PARTS = [
    "?utm_", "&utm_", "gclid=", "fbclid=",
    "?ref=", "?source=",
    "/login", "/signin", "/logout", "/subscribe", "/account", "/profile", "/register", "/checkout", "/cart",
    "/search?", "/?q=", "query=",
    "/calendar", "/events/", "/year/", "/month/", "/day/",
    "/share?", "/facebook.com/sharer", "/twitter.com/share",
    "/api/", "/graphql", "/ajax/", "/feeds/", ".json", ".xml",
    "/print/", "?print",
    ";jsessionid=",
]
BLOCKED_SUFFIXES = [
    ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp",
    ".mp4", ".mov", ".avi", ".mkv", ".webm", ".mp3", ".wav",
    ".pdf", ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx", ".zip", ".tar", ".gz", ".tgz", ".rar", ".7z",
    ".css", ".js", ".woff", ".woff2", ".ttf", ".eot",
    ".php", ".aspx",
]
LANGUAGE_DIRS = ["/es/", "/de/", "/fr/", "/ja/", "/zh/", "/ru/", "/ar/"]


def should_crawl(url: Column, blocked_hosts: list[str] | None = None) -> Column:
    """The crawl policy as one boolean: http(s), a host that isn't blocked (exact match, sub-domains pass), no blocked
    suffix of what follows the host, no blocked part of the url, no language folder after the host. Null urls are never
    crawled. ``blocked_hosts`` replaces the fixed list."""
    hosts = BLOCKED_HOSTS if blocked_hosts is None else blocked_hosts

    def judge(p: Column) -> Column:
        ok = p.ok & (p.host != "") & ~p.low.rlike(_any_of(BLOCKED_PARTS)) & ~p.path.rlike(f"(?:{_any_of(BLOCKED_SUFFIXES)})$|{_any_of(LANGUAGE_DIRS)}")
        return ok & ~p.host.isin(*hosts) if hosts else ok

    u = F.coalesce(url, F.lit(""))
    return _let(F.struct(u.rlike(r"^(?i)https?://[^/?#]").alias("ok"), F.lower(u).alias("low"), F.lower(url_rest(u)).alias("path"), url_host(u).alias("host")), judge)


def _any_of(texts: list[str]) -> str:
    return "|".join("\\Q" + t + "\\E" for t in texts)


def host_key(url: Column) -> Column:
    """``host:port``, the port explicit or the scheme's default; empty where there is no host. A scheme other than http
    and https has port 80 by default."""
    host = url_host(url)
    return F.when(host == "", F.lit("")).otherwise(F.concat_ws(":", host, F.coalesce(url_port(url), F.lit(80)).cast("string")))


def legacy_rank_url(base: Column, href: Column) -> Column:
    """The older form of link targets for ranks: resolved as ``resolve_url`` does, always with a port, path escapes
    decoded, without query and fragment."""
    def form(u: Column) -> Column:
        path = F.regexp_replace(url_rest(u), r"[?#].*$", "")
        return F.concat(url_scheme(u), F.lit("://"), host_key(u), F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path))

    return _let(resolve_url(base, href), form)


def robots_rules(robots_txt: Column, agent: str = "weftline") -> Column:
    """array<struct<kind: A or D, prefix>> of the group that holds for ``agent``: its own group, else that of ``*``.
    Comments, unknown fields and empty prefixes are left out; line ends may be mixed; null gives an empty array."""
    lines = F.transform(
        F.filter(F.split(F.regexp_replace(F.coalesce(robots_txt, F.lit("")), r"#[^\r\n]*", ""), r"\r\n|\r|\n"), lambda x: F.trim(x) != ""),
        lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, r"^([^:]*):", 1))).alias("f"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v")),
    )
    rule = "struct<kind:string,prefix:string>"
    start = F.struct(
        F.lit(False).alias("own"), F.lit(False).alias("any"), F.lit(False).alias("rules_begun"),
        F.array().cast(f"array<{rule}>").alias("mine"), F.array().cast(f"array<{rule}>").alias("all"), F.lit(False).alias("seen"),
    )

    def step(acc, x):
        is_agent, is_rule = x.f == "user-agent", x.f.isin("allow", "disallow")
        fresh = is_agent & acc.rules_begun
        own = F.when(is_agent, (F.lower(x.v) == agent.lower()) | (~fresh & acc.own)).otherwise(acc.own)
        every = F.when(is_agent, (x.v == "*") | (~fresh & acc.any)).otherwise(acc.any)
        item = F.array(F.struct(F.when(x.f == "allow", F.lit("A")).otherwise(F.lit("D")).alias("kind"), x.v.alias("prefix")))
        none = F.array().cast(f"array<{rule}>")
        add = is_rule & (x.v != "")
        return F.struct(
            own.alias("own"), every.alias("any"), F.when(is_agent, F.lit(False)).otherwise(acc.rules_begun | is_rule).alias("rules_begun"),
            F.concat(acc.mine, F.when(add & acc.own, item).otherwise(none)).alias("mine"),
            F.concat(acc["all"], F.when(add & acc["any"], item).otherwise(none)).alias("all"),
            (acc.seen | (is_agent & (F.lower(x.v) == agent.lower()))).alias("seen"),
        )

    return F.aggregate(lines, start, step, lambda a: F.when(a.seen, a.mine).otherwise(a["all"]))


def robots_allowed(rules: Column, path: Column, legacy: bool = False) -> Column:
    """Longest matching prefix wins, on equal length Allow; no match means allowed. ``legacy`` always allows."""
    if legacy:
        return F.lit(True)
    hits = F.filter(rules, lambda r: F.startswith(path, r.prefix))
    best = F.array_max(F.transform(hits, lambda r: F.struct(F.length(r.prefix).alias("n"), F.when(r.kind == "A", 1).otherwise(0).alias("a"))))
    return F.coalesce(best.a == 1, F.lit(True))


def robots_delay(robots_txt: Column, default: float = 1.0) -> Column:
    """First Crawl-delay that is a number, in seconds, else the default."""
    found = F.regexp_extract(F.coalesce(robots_txt, F.lit("")), r"(?im)^[ \t]*crawl-delay[ \t]*:[ \t]*([0-9]+(?:\.[0-9]+)?)", 1)
    return F.coalesce(F.expr("1.0D") * found.try_cast("double"), F.lit(default))
