"""Text functions as column expressions: tokens, highlighting, escaping, fingerprints, suggestions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.stopwords import STOP_WORDS

MAX_TERM = 25


def document_terms(text: Column, max_length: int = MAX_TERM) -> Column:
    """Words of a document: lower case, split at everything but a to z; stop words and long words are left out."""
    words = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: (w != "") & (F.length(w) <= max_length))
    return F.filter(words, lambda w: ~w.isin(*sorted(w_ for w_ in STOP_WORDS if w_.isalpha())))


def query_terms(query: Column) -> Column:
    """Words of a query: lower case, split at white space; punctuation, digits and repeated words are kept."""
    return F.filter(F.split(F.lower(query), r"\s+"), lambda w: (w != "") & ~w.isin(*sorted(STOP_WORDS)))


def html_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def highlight(text: Column, phrase: Column) -> Column:
    """Whole-phrase matches, in any case, between characters that are no letters or digits, set in bold. The phrase is
    taken literally; an empty or null one changes nothing."""
    literal = F.concat(F.lit(r"\Q"), F.replace(phrase, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])("), literal, F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(F.coalesce(phrase, F.lit("")) == "", text).otherwise(F.regexp_replace(text, pattern, F.lit("<b>$1</b>")))


def row_fingerprint(key: Column, columns: dict[str, Column]) -> Column:
    """SHA-1 of a row: its key, then its columns in order of name with their values; null columns are absent."""
    parts = [F.when(c.isNotNull(), F.concat_ws("=", F.lit(n), c.cast("string"))) for n, c in sorted(columns.items())]
    return F.sha1(F.concat_ws("|", key.cast("string"), *parts))


def surrogate_id(x: Column) -> Column:
    return F.sha1(x)


def json_suggestions(words: Column) -> Column:
    return F.to_json(words)


def first_city(json: Column) -> Column:
    """The first of city, town, village, municipality, county that an address in JSON has."""
    return F.coalesce(*[F.coalesce(F.get_json_object(json, f"$.address.{k}"), F.get_json_object(json, f"$.{k}")) for k in ("city", "town", "village", "municipality", "county")])


def three_keywords(text: Column) -> Column:
    """The first three words, the first one repeated where there are fewer."""
    w = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    return F.when(F.size(w) > 0, F.slice(F.concat(w, F.array_repeat(F.element_at(w, 1), 3)), 1, 3)).otherwise(F.array().cast("array<string>"))


def min_max(x: Column, low: Column, high: Column) -> Column:
    """x scaled to 0..1; 0 where the range is empty, infinite or null."""
    r = high - low
    ok = (r > 0) & (r < float("inf"))
    return F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / r))).otherwise(F.lit(0.0))


# Name, latitude from and to, longitude from and to; the first box that holds the place counts.
CITY_BOXES = [
    ("New York", 40.3, 41.1, -74.5, -73.3),
    ("Los Angeles", 33.7, 34.4, -119.0, -117.5),
    ("San Francisco", 37.70, 37.83, -122.53, -122.35),
    ("Oakland", 37.70, 37.90, -122.30, -122.10),
    ("San Jose", 37.20, 37.45, -122.05, -121.75),
    ("Philadelphia", 39.8, 40.2, -75.3, -74.8),
]


def city_of(lat: Column, lon: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, a, b, c, d in reversed(CITY_BOXES):
        out = F.when((lat > a) & (lat < b) & (lon > c) & (lon < d), F.lit(name)).otherwise(out)
    return out
