"""The queries of the problems tagged llm, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import boilerplate, distinctive, encode, fusion, language, markup, pack, residue, seen
from weftline.session import cut
from weftline.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    c = fusion.query_candidates(read_table(spark, d, "search_terms"), read_table(spark, d, "tfidf"), read_table(spark, d, "page_meta"))
    return fusion.fuse_rankings(c, ["query_id"], ["pagerank", "tfidf"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return fusion.top_per_query(p1_ranking(spark, d), 5).select("query_id", "url")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    model = language.fit_from(read_table(spark, d, "lang_samples"))
    return language.page_languages(read_table(spark, d, "crawl"), model, found_only=True)


def p3_segments(spark: SparkSession, d: str) -> DataFrame:
    model = language.fit_from(read_table(spark, d, "lang_samples"))
    return language.page_languages(read_table(spark, d, "crawl"), model, found_only=False)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.find_main(read_table(spark, d, "crawl"))


def p4_main(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.extract_main(read_table(spark, d, "crawl"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.find_markup(read_table(spark, d, "crawl"))


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.find_markup(read_table(spark, d, "crawl"), clean=True)


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    s = distinctive.term_scores(cut(distinctive.distinct_terms(read_table(spark, d, "postings")), "terms"))
    return s.select("url", "word", "tf", "df", F.round("score", 6).alias("score"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    keys = read_table(spark, d, "key_pages")
    s = distinctive.term_scores(cut(distinctive.distinct_terms(read_table(spark, d, "postings")), "terms"), only=keys)
    return distinctive.most_distinctive(s, keys).select("url", "word")


def p7_seen(spark: SparkSession, d: str) -> DataFrame:
    return seen.seen_before(spark, d).select("queue_id", "seen")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return seen.seen_before(spark, d).where("seen").select("queue_id")


def p7_error_rate(spark: SparkSession, d: str) -> DataFrame:
    return seen.error_rate(seen.seen_before(spark, d), spark, d)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_documents(read_table(spark, d, "documents"))


def p9_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack(encode.encode_documents(read_table(spark, d, "documents"), out="tokens"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return pack.fill_report(p9_pack(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(read_table(spark, d, "documents")).where("residue").select("doc_id")


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(read_table(spark, d, "documents")).select("doc_id", "text")


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k.startswith("p") and "_" in k and k[1].isdigit() and callable(v)}


_WORD = "lower(regexp_replace(word, '^\\s+|\\s+$', '', 'g'))"

_P1 = f"""
with w as (select query_id, {_WORD} as w from search_terms where word is not null),
t as (select {_WORD} as w, url, case when tfidf >= 0 and not isnan(tfidf) and not isinf(tfidf) then tfidf end as tfidf from tfidf where word is not null and url is not null),
m as (select url, case when pagerank >= 0 and not isnan(pagerank) and not isinf(pagerank) then pagerank end as pagerank
      from (select *, row_number() over (partition by url order by ranked_at desc nulls last, pagerank desc nulls last) as r from page_meta where url is not null) where r = 1),
c as (select query_id, t.url, max(t.tfidf) as tfidf, max(m.pagerank) as pagerank from w join t on w.w = t.w left join m on m.url = t.url group by 1, 2),
k as (select *, rank() over (partition by query_id order by pagerank desc nulls last) as rank_pagerank, rank() over (partition by query_id order by tfidf desc nulls last) as rank_tfidf from c)
"""

# Urls of both tables in canonical form, and the smallest place of each; -1 for all of visited.
_P7 = r"""with r as (select queue_id as place, url from frontier union all select -1, url from visited),
a as (select place, regexp_replace(regexp_replace(url, '^\s+|\s+$', '', 'g'), '\s*#.*$', '') as u from r),
b as (select *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) as s, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?]*)', 1)) as h, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*([^?]*)', 1) as p, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\-]*://[^?]*(\?.*)$', 1) as q from a where u <> ''),
c as (select *, case when s = 'http' then regexp_replace(h, ':(80)?$', '') when s = 'https' then regexp_replace(h, ':(443)?$', '') else regexp_replace(h, ':$', '') end as k, string_split(substr(p, 2), '/') as parts from b),
d as (select *, list_reduce(list_transform(list_filter(parts, lambda x: x <> '.'), lambda x: [x]), lambda acc, x: case when x[1] = '..' then acc[1:len(acc) - 1] else list_concat(acc, x) end, []::varchar[]) as seg from c),
e as (select place, case when s = '' then u else s || '://' || k || case when p = '' then '/' when not regexp_matches(p, '/\.\.?(/|$)') then p else '/' || array_to_string(seg, '/') || case when parts[-1] in ('.', '..') and len(seg) > 0 then '/' else '' end end || q end as key from d),
f as (select place, place > min(place) over (partition by key) as seen from e where place >= 0 or place = -1),
g as (select queue_id, coalesce(seen, false) as seen from frontier left join f on place = queue_id)
"""

_P6 = f"""
with o as (select url, {_WORD} as word, max(greatest(coalesce(tf, 1), 1))::bigint as tf from postings where word is not null and url is not null and {_WORD} <> '' group by 1, 2),
n as (select count(distinct url) as n from o), d as (select word, count(*) as df from o group by 1),
l as (select url, sum(tf) as len from o group by 1),
s as (select o.url, o.word, o.tf, d.df, o.tf / l.len * ln((1.0 + n.n) / (1.0 + d.df)) as score from o join d using (word) join l using (url), n)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_ranking": _P1 + "select query_id, url, tfidf, pagerank, rank_pagerank::bigint as rank_pagerank, rank_tfidf::bigint as rank_tfidf, 1.0::double / (rank_pagerank + 60) + 1.0::double / (rank_tfidf + 60) as fused from k",
        "p1_found": _P1 + "select query_id, url from (select *, row_number() over (partition by query_id order by 1.0::double / (rank_pagerank + 60) + 1.0::double / (rank_tfidf + 60) desc, url) as p from k) where p <= 5",
        "p7_seen": _P7 + "select queue_id, seen from g",
        "p7_found": _P7 + "select queue_id from g where seen",
        "p6_scores": _P6 + "select url, word, tf, df, round(score, 6) as score from s",
        "p6_found": _P6 + "select url, word from (select *, row_number() over (partition by url order by score desc, word) as p from s where url in (select url from key_pages)) where p = 1",
    }
