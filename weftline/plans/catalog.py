"""The catalogue of the core's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import html as H
from weftline.functions import text as T
from weftline.functions import url as U
from weftline.operators import kv
from weftline.operators.dataset import Dataset, JobOutput, PairDataset, append_capped, default_join, page_of, per_key_limit
from weftline.operators.salted import normal_word, salted_counts
from weftline.plans import crawl as C
from weftline.plans import index as I
from weftline.plans import pagerank as P
from weftline.plans import search as S
from weftline.session import cut, scratch
from weftline.sources.tables import read_table, stream_table, table_names

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL of the same result if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, d, name)


# ---------------------------------------------------------------- SQL building blocks

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(T.STOP_WORDS))
_WORD = r"lower(regexp_replace(word, '^\s+|\s+$', '', 'g'))"
_PAGES = """pages as (select url, page, content_type from (select *, row_number() over (partition by url order by stored_at desc nulls last, crawl_id desc) as r
 from crawl where page is not null and url is not null) where r = 1)"""


def _ascii(b: str) -> str:
    """Bytes as text in which everything beyond ASCII is a question mark."""
    t = f"({b})::varchar"
    for code, char in (("0A", "chr(10)"), ("0D", "chr(13)"), ("09", "chr(9)"), ("22", "'\"'"), ("27", "''''")):
        t = f"replace({t}, '\\x{code}', {char})"
    return f"replace(regexp_replace({t}, '\\\\x(?:[0-46-9A-F][0-9A-F]|5[0-9ABD-F])', '?', 'g'), '\\x5C', '\\')"


def _utf8(b: str) -> str:
    """Bytes as UTF-8, with a replacement character for a character that is cut at the end."""
    cuts = "".join(f", try(decode(({b})[1:octet_length({b}) - {k}])) || chr(65533)" for k in (1, 2, 3))
    return f"coalesce(try(decode({b})){cuts})"


def _text(limit: int | None = H.PAGE_BYTES) -> str:
    b = f"page[1:{limit}]" if limit else "page"
    latin = f"array_to_string(list_transform(range(1, octet_length({b}) + 1), lambda i: chr(('0x' || hex(({b})[i:i]))::int)), '')"
    utf = _utf8(b)
    return rf"""regexp_replace(case when regexp_matches(lower(content_type), 'charset\s*=\s*"?(latin-?1|iso-?8859-1)') then {latin} else {utf} end, '^\x{{feff}}', '')"""


def _sub(t: str, pattern: str, by: str = " ") -> str:
    return f"regexp_replace({t}, '{pattern}', '{by}', 'g')"


def _ent(t: str, more: bool = False) -> str:
    for a, b in [("&nbsp;", "' '"), ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'")] + ([("&quot;", "'\"'"), ("&#39;", "''''")] if more else []):
        t = f"replace({t}, '{a}', {b})"
    return t


def _collapse(t: str) -> str:
    return f"trim({_sub(t, r'[ \t\n\x0B\f\r]+')})"


def _body(t: str) -> str:
    return rf"case when regexp_matches({t}, '(?is)<body[^>]*>.*?</body>') then regexp_extract({t}, '(?is)<body[^>]*>(.*?)</body>', 1) else {t} end"


def _strip(t: str, tags: list[str]) -> str:
    for tag in tags:
        t = _sub(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>")
    return t


def _index_body(t: str) -> tuple[str, str]:
    """CTE step that strips, and the expression of the body over its column ``s``."""
    return _sub(_sub(t, r"(?i)<script[^>]*>.*?</script>"), r"(?i)<style[^>]*>.*?</style>"), _collapse(_ent(_sub(_body("s"), r"<[^>]+>")))


def _tfidf_body(t: str) -> tuple[str, str]:
    s = _sub(_strip(t, ["script", "style"]), r"(?s)<!--.*?-->")
    return s, _collapse(_ent(_sub(_strip(f"({_body('s')})", ["nav", "header", "footer", "aside"]), r"<[^>]+>")))


def _rank_body(t: str) -> str:
    s = _sub(_strip(t, ["script", "style"]), r"(?s)<!--.*?-->")
    return _collapse(_ent(_sub(_strip(s, ["head", "nav", "header", "footer", "aside"]), r"<[^>]+>"), True))


_TERMS = f"w <> '' and length(w) <= 25 and w not in ({_STOP})"

# ---------------------------------------------------------------- problem 2


@query(f"""with p as (select {_WORD} as w, url, tf from postings where word is not null),
o as (select w, url, count(*) as n, max(tf) as tf from p group by 1, 2)
select w as word, sum(n)::bigint as rows, count(url)::bigint as items, coalesce(sum(case when url is not null then coalesce(tf, 0) end), 0)::bigint as total from o group by 1""")
def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Page count and total tf of every word."""
    return salted_counts(_t(spark, d, "postings").withColumn("word", normal_word(F.col("word"))), "word", "url", "tf")


@query(f"select {_WORD} as word from postings where word is not null group by 1 having count(*) >= 0.02 * (select count(*) from postings)")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The words that own at least 2 % of all rows, from the counts of all words."""
    total = _t(spark, d, "postings").agg(F.count("*").alias("_all"))
    return p2_counts(spark, d).join(F.broadcast(total), F.col("rows") >= 0.02 * F.col("_all")).select("word")  # one row


# ---------------------------------------------------------------- dataset operators

_TOKENS = f"""tok as (select doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) as w from documents where text is not null),
terms as (select doc_id, w from tok where {_TERMS})"""


def _doc_texts(spark: SparkSession, d: str) -> Dataset:
    return Dataset.from_table(_t(spark, d, "documents"), F.col("text"))


@query(f"with {_TOKENS} select w as word, count(*) as n from terms group by 1 order by n desc, word limit 20")
def wordcount_top(spark: SparkSession, d: str) -> DataFrame:
    pairs = _doc_texts(spark, d).flat_map(T.document_terms).map_to_pair(lambda v: v, lambda v: F.lit(1))
    return pairs.fold_by_key(F.sum).df.select(F.col("key").alias("word"), F.col("value").alias("n")).orderBy(F.desc("n"), "word").limit(20)


@query(f"with {_TOKENS} select w as value, count(*) as n from terms group by 1")
def flatmap_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _doc_texts(spark, d).flat_map(T.document_terms).df.groupBy("value").agg(F.count("*").alias("n"))


@query("select c_nationkey::varchar as key, c_name as value from customer")
def map_to_pair_nation(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").select(F.struct("c_nationkey", "c_name").alias("value"))
    return Dataset(c).map_to_pair(lambda v: v.c_nationkey.cast("string"), lambda v: v.c_name).df


@query(f"with {_TOKENS} select substr(w, 1, 1) as key, w as value, count(*) as n from terms group by 1, 2")
def flatmap_to_pair_words(spark: SparkSession, d: str) -> DataFrame:
    pairs = _doc_texts(spark, d).flat_map_to_pair(lambda v: F.transform(T.document_terms(v), lambda w: F.struct(F.substring(w, 1, 1).alias("key"), w.alias("value"))))
    return pairs.df.groupBy("key", "value").agg(F.count("*").alias("n"))


@query(r"select value, count(*) as n from (select source || ':' || unnest(string_split(text, chr(10))) as value from documents where text is not null and source is not null) group by 1")
def pair_flatmap_lines(spark: SparkSession, d: str) -> DataFrame:
    pairs = PairDataset(_t(spark, d, "documents").where("source is not null and text is not null").select(F.col("source").alias("key"), F.col("text").alias("value")))
    lines = pairs.flat_map(lambda k, v: F.transform(F.split(v, "\n"), lambda x: F.concat(k, F.lit(":"), x)))
    return lines.df.groupBy("value").agg(F.count("*").alias("n"))


@query(f"""with tok as (select source, unnest(string_split_regex(lower(text), '[^a-z]+')) as w from documents where text is not null and source is not null)
select w as key, source as value, count(*) as n from tok where {_TERMS} group by 1, 2""")
def pair_flatmap_to_pair(spark: SparkSession, d: str) -> DataFrame:
    pairs = PairDataset(_t(spark, d, "documents").where("source is not null").select(F.col("source").alias("key"), F.col("text").alias("value")))
    out = pairs.flat_map_to_pair(lambda k, v: F.transform(T.document_terms(v), lambda w: F.struct(w.alias("key"), k.alias("value"))))
    return out.df.groupBy("key", "value").agg(F.count("*").alias("n"))


@query("select o_orderpriority as value from orders where o_orderpriority <> '5-LOW'")
def filter_bag(spark: SparkSession, d: str) -> DataFrame:
    return Dataset.from_table(_t(spark, d, "orders"), F.col("o_orderpriority")).filter(lambda v: v != "5-LOW").df


@query("select distinct o_orderpriority as value from orders where o_orderpriority <> '5-LOW'")
def filter_dedup(spark: SparkSession, d: str) -> DataFrame:
    return Dataset.from_table(_t(spark, d, "orders"), F.col("o_orderpriority")).filter(lambda v: v != "5-LOW", distinct=True).df


@query("select l_orderkey::varchar || '-' || l_linenumber::varchar as value from lineitem where ('0x' || substr(md5(l_orderkey::varchar || '-' || l_linenumber::varchar), 1, 8))::bigint < 429496729")
def sample_hash(spark: SparkSession, d: str) -> DataFrame:
    ids = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return Dataset.from_table(_t(spark, d, "lineitem"), ids).sample_by_hash(0.1).df


@query()
def sample_bernoulli(spark: SparkSession, d: str) -> DataFrame:
    return Dataset.from_table(_t(spark, d, "lineitem"), F.col("l_orderkey").cast("string")).sample(0.1, 42).df


@query("select c_name || '/' || c_mktsegment as value from customer where c_acctbal > 0")
def from_table_rowmap(spark: SparkSession, d: str) -> DataFrame:
    return Dataset.from_table(_t(spark, d, "customer"), F.when(F.col("c_acctbal") > 0, F.concat_ws("/", "c_name", "c_mktsegment"))).df


@query("select * from (values ('a'), ('b'), ('b'), ('c')) t(value)")
def parallelize_values(spark: SparkSession, d: str) -> DataFrame:
    return Dataset.parallelize(spark, ["a", "b", "b", "c"]).df


@query("select p_partkey, p_name from part where p_name >= 'c' and p_name < 'p' order by p_name, p_partkey limit 10")
def key_range_scan(spark: SparkSession, d: str) -> DataFrame:
    return kv.scan(_t(spark, d, "part"), "c", "p", "p_name").select("p_partkey", "p_name").orderBy("p_name", "p_partkey").limit(10)


@query("select o_orderkey, o_totalprice from orders where o_orderkey = 7")
def point_get(spark: SparkSession, d: str) -> DataFrame:
    return kv.get_row(_t(spark, d, "orders"), 7, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("select (select count(*) > 0 from orders where o_orderkey = 7) as present, (select count(*) > 0 from orders where o_orderkey = -7) as absent")
def exists_row(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    some = lambda k: kv.get_row(o, k, "o_orderkey").agg((F.count("*") > 0).alias("x"))
    return some(7).withColumnRenamed("x", "present").crossJoin(some(-7).withColumnRenamed("x", "absent"))  # one row each


@query("select c_custkey::varchar as key, c_name || ',' || o_orderkey::varchar as value from customer join orders on c_custkey = o_custkey")
def pair_join_concat(spark: SparkSession, d: str) -> DataFrame:
    left = PairDataset(_t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("value")))
    right = PairDataset(_t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").cast("string").alias("value")))
    return left.join(right).df


@query("select n_nationkey, n_name, coalesce(suppliers, 0) as suppliers from nation left join (select s_nationkey as n_nationkey, count(*) as suppliers from supplier group by 1) using (n_nationkey)")
def left_default_join(spark: SparkSession, d: str) -> DataFrame:
    right = _t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return default_join(_t(spark, d, "nation").select("n_nationkey", "n_name"), right, "n_nationkey", {"suppliers": F.lit(0)})


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def anti_visited(spark: SparkSession, d: str) -> DataFrame:
    seen = _t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, d, "customer").select("c_custkey").join(seen, "c_custkey", "left_anti")


@query("select l_returnflag as key, sum(l_quantity) as value from lineitem group by 1")
def fold_by_key_sum(spark: SparkSession, d: str) -> DataFrame:
    return PairDataset(_t(spark, d, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_quantity").alias("value"))).fold_by_key(F.sum).df


@query("select n_regionkey as key, string_agg(n_name, ',' order by n_name) as value from nation group by 1")
def fold_by_key_concat(spark: SparkSession, d: str) -> DataFrame:
    pairs = PairDataset(_t(spark, d, "nation").select(F.col("n_regionkey").alias("key"), F.col("n_name").alias("value")))
    return pairs.fold_ordered(F.lit(""), lambda acc, v: F.when(acc == "", v).otherwise(F.concat(acc, F.lit(","), v))).df


@query("select sum(l_quantity) as value from lineitem")
def fold_total(spark: SparkSession, d: str) -> DataFrame:
    return Dataset.from_table(_t(spark, d, "lineitem"), F.col("l_quantity")).fold(F.sum)


@query("select substr(o_orderpriority, 1, 1) as key, o_orderpriority as value from orders")
def group_by_bag(spark: SparkSession, d: str) -> DataFrame:
    return Dataset.from_table(_t(spark, d, "orders"), F.col("o_orderpriority")).group_by(lambda v: F.substring(v, 1, 1)).df


@query("select (select count(*) from orders) as orders, (select count(*) from lineitem) as lineitem, (select count(distinct o_custkey) from orders) as customers")
def counts(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"))
    return o.crossJoin(_t(spark, d, "lineitem").agg(F.count("*").alias("lineitem"))).select("orders", "lineitem", "customers")  # one row each


@query("select distinct l_shipdate::date::varchar as value from lineitem")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return Dataset.from_table(_t(spark, d, "lineitem"), F.col("l_shipdate").cast("date").cast("string")).distinct().df


@query("select c_custkey::varchar as value from customer intersect select o_custkey::varchar from orders")
def intersect_keys(spark: SparkSession, d: str) -> DataFrame:
    a = Dataset.from_table(_t(spark, d, "customer"), F.col("c_custkey").cast("string"))
    return a.intersection(Dataset.from_table(_t(spark, d, "orders"), F.col("o_custkey").cast("string"))).df


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 15")
def take_ordered(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15)


@query("select n_name as value from nation order by n_name limit 7")
def take_values(spark: SparkSession, d: str) -> DataFrame:
    """The first values of a sorted bag, taken to the caller and made a bag again."""
    names = Dataset(_t(spark, d, "nation").select(F.col("n_name").alias("value")).orderBy("n_name"))
    return Dataset.parallelize(spark, names.take(7)).df


@query("select r_name as value from region")
def collect_values(spark: SparkSession, d: str) -> DataFrame:
    return Dataset.parallelize(spark, Dataset.from_table(_t(spark, d, "region"), F.col("r_name")).collect()).df


@query("select count(*) as pairs from orders where o_orderstatus is not null")
def pair_count(spark: SparkSession, d: str) -> DataFrame:
    pairs = Dataset.from_table(_t(spark, d, "orders"), F.col("o_orderstatus")).map_to_pair(lambda v: v, lambda v: F.lit("1"))
    return spark.createDataFrame([(pairs.count(),)], "pairs bigint")


def _saved(spark: SparkSession, bag: Dataset | PairDataset, schema: str) -> DataFrame:
    """Saves a bag as a table of the catalogue and reads its files; the entry of the catalogue goes again."""
    path = scratch(spark, "table")
    name = "weftline_" + path.rsplit("-", 1)[1]
    bag.save_as_table(name, path)
    spark.sql(f"drop table {name}")
    return spark.read.schema(schema).parquet(path)


@query("select upper(c_name) as value from customer")
def save_table(spark: SparkSession, d: str) -> DataFrame:
    return _saved(spark, Dataset.from_table(_t(spark, d, "customer"), F.upper("c_name")), "value string")


@query("select o_orderstatus as key, max(o_orderpriority) as value from orders group by 1")
def pair_save_table(spark: SparkSession, d: str) -> DataFrame:
    """Saving pairs as a table: of a key's values one stays."""
    pairs = PairDataset(_t(spark, d, "orders").select(F.col("o_orderstatus").alias("key"), F.col("o_orderpriority").alias("value")))
    return _saved(spark, pairs, "key string, value string")


@query("select * from (values ('x'), ('y'), ('y')) t(value)")
def parallelize_to_table(spark: SparkSession, d: str) -> DataFrame:
    return _saved(spark, Dataset.parallelize(spark, ["x", "y", "y"]), "value string")


@query(f"with {_TOKENS} select w as value from terms where length(w) > 8")
def flatmap_to_table(spark: SparkSession, d: str) -> DataFrame:
    return _saved(spark, _doc_texts(spark, d).flat_map(lambda v: F.filter(T.document_terms(v), lambda w: F.length(w) > 8)), "value string")


@query("select s_name[length(s_name):] || '.' as value from supplier")
def map_batches(spark: SparkSession, d: str) -> DataFrame:
    """Code that is no column expression, over Arrow batches."""

    def last_letter(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([v[-1] + "." for v in b.column(0).to_pylist()], pa.string())], ["value"])

    return Dataset.from_table(_t(spark, d, "supplier"), F.col("s_name")).map_batches(last_letter).df


@query("select (select count(*) from part) as seen, (select count(*) from orders) as pairs, 'done, 2 jobs' as said")
def for_each_output(spark: SparkSession, d: str) -> DataFrame:
    """Side effects on the executors, here counting, for values and for pairs, and what the job says in the end."""
    seen, pairs, out = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), JobOutput()
    Dataset.from_table(_t(spark, d, "part"), F.col("p_name")).for_each_partition(lambda rows: seen.add(sum(1 for _ in rows)))
    PairDataset(_t(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"))).for_each_partition(lambda rows: pairs.add(sum(1 for _ in rows)))
    out.output("done, ")
    out.output("2 jobs")
    return spark.createDataFrame([(seen.value, pairs.value, out.text())], "seen bigint, pairs bigint, said string")


@query("select o_orderkey, o_totalprice from orders where o_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT')")
def multi_get(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    return kv.get_rows(o, o.where("o_orderpriority = '1-URGENT'"), "o_orderkey").select("o_orderkey", "o_totalprice")


@query("select c_custkey as o_custkey, c_custkey in (select o_custkey from orders) as there from customer")
def exist_rows(spark: SparkSession, d: str) -> DataFrame:
    return kv.exist_rows(_t(spark, d, "orders"), _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10 offset 20")
def paginate(spark: SparkSession, d: str) -> DataFrame:
    return page_of(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@query("""with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders)
select o_custkey, ((n - 1) // 3)::int as chunk, list(o_orderkey order by n) as list from r where n <= 5 group by 1, 2""")
def append_capped_lists(spark: SparkSession, d: str) -> DataFrame:
    return append_capped(_t(spark, d, "orders"), "o_custkey", "o_orderkey", ["o_orderdate"], 5, 3)


@query("""with p as (select o_custkey, o_orderkey, o_orderdate, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as n from orders)
select o_custkey, o_orderkey from p where n <= 2""")
def per_key_first(spark: SparkSession, d: str) -> DataFrame:
    return per_key_limit(_t(spark, d, "orders"), "o_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey")


# ---------------------------------------------------------------- key-value tables, with events as their log


def _cells(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    return e.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("col"), F.col("value").cast("string").alias("value"), F.col("event_id").alias("version"), F.lit(False).alias("deleted"))


_KV = "cells as (select user_id::varchar as key, event_type as col, value, event_id as version from events where event_type is not null)"


@query(f"with {_KV} select key, col, arg_max(value, version) as value from cells group by 1, 2")
def kv_latest(spark: SparkSession, d: str) -> DataFrame:
    return kv.latest(_cells(spark, d)).select("key", "col", F.col("value").cast("double").alias("value"))


@query(f"with {_KV} select key, col, value from cells where version = 77")
def kv_version_n(spark: SparkSession, d: str) -> DataFrame:
    return kv.at_version(_cells(spark, d), 77).select("key", "col", F.col("value").cast("double").alias("value"))


@query(f"""with {_KV}, now as (select key, col, arg_max(value, version) as value from cells group by 1, 2), k as (select distinct user_id::varchar as key from events)
select k.key, case when c.value > 0 and c.value = (select value from now x where x.key = k.key and x.col = 'click') and c.value < 20 then 'OK' else 'FAIL' end as result,
case when c.value < 20 then 0.0 else v.value end as value from k left join now c on c.key = k.key and c.col = 'click' left join now v on v.key = k.key and v.col = 'view'""")
def kv_cond_put(spark: SparkSession, d: str) -> DataFrame:
    """Sets ``view`` to 0 where ``click`` is below 20: the put names the value it saw, or one that can't be there."""
    now = kv.latest(_cells(spark, d))
    clicks = now.where("col = 'click'").select("key", F.when(F.col("value").cast("double") < 20, F.col("value")).otherwise("other").alias("equals"))
    keys = _cells(spark, d).select("key").distinct()
    puts = keys.join(clicks, "key", "left").select("key", F.lit("view").alias("col"), F.lit("0").alias("value"), F.lit("click").alias("if_col"), F.coalesce("equals", F.lit("other")).alias("equals"))
    return kv.conditional(now, puts).select("key", "result", F.col("value").cast("double").alias("value"))


@query(f"with {_KV} select key, col, arg_max(value, version) as value from cells where key not in (select user_id::varchar from events where event_type = 'error' and value > 95) group by 1, 2")
def kv_delete_row(spark: SparkSession, d: str) -> DataFrame:
    log = _cells(spark, d)
    gone = log.where("col = 'error' and double(value) > 95").select("key").distinct()
    return kv.delete_rows(kv.latest(log), gone).select("key", "col", F.col("value").cast("double").alias("value"))


@query(f"with {_KV} select count(distinct key) as n from cells")
def kv_table_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Puts the log into a table on disk, compacts it and counts its rows."""
    table = kv.KVTable(spark, scratch(spark, "kv"))
    table.put(_cells(spark, d).where("col is not null"))
    return table.compact(scratch(spark, "kv")).rows().select("key").distinct().agg(F.count("*").alias("n"))


_NATION_CELLS = "cells as (select n_nationkey::varchar as key, 'name' as col, n_name as value from nation union all select n_nationkey::varchar, 'region', n_regionkey::varchar from nation)"


def _nation_table(spark: SparkSession, d: str) -> kv.KVTable:
    table = kv.KVTable(spark, scratch(spark, "kv"))
    n = _t(spark, d, "nation")
    cell = lambda col, c: n.select(F.col("n_nationkey").cast("string").alias("key"), F.lit(col).alias("col"), F.col(c).cast("string").alias("value"))
    table.put(cell("name", "n_name").unionByName(cell("region", "n_regionkey")))
    return table


@query(f"with {_NATION_CELLS} select k.key, k.col, value from (values ('3', 'name'), ('3', 'region'), ('24', 'name'), ('24', 'flag'), ('99', 'name')) k(key, col) left join cells using (key, col)")
def kv_get_cells(spark: SparkSession, d: str) -> DataFrame:
    table = _nation_table(spark, d)
    asked = [("3", "name"), ("3", "region"), ("24", "name"), ("24", "flag"), ("99", "name")]
    return spark.createDataFrame([(k, c, table.get(k, c)) for k, c in asked], "key string, col string, value string")


@query(f"with {_NATION_CELLS} select key, col, value from cells where key not in ('5', '7') union all select * from (values ('5', 'name', 'NEW'), ('5', 'flag', 'f')) t(key, col, value)")
def kv_put_row(spark: SparkSession, d: str) -> DataFrame:
    """A row replaced as a whole, and one deleted."""
    table = _nation_table(spark, d)
    table.put_row("5", {"name": "NEW", "flag": "f"})
    table.delete_row("7")
    return table.rows().select("key", "col", "value")


@query(f"with {_NATION_CELLS} select *, false as old_there, true as new_there, false as dropped_there from cells")
def kv_rename_drop(spark: SparkSession, d: str) -> DataFrame:
    """A table under a new name, and one that is dropped."""
    old, gone = _nation_table(spark, d), _nation_table(spark, d)
    new = old.rename(scratch(spark, "kv"))
    gone.drop()
    return new.rows().select("key", "col", "value", F.lit(old.exists()).alias("old_there"), F.lit(new.exists()).alias("new_there"), F.lit(gone.exists()).alias("dropped_there"))


@query("select n_nationkey, sha1(n_nationkey::varchar || '|n_name=' || n_name || '|n_regionkey=' || n_regionkey::varchar) as fingerprint from nation")
def row_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "nation").select("n_nationkey", T.row_fingerprint(F.col("n_nationkey"), {"n_regionkey": F.col("n_regionkey"), "n_name": F.col("n_name")}).alias("fingerprint"))


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings crawl frontier visited hosts postings vocab tfidf page_meta search_terms key_pages lang_samples".split()


@query(" union all ".join(f"select '{t}' as name, count(*) as rows from {t}" for t in _TABLES))
def table_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The tables that a listing of the folder shows, with their rows, which come from the files' footers."""
    out = None
    for t in table_names(spark, d):
        one = _t(spark, d, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- urls

_REST = r"'^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(.*)$'"


@query(rf"""select url, lower(regexp_extract(url, '^\s*([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) as scheme, lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)', 1)) as host,
case when lower(url) similar to '\s*https://.*' and p = '' then 443 when lower(url) similar to '\s*http://.*' and p = '' then 80 else try_cast(nullif(p, '') as int) end as port, case when not regexp_matches(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://') then url when regexp_extract(url, {_REST}, 1) = '' then '/' else regexp_extract(url, {_REST}, 1) end as rest from (select url, regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#:]*:([0-9]+)(?:[/?#]|$)', 1) as p from frontier)""")
def url_parse(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _t(spark, d, "frontier").select("url", U.url_scheme(u).alias("scheme"), U.url_host(u).alias("host"), U.url_port(u).alias("port"), U.url_rest(u).alias("rest"))


@query(r"""with a as (select queue_id, lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)', 1)) as h, regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#:]*:([0-9]+)(?:[/?#]|$)', 1) as p, lower(trim(url)) as u from frontier where url is not null)
select queue_id, case when h = '' then '' else h || ':' || case when p <> '' then p when starts_with(u, 'https:') then '443' else '80' end end as host_key from a""")
def url_host_keys(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "frontier").where("url is not null").select("queue_id", U.host_key(F.col("url")).alias("host_key"))


_CODED = ["a%20b+c", "caf%C3%A9", "100%", "%zz", "plain", ""]


@query("select * from (values ('a%20b+c', 'a b c'), ('caf%C3%A9', 'café'), ('100%', '100%'), ('%zz', '%zz'), ('plain', 'plain'), ('', '')) t(url, shown)")
def decoded_urls(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(u,) for u in _CODED], "url string").select("url", U.decode_url(F.col("url")).alias("shown"))


_HREFS = [
    ("../c#x", "http://h.com/c"), ("//E.com", "http://e.com/"), ("https://h.com:443/p?q=1", "https://h.com/p?q=1"), ("mailto:x", None), ("?y=2", "http://h.com/a/b.html?y=2"), ("d/./e/../f/", "http://h.com/a/d/f/"),
    ("/", "http://h.com/"), ("#top", None), ("", None), ("HTTPS://E.com/", "https://e.com/"), ("ftp://h.com/x", None),
]


@query("select * from (values " + ", ".join(f"('{h}', {repr(t) if t else 'null'})" for h, t in _HREFS) + ") t(href, target)")
def resolved_hrefs(spark: SparkSession, d: str) -> DataFrame:
    """Links as they are written on the page http://h.com/a/b.html, resolved."""
    return spark.createDataFrame([(h,) for h, _ in _HREFS], "href string").select("href", U.resolve_url(F.lit("http://h.com/a/b.html"), F.col("href")).alias("target"))


_SKIPPED = [("#a", True), (" MAILTO:x", True), ("tel:1", True), ("javascript:void(0)", True), ("data:,x", True), ("about:blank", True), ("ftp://h/", True), ("", True), ("/a", False), ("http://h/", False)]


@query("select * from (values " + ", ".join(f"('{h}', {str(s).lower()})" for h, s in _SKIPPED) + ") t(href, skipped)")
def skippable_hrefs(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(h,) for h, _ in _SKIPPED], "href string").select("href", U.is_skippable_href(F.col("href")).alias("skipped"))


_LEGACY = [("c.html?q=1#x", "http://h.com:80/a/c.html"), ("https://E.com", "https://e.com:443/"), ("http://h.com:8080/a%20b", "http://h.com:8080/a b"), ("mailto:x", None)]


@query("select * from (values " + ", ".join(f"('{h}', {repr(t) if t else 'null'})" for h, t in _LEGACY) + ") t(href, target)")
def legacy_rank_urls(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(h,) for h, _ in _LEGACY], "href string").select("href", U.legacy_rank_url(F.lit("http://h.com/a/b.html"), F.col("href")).alias("target"))


@query(r"""with a as (select queue_id, regexp_replace(regexp_replace(url, '^\s+|\s+$', '', 'g'), '#.*$', '') as u from frontier),
b as (select *, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) as s, lower(regexp_extract(u, '^[A-Za-z]+://([^/?]*)', 1)) as h, regexp_extract(u, '^[A-Za-z]+://[^/?]*([^?]*)', 1) as p, regexp_extract(u, '^[A-Za-z]+://[^?]*(\?.*)$', 1) as q from a),
c as (select *, case when s = 'http' then regexp_replace(h, ':(80)?$', '') else regexp_replace(h, ':(443)?$', '') end as h2, string_split(substr(p, 2), '/') as parts from b),
d as (select *, list_filter(parts, lambda x, i: x <> '.') as np from c),
e as (select *, list_reduce(list_transform(np, lambda x: [x]), lambda acc, x: case when x[1] = '..' then acc[1:len(acc) - 1] else list_concat(acc, x) end, []::varchar[]) as seg from d)
select queue_id, case when u = '' or u is null then null when s = '' then u else s || '://' || h2 || case when p = '' then '/' when not regexp_matches(p, '/\.\.?(/|$)') then p
 else '/' || array_to_string(seg, '/') || case when parts[-1] in ('.', '..') and len(seg) > 0 then '/' else '' end end || q end as canonical from e""")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "frontier").select("queue_id", U.normalize_url(F.col("url")).alias("canonical"))


def _policy_sql(u: str) -> str:
    """The crawl policy as patterns, written apart from the lists of ``functions.url``."""
    host = rf"lower(regexp_extract({u}, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1))"
    rest = rf"lower(regexp_extract({u}, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(.*)$', 1))"
    return rf"""(regexp_matches({u}, '^(?i)https?://[^/?#]') and {host} <> ''
 and not regexp_full_match({host}, '((www\.)?(facebook|twitter|instagram|linkedin|youtube|tiktok|reddit|quora|medium|pinterest)\.com)|t\.co|(m\.)?baidu\.com|translate\.google\.com|doubleclick\.net|googletagmanager\.com|google-analytics\.com|adservice\.google\.com|scorecardresearch\.com|taboola\.com|outbrain\.com|(api|static)\.nytimes\.com|api\.bbc\.com|cdn\.(cnn|britannica)\.com|akamaihd\.net|cloudfront\.net|fastly\.net|localhost|127\.0\.0\.1')
 and not regexp_matches({rest}, '\.(jpg|jpeg|png|gif|svg|webp|mp4|mov|avi|mkv|webm|mp3|wav|pdf|doc|docx|ppt|pptx|xls|xlsx|zip|tar|gz|tgz|rar|7z|css|js|woff|woff2|ttf|eot|php|aspx)$')
 and not regexp_matches(lower({u}), '[?&]utm_|gclid=|fbclid=|\?ref=|\?source=|/(login|signin|logout|subscribe|account|profile|register|checkout|cart|calendar|graphql)|/search\?|/\?q=|query=|/(events|year|month|day|api|ajax|feeds|print)/|/share\?|/facebook\.com/sharer|/twitter\.com/share|\.json|\.xml|\?print|;jsessionid=')
 and not regexp_matches({rest}, '/(es|de|fr|ja|zh|ru|ar)/'))"""


@query(f"select queue_id, coalesce({_policy_sql('url')}, false) as crawl from frontier")
def url_should_crawl(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "frontier").select("queue_id", U.should_crawl(F.col("url")).alias("crawl"))


_POLICY = [
    ("http://a.com/x.mkv", False), ("http://a.com/x.TGZ", False), ("http://a.com/favicon.ico", True), ("http://a.com/x.bmp", True), ("http://a.com/twitter.com/share", False), ("http://a.com/facebook.com/sharer", False),
    ("http://www.youtube.com/", False), ("http://music.youtube.com/", True), ("http://LOCALHOST:80/", False), ("https://a.com/DE/x", False), ("https://a.com/?utm_x=1", False), ("https://a.com/loginpage", False),
    ("https://a.com/x.php?y=1", True), ("https://a.com/?f=x.php", False), ("ftp://a.com/", False), ("http:///x", False), ("", False),
]


@query("select * from (values " + ", ".join(f"('{u}', {str(ok).lower()})" for u, ok in _POLICY) + ") t(url, crawl)")
def crawl_policy_cases(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(u,) for u, _ in _POLICY], "url string").select("url", U.should_crawl(F.col("url")).alias("crawl"))


_HOST = r"lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1))"
# Lines of robots files in groups: a user-agent line after a rule begins a group; a host's own group counts, else that of all.
_ROBOTS = r"""rb0 as (select lower(host) as host, string_split_regex(regexp_replace(robots_txt, '#[^\r\n]*', '', 'g'), '\r\n|\r|\n') as l from hosts where host is not null and robots_status between 200 and 299 and robots_txt is not null),
rb1 as (select host, unnest(l) as line, generate_subscripts(l, 1) as i from rb0),
rb2 as (select host, i, lower(trim(regexp_extract(line, '^([^:]*):', 1))) as f, trim(regexp_extract(line, '^[^:]*:(.*)$', 1)) as v from rb1),
rb3 as (select *, lag(f) over (partition by host order by i) as before from rb2 where f in ('user-agent', 'allow', 'disallow')),
rb4 as (select *, sum(case when f = 'user-agent' and before is not null and before <> 'user-agent' then 1 else 0 end) over (partition by host order by i) as g from rb3),
rb5 as (select *, bool_or(f = 'user-agent' and lower(v) = 'weftline') over (partition by host, g) as own, bool_or(f = 'user-agent' and v = '*') over (partition by host, g) as every, bool_or(f = 'user-agent' and lower(v) = 'weftline') over (partition by host) as named from rb4),
robots as (select host, f, v from rb5 where f <> 'user-agent' and v <> '' and case when named then own else every end)"""


def _denied_sql(source: str, key: str, host: str, path: str) -> str:
    """The keys of a table whose path the longest matching rule of the host forbids, on equal length Allow before Disallow."""
    return f"""select {key} from (select s.{key}, r.f, row_number() over (partition by s.{key} order by length(r.v) desc, r.f) as n from {source} s join robots r on r.host = s.{host} and starts_with(s.{path}, r.v)) where n = 1 and f = 'disallow'"""


@query(rf"""with {_ROBOTS}, f as (select queue_id, {_HOST} as host, case when not regexp_matches(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://') then url when regexp_extract(url, {_REST}, 1) = '' then '/' else regexp_extract(url, {_REST}, 1) end as path from frontier),
g as (select * from f where host <> ''), no as ({_denied_sql("g", "queue_id", "host", "path")}),
dl as (select lower(host) as host, coalesce(try_cast(nullif(regexp_extract(robots_txt, '(?im)^[ \t]*crawl-delay[ \t]*:[ \t]*([0-9]+(?:\.[0-9]+)?)', 1), '') as double), 1.0) as delay from hosts)
select queue_id, queue_id not in (select queue_id from no) as allowed, coalesce(delay, 1.0) as delay from g left join dl using (host)""")
def robots_check(spark: SparkSession, d: str) -> DataFrame:
    """Which frontier urls their host's robots rules allow, with the delay asked for; hosts are joined by name."""
    hosts = _t(spark, d, "hosts")
    delays = hosts.select(F.lower("host").alias("host"), U.robots_delay(F.col("robots_txt")).alias("delay"))
    f = _t(spark, d, "frontier").select("queue_id", U.url_host(F.col("url")).alias("host"), U.url_rest(F.col("url")).alias("path")).where("host <> ''")
    joined = f.join(C.host_rules(hosts), "host", "left").join(delays, "host", "left")
    return joined.select("queue_id", F.coalesce(U.robots_allowed(F.col("rules"), F.col("path")), F.lit(True)).alias("allowed"), F.coalesce("delay", F.lit(1.0)).alias("delay"))


@query(r"""select host, coalesce(try_cast(nullif(regexp_extract(robots_txt, '(?im)^[ \t]*crawl-delay[ \t]*:[ \t]*([0-9]+(?:\.[0-9]+)?)', 1), '') as double), 1.0) as delay from hosts""")
def robots_delays(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "hosts").select("host", U.robots_delay(F.col("robots_txt")).alias("delay"))


@query("select host, coalesce(epoch_ms(timestamptz '2025-12-01 00:00:00+00') - epoch_ms(last_access) < ceil(coalesce(crawl_delay, 1.0) * 1000), false) as too_early from hosts")
def host_politeness(spark: SparkSession, d: str) -> DataFrame:
    h = _t(spark, d, "hosts")
    return h.select("host", C.too_early(F.col("last_access"), F.lit("2025-12-01 00:00:00").cast("timestamp"), F.col("crawl_delay")).alias("too_early"))


@query("""with h as (select queue_id, url, lower(regexp_extract(url, '^\\s*[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#:]*)', 1)) as host from frontier where url is not null)
select queue_id from (select queue_id, row_number() over (partition by host order by queue_id) as n from h) where n <= 500""")
def host_cap(spark: SparkSession, d: str) -> DataFrame:
    return C.host_capped(_t(spark, d, "frontier").where("url is not null"), ["queue_id"]).select("queue_id")


# ---------------------------------------------------------------- pages

_TXT = f"with {_PAGES}, t as (select url, {_text()} as html from pages)"


def _pages(spark: SparkSession, d: str, **columns: Column) -> DataFrame:
    """What the columns give for the latest page of each url."""
    return I.latest(_t(spark, d, "crawl"), **columns)


def _html(limit: int | None = H.PAGE_BYTES) -> Column:
    return H.page_text(F.col("page"), F.col("content_type"), limit)


@query(f"with {_PAGES} select url, octet_length(page)::bigint as bytes, md5(page) as digest from pages")
def cached_page(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d, bytes=F.octet_length("page").cast("bigint"), digest=F.md5("page"))


@query(f"with {_PAGES} select url, md5({_text(None)}) as digest from pages where url in (select url from key_pages)")
def cached_page_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The stored pages of the urls asked for."""
    return I.cached_pages(_t(spark, d, "crawl"), _t(spark, d, "key_pages")).select("url", F.md5("html").alias("digest"))


@query(f"with {_PAGES} select url, md5({_text(None)}) as digest from pages where url = (select min(url) from crawl where page is not null)")
def cached_page_by_url(spark: SparkSession, d: str) -> DataFrame:
    crawl = _t(spark, d, "crawl")
    url = crawl.where("page is not null").agg(F.min("url")).first()[0]
    return I.cached_page(crawl, url).select("url", F.md5("html").alias("digest"))


_TITLE = _collapse(_sub(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)", r"<[^>]+>"))


@query(f"{_TXT}, x as (select url, {_TITLE} as t from t) select url, case when t = '' then url when length(t) > 120 then t[1:120] || '...' else t end as title from x")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d, title=H.title(_html(), F.col("url")))


def _body_sql(strip: str, body: str) -> str:
    return f"{_TXT}, x as (select url, {strip} as s from t) select url, md5({body}) as digest from x"


@query(_body_sql(*_index_body("html")))
def html_body_index(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d, digest=F.md5(H.body_for_index(_html())))


@query(_body_sql(*_tfidf_body("html")))
def html_body_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d, digest=F.md5(H.body_for_tfidf(_html())))


@query(f"{_TXT} select url, md5({_rank_body('html')}) as digest from t")
def html_body_rank(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d, digest=F.md5(H.body_for_rank(_html())))


def _meta_sql(attr: str, name: str) -> str:
    tag = rf"regexp_extract(html, '(?is)<meta\b[^>]*{attr}\s*=\s*[\"'']{name}[\"''][^>]*>', 0)".replace('\\"', '"')
    value = rf"""regexp_extract({tag}, '(?is)content\s*=\s*("[^"]*"|''[^'']*'')', 1)"""
    return f"nullif(trim({_ent(f"""regexp_replace({value}, '^["'']|["'']$', '', 'g')""", True)}), '')"


_DESCRIPTION = f"coalesce({_meta_sql('property', 'og:description')}, {_meta_sql('name', 'description')}, {_meta_sql('name', 'twitter:description')})"
_SEMANTIC = "coalesce(" + ", ".join(rf"nullif(regexp_extract(html, '(?is)<{t}\b[^>]*>(.*?)</{t}>', 1), '')" for t in ("main", "article", "section")) + ")"


@query(f"""{_TXT}, x as (select url, {_DESCRIPTION} as a, nullif({_collapse(_sub(_SEMANTIC, r"<[^>]+>"))}, '') as b, {_rank_body("html")} as c from t),
y as (select url, trim(coalesce(a, b, {_collapse(_sub("case when length(c) > 300 then substr(c, 301) else c end", r"<[^>]+>"))})) as s from x)
select url, case when length(s) > 200 then s[1:200] || '...' else s end as snippet from y""")
def html_snippet(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d, snippet=H.snippet(_html()))


_HREF = r"""'(?is)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)'"""



def _hrefs_sql(limit: int | None) -> str:
    """CTEs up to ``y``: the links (url, pos, href) of the latest pages."""
    return rf"""{_PAGES}, t as (select url, {_text(limit)} as html from pages), x as (select url, regexp_extract_all(html, {_HREF}, 1) as l from t), y0 as (select url, unnest(l) as href, generate_subscripts(l, 1) - 1 as pos from x),
y as (select url, pos::int as pos, trim(regexp_replace(href, '^["'']|["'']$', '', 'g')) as href from y0)"""


def _canon_sql(name: str, source: str, col: str) -> str:
    """CTEs up to ``name``: the rows of ``source`` with ``canon``, the canonical form of the url in ``col``."""
    n = name
    return rf"""{n}1 as (select *, regexp_replace(regexp_replace({col}, '^\s+|\s+$', '', 'g'), '\s*#.*$', '') as u_ from {source}),
{n}2 as (select *, lower(regexp_extract(u_, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) as s_, lower(regexp_extract(u_, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?]*)', 1)) as h_, regexp_extract(u_, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*([^?]*)', 1) as p_, regexp_extract(u_, '^[A-Za-z][A-Za-z0-9+.\-]*://[^?]*(\?.*)$', 1) as q_ from {n}1),
{n}3 as (select *, case when s_ = 'http' then regexp_replace(h_, ':(80)?$', '') when s_ = 'https' then regexp_replace(h_, ':(443)?$', '') else regexp_replace(h_, ':$', '') end as k_, string_split(substr(p_, 2), '/') as a_ from {n}2),
{n}4 as (select *, list_reduce(list_transform(list_filter(a_, lambda x: x <> '.'), lambda x: [x]), lambda acc, x: case when x[1] = '..' then acc[1:len(acc) - 1] else list_concat(acc, x) end, []::varchar[]) as g_ from {n}3),
{n} as (select * exclude (u_, s_, h_, p_, q_, k_, a_, g_), case when u_ = '' or u_ is null then null when s_ = '' then u_ else s_ || '://' || k_ || case when p_ = '' then '/' when not regexp_matches(p_, '/\.\.?(/|$)') then p_
 else '/' || array_to_string(g_, '/') || case when a_[-1] in ('.', '..') and len(g_) > 0 then '/' else '' end end || q_ end as canon from {n}4)"""


def _resolve_sql(name: str, source: str) -> str:
    """CTEs up to ``name``: the links of ``source`` (url, href, ...) that aren't skipped, with their absolute ``canon``."""
    return rf"""{name}a as (select *, regexp_replace(regexp_replace(href, '^\s+|\s+$', '', 'g'), '\s*#.*$', '') as h, regexp_extract(url, '^\s*([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) as root,
 regexp_extract(url, '^\s*([A-Za-z][A-Za-z0-9+.\-]*):', 1) as sch, regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) as path from {source}
 where not regexp_matches(lower(trim(href)), '^(#|mailto:|tel:|javascript:|data:|about:|ftp:)') and trim(href) <> ''),
{name}b as (select * exclude (h, root, sch, path), case when h = '' or root = '' then null when regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.\-]*:') then h when starts_with(h, '//') then sch || ':' || h when starts_with(h, '/') then root || h
 when starts_with(h, '?') then root || case when path = '' then '/' else path end || h else root || case when path = '' then '/' else regexp_replace(path, '[^/]*$', '') end || h end as full_ from {name}a),
{_canon_sql(name + "c", name + "b", "full_")},
{name} as (select * from {name}c where regexp_matches(canon, '^https?://[^/]'))"""


@query(f"with {_hrefs_sql(None)} select url, pos, href from y")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d, hrefs=H.hrefs(_html(None))).select("url", F.posexplode("hrefs").alias("pos", "href"))


_TOP30 = f"""{_hrefs_sql(H.PAGE_BYTES)}, {_resolve_sql("z", "y")}, zz as (select url, pos, canon as dst from z), {_canon_sql("sr", "zz", "url")},
lk as (select canon as src, dst, min(pos) as pos from sr where dst <> canon group by 1, 2),
top30 as (select src, dst, pos from (select *, row_number() over (partition by src order by pos, dst) as r from lk) where r <= 30)"""


@query(f"with {_TOP30} select src, dst, pos from top30")
def links_top30(spark: SparkSession, d: str) -> DataFrame:
    return P.links_of(_pages(spark, d, hrefs=H.hrefs(_html())))


# ---------------------------------------------------------------- index, weights, ranks

_S1, _B1 = _index_body("a")
_S2, _B2 = _tfidf_body("a")
_INDEX = f"""{_PAGES}, n as (select count(*) as pages from pages), cap as (select greatest(1, least(100, case when floor(pages * 0.15) = 0 then 100 else floor(pages * 0.15) end)) as cap from n),
i1 as (select url, {_ascii("page[1:20000]")} as a from pages where octet_length(page) >= 100 and regexp_matches(url, '^(?i)https?://')), i2 as (select url, {_S1} as s from i1), i3 as (select url, {_B1} as b from i2),
i4 as (select url, unnest(string_split_regex(lower(b), '[^a-z]+')) as w from i3), i5 as (select url, w, count(*) as tf from i4 where {_TERMS} group by 1, 2),
idx as (select w as word, url, tf from (select *, row_number() over (partition by w order by url) as r from i5 where tf >= 2) where r <= (select cap from cap)),
voc as (select word, count(*) as df from idx group by 1)"""
_WEIGHTS = f"""{_INDEX}, j1 as (select url, {_ascii("page[1:20000]")} as a from pages where octet_length(page) >= 64), j2 as (select url, {_S2} as s from j1), j3 as (select url, {_B2} as b from j2),
j4 as (select url, unnest(string_split_regex(lower(b), '[^a-z]+')) as w from j3), j5 as (select url, w, count(*) as c from j4 where {_TERMS} group by 1, 2),
j6 as (select url, w, c from (select *, row_number() over (partition by url order by c desc, w) as r from j5) where r <= 60),
wts as (select word, url, 1 + ln(c) as tf, ln((pages + 1.0) / (df + 1.0)) as idf, (1 + ln(c)) * ln((pages + 1.0) / (df + 1.0)) as tfidf from j6 join voc on w = word cross join n where ln((pages + 1.0) / (df + 1.0)) > 0)"""


@query(f"with {_INDEX} select word, url, tf from idx")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    return I.build_index(_t(spark, d, "crawl"))[0]


@query(f"with {_INDEX} select word, df from voc")
def vocab_df(spark: SparkSession, d: str) -> DataFrame:
    return I.build_index(_t(spark, d, "crawl"))[1]


@query(f"with {_WEIGHTS} select word, url, round(tf, 6) as tf, round(idf, 6) as idf, round(tfidf, 6) as tfidf from wts")
def tfidf_scores(spark: SparkSession, d: str) -> DataFrame:
    return I.build(_t(spark, d, "crawl"))[2].select("word", "url", *[F.round(c, 6).alias(c) for c in ("tf", "idf", "tfidf")])


def _converge_sql(rounds: int, tolerance: float) -> str:
    """Rounds until no rank changes by the tolerance: ranks stay as they are from then on."""
    out = "q0 as materialized (select id, n, d, 1.0::double / n as rank, false as stop from vt)"
    for i in range(1, rounds + 1):
        p = f"q{i - 1}"
        out += f""", n{i} as materialized (select id, n, d, rank as old, stop, case when stop then rank else 0.15 / n + 0.85 * coalesce(x, 0) + 0.85 * (select coalesce(sum(rank), 0) from {p} where d) / n end as rank
 from {p} left join (select dst, sum(rank / o) as x from ed join {p} on src = id group by 1) on dst = id),
q{i} as materialized (select id, n, d, rank, stop or (select max(abs(rank - old)) < {tolerance} from n{i}) as stop from n{i})"""
    return out


@query(f"""with {_TOP30}, ed as materialized (select src, dst, count(*) over (partition by src) as o from top30), {_canon_sql("vc", "pages", "url")}, vs as (select distinct canon as id from vc),
vt as materialized (select id, count(*) over () as n, id not in (select src from ed) as d from vs), {_converge_sql(P.ROUNDS, P.TOLERANCE)} select id, round(rank, 9) as rank from q{P.ROUNDS}""")
def pagerank_pages(spark: SparkSession, d: str) -> DataFrame:
    """Ranks until no rank changes by the tolerance."""
    pages = cut(_pages(spark, d, id=U.normalize_url(F.col("url")), hrefs=H.hrefs(_html())), "links")
    ranks = P.pagerank(pages.select("id"), P.links_of(pages).select("src", "dst"))
    return ranks.select("id", F.round("rank", 9).alias("rank"))


_PARTS = """l as (select distinct l_orderkey, l_linenumber, l_partkey from lineitem where l_returnflag = 'R'),
e0 as (select distinct a.l_partkey as src, b.l_partkey as dst from l a join l b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 where a.l_partkey <> b.l_partkey),
e as (select src, dst, count(*) over (partition by src) as o from (select *, row_number() over (partition by src order by dst) as r from e0) where r <= 30),
v as (select p_partkey as id, count(*) over () as n, p_partkey not in (select src from e) as d from part)"""


def _rounds_sql(k: int) -> str:
    out = "r0 as (select id, n, d, 1.0::double / n as rank from v)"
    for i in range(1, k + 1):
        p = f"r{i - 1}"
        out += f""", c{i} as (select dst, sum(rank / o) as x from e join {p} on src = id group by 1), s{i} as (select coalesce(sum(rank), 0) as s from {p} where d),
r{i} as (select id, n, d, 0.15 / n + 0.85 * coalesce(x, 0) + 0.85 * s / n as rank from {p} left join c{i} on dst = id cross join s{i})"""
    return out


@query(f"with {_PARTS}, {_rounds_sql(5)} select id, round(rank, 9) as rank from r5")
def pagerank_parts_k5(spark: SparkSession, d: str) -> DataFrame:
    """Five rounds over the graph of parts that follow each other in an order."""
    item = _t(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    nxt = item.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    edges = item.join(nxt, ["l_orderkey", "l_linenumber"]).where("l_partkey <> dst").select(F.col("l_partkey").alias("src"), "dst").distinct()
    edges = per_key_limit(edges, "src", [F.col("dst")], P.LINKS_PER_PAGE)
    ranks = P.pagerank(_t(spark, d, "part").select(F.col("p_partkey").alias("id")), edges, rounds=5, tolerance=None)
    return ranks.select("id", F.round("rank", 9).alias("rank"))


# ---------------------------------------------------------------- search

_META = """meta as (select url, title, snippet, pagerank from (select *, row_number() over (partition by url order by ranked_at desc nulls last, pagerank desc nulls last, title desc nulls last, snippet desc nulls last) as r from page_meta where url is not null) where r = 1)"""
_POST = f"post as (select {_WORD} as word, url, tf from postings where word is not null), wt as (select {_WORD} as word, url, max(case when tfidf > 0 and not isnan(tfidf) then tfidf end) as tfidf from tfidf where word is not null group by 1, 2)"


def _search_sql(words: list[str], city: str | None = None, source: str = "post") -> str:
    ws = sorted(set(words))
    inn = ", ".join(f"'{w}'" for w in ws)
    share = lambda c: "(" + " + ".join(f"contains(lower({c}), '{w}')::int" for w in words) + f") / {len(words)}.0::double"
    near = f"case when contains(lower(title), '{city.lower()}') or contains(lower(url), '{city.lower()}') or contains(lower(snippet), '{city.lower()}') then 1.0 else 0.0 end" if city else "0.0"
    return f"""cand as (select url from {source} where word in ({inn}) group by 1 having count(distinct word) = {len(ws)}),
avgw as (select url, avg(tfidf) as w from wt where word in ({inn}) and tfidf > 0 group by 1),
f as (select c.url, coalesce(nullif(trim(m.title), ''), c.url) as title, coalesce(m.snippet, '...') as snippet, coalesce(case when not isnan(m.pagerank) then m.pagerank end, 0.1) as pagerank, coalesce(w, 0.0) as tfidf from cand c left join avgw a on a.url = c.url left join meta m on m.url = c.url),
sc as (select *, (0.45 * ln(1 + greatest(pagerank, 0)) + 0.45 * greatest(tfidf, 0) + 0.07 * {share("title")} + 0.03 * {share("url")}) * (1 + 0.2 * {near}) * case when length(url) <= 120 then 1.0::double else 1.0 / (1.0 + (length(url) - 120) / 60.0) end as score from f),
best as (select * from (select *, row_number() over (partition by case when trim(title) = '' then chr(1) || url else lower(trim(title)) end order by score desc, url) as r from sc) where r = 1)"""


def _search_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    post = _t(spark, d, "postings").select(normal_word(F.col("word")).alias("word"), "url", "tf").where("word is not null")
    good = F.when((F.col("tfidf") > 0) & ~F.isnan("tfidf"), F.col("tfidf"))
    wt = _t(spark, d, "tfidf").select(normal_word(F.col("word")).alias("word"), "url", good.alias("tfidf")).where("word is not null").groupBy("word", "url").agg(F.max("tfidf").alias("tfidf"))
    return post, wt, _t(spark, d, "page_meta")


@query(f"with {_META}, {_POST}, {_search_sql(['guide', 'water'])} select url, title, round(score, 6) as score from best order by best.score desc, url limit 10")
def search_ranked(spark: SparkSession, d: str) -> DataFrame:
    out = S.search(*_search_tables(spark, d), "the Guide water")
    return S.result_page(out, 1).select("url", "title", F.round("score", 6).alias("score"))


@query(f"with {_META}, {_POST}, {_search_sql(['city', 'market'], 'Market')} select url, round(score, 6) as score from best")
def search_geo(spark: SparkSession, d: str) -> DataFrame:
    return S.search(*_search_tables(spark, d), "city market", city="Market").select("url", F.round("score", 6).alias("score"))


_LONG = "https://long.example/" + "x" * 150


@query(f"""with {_META}, {_POST}, post2 as (select * from post union all select 'music', '{_LONG}', 3), {_search_sql(['music'], source='post2')} select url, round(score, 6) as score from best""")
def search_long_url(spark: SparkSession, d: str) -> DataFrame:
    post, wt, meta = _search_tables(spark, d)
    extra = spark.createDataFrame([("music", _LONG, 3)], post.schema)
    return S.search(post.unionByName(extra), wt, meta, "music").select("url", F.round("score", 6).alias("score"))


@query(f"""with {_META}, {_POST}, {_search_sql(['music', 'school'])} select b.url, list(wt.word order by wt.word)[1:5] as words from best b join wt on wt.url = b.url and wt.word in ('music', 'school') and wt.tfidf > 0 group by 1""")
def search_diag(spark: SparkSession, d: str) -> DataFrame:
    """Which words of the query have a weight on each result, at most five."""
    post, wt, meta = _search_tables(spark, d)
    res = S.search(post, wt, meta, "music school").select("url")
    parts = wt.where(F.col("word").isin("music", "school") & (F.col("tfidf") > 0)).join(res, "url", "left_semi")
    return parts.groupBy("url").agg(F.slice(F.array_sort(F.collect_list("word")), 1, 5).alias("words"))


@query(f"""with {_META}, {_POST}, {_search_sql(['guide', 'water'])} select url, title, round(score, 6) as score from best""")
def search_stored(spark: SparkSession, d: str) -> DataFrame:
    """The search over postings that were stored in order of their words: its word filter reaches the scan."""
    _, wt, meta = _search_tables(spark, d)
    path = scratch(spark, "postings")
    S.store_index(_t(spark, d, "postings"), path, normal_word(F.col("word")))
    return S.search(spark.read.parquet(path), wt, meta, "the Guide water").select("url", "title", F.round("score", 6).alias("score"))


@query(f"""with {_META}, {_POST}, {_search_sql(['music', 'school'])}, pt as (select *, row_number() over (partition by word, url order by tfidf desc, tf desc nulls last, idf desc nulls last) as r
 from (select {_WORD} as word, url, tf, idf, tfidf from tfidf where word is not null and tfidf > 0 and not isnan(tfidf)))
select b.url, row_number() over (partition by b.url order by case word when 'school' then 1 else 2 end) as pos, word, round(pt.tf, 6) as tf, round(pt.idf, 6) as idf, round(pt.tfidf, 6) as tfidf from best b join pt on pt.url = b.url and pt.r = 1 and word in ('music', 'school')""")
def term_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """What each word of the query adds to each result, in the order of the query."""
    post, wt, meta = _search_tables(spark, d)
    results = S.search(post, wt, meta, "school music").select("url")
    rows = _t(spark, d, "tfidf").where((F.col("tfidf") > 0) & ~F.isnan("tfidf")).select(normal_word(F.col("word")).alias("word"), "url", F.struct("tfidf", "tf", "idf").alias("s")).where("word is not null")
    best = rows.groupBy("word", "url").agg(F.max("s").alias("s")).select("word", "url", "s.*")
    return S.term_parts(best, results, "school music").select("url", "pos", "word", *[F.round(c, 6).alias(c) for c in ("tf", "idf", "tfidf")])


@query("select distinct lower(trim(word)) as word from vocab where word is not null and lower(trim(word)) <> '' and starts_with(lower(trim(word)), 'ma') order by word limit 8")
def suggest_prefix(spark: SparkSession, d: str) -> DataFrame:
    return S.complete(S.dictionary(_t(spark, d, "vocab")), "Ma")


@query("select '[' || string_agg('\"' || word || '\"', ',' order by word) || ']' as json from (select distinct lower(trim(word)) as word from vocab where word is not null and starts_with(lower(trim(word)), 'be') order by word limit 8)")
def suggest_json(spark: SparkSession, d: str) -> DataFrame:
    words = S.complete(S.dictionary(_t(spark, d, "vocab")), "be")
    return words.agg(T.json_suggestions(F.array_sort(F.collect_list("word"))).alias("json"))


_MISSPELT = ["gude", "markett", "watter", "school", "zzzzzzzzz", "revew"]


@query(f"""with v as (select distinct lower(trim(word)) as word from vocab where word is not null and lower(trim(word)) <> ''), t as (select unnest([{", ".join(f"'{w}'" for w in _MISSPELT)}]) as token),
b as (select token, word, row_number() over (partition by token order by levenshtein(word, token), word) as r from t join v on abs(length(word) - length(token)) <= 2 and levenshtein(word, token) <= 2)
select t.token, coalesce(b.word, t.token) as suggestion from t left join b on b.token = t.token and b.r = 1""")
def spell_suggest(spark: SparkSession, d: str) -> DataFrame:
    return S.spell(S.dictionary(_t(spark, d, "vocab")), spark.createDataFrame([(w,) for w in _MISSPELT], "token string"))


@query(r"""select url, regexp_replace(snippet, '(?i)(^|[^\pL\pN])(every)($|[^\pL\pN])', '\1<b>\2</b>\3', 'g') as html from
 (select url, replace(replace(replace(replace(replace(snippet, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as snippet from page_meta)""")
def highlight_snippet(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "page_meta").select("url", T.highlight(T.html_escape(F.col("snippet")), F.lit("every")).alias("html"))


_PLACES = [(40.7, -74.0), (34.0, -118.2), (37.77, -122.42), (37.8, -122.25), (37.3, -121.9), (39.95, -75.1), (0.0, 0.0)]


@query("""select lat, lon, case when lat > 40.3 and lat < 41.1 and lon > -74.5 and lon < -73.3 then 'New York' when lat > 33.7 and lat < 34.4 and lon > -119 and lon < -117.5 then 'Los Angeles'
when lat > 37.7 and lat < 37.83 and lon > -122.53 and lon < -122.35 then 'San Francisco' when lat > 37.7 and lat < 37.9 and lon > -122.3 and lon < -122.1 then 'Oakland'
when lat > 37.2 and lat < 37.45 and lon > -122.05 and lon < -121.75 then 'San Jose' when lat > 39.8 and lat < 40.2 and lon > -75.3 and lon < -74.8 then 'Philadelphia' end as city
from (values """ + ", ".join(f"({a}::double, {b}::double)" for a, b in _PLACES) + ") t(lat, lon)")
def geo_city(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(_PLACES, "lat double, lon double").select("lat", "lon", T.city_of(F.col("lat"), F.col("lon")).alias("city"))


@query("select s_suppkey, round(greatest(0, least(1, (s_acctbal - lo) / (hi - lo))), 6) as scaled from supplier, (select min(s_acctbal) as lo, max(s_acctbal) as hi from supplier)")
def min_max_scaled(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier")
    r = s.agg(F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"))
    return s.join(F.broadcast(r)).select("s_suppkey", F.round(T.min_max(F.col("s_acctbal"), F.col("lo"), F.col("hi")), 6).alias("scaled"))  # one row


@query("select date_trunc('day', ts)::date::varchar as day, min(value) as low, max(value) as high, arg_min(value, event_id) as first from events group by 1")
def daily_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    return e.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.min_by("value", "event_id").alias("first"))


@query(rf"""select url, w as word, count(*) as n from (select url, unnest(string_split_regex(lower(title), '\s+')) as w from page_meta where title is not null) where w <> '' and w not in ({_STOP}) group by 1, 2""")
def query_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Titles taken apart as queries are."""
    words = _t(spark, d, "page_meta").select("url", F.explode(T.query_terms(F.col("title"))).alias("word"))
    return words.groupBy("url", "word").agg(F.count("*").alias("n"))


@query("""select url, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as html from page_meta""")
def escaped_titles(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "page_meta").select("url", T.html_escape(F.col("title")).alias("html"))


_WRAPPED = ["https://urldefense.com/v3/__https%3A%2F%2Fx.y%2Fz__;!x", "https://urldefense.com/v3/none", "http://h/a"]


@query("select * from (values ('https://urldefense.com/v3/__https%3A%2F%2Fx.y%2Fz__;!x', 'https://x.y/z'), ('https://urldefense.com/v3/none', null), ('http://h/a', 'http://h/a')) t(url, target)")
def unwrapped_urls(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(u,) for u in _WRAPPED], "url string").select("url", U.unwrap_redirect(F.col("url")).alias("target"))


@query("select url, sha1(url) as id from visited where url is not null")
def surrogate_ids(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "visited").where("url is not null").select("url", T.surrogate_id(F.col("url")).alias("id"))


@query("select word, segment, df from vocab where word >= 'm' order by word, segment limit 11")
def table_browser(spark: SparkSession, d: str) -> DataFrame:
    """A page of a table from a key on, in order of the key, and one row more to tell that it goes on."""
    return kv.scan(_t(spark, d, "vocab"), "m", key="word").select("word", "segment", "df").orderBy("word", "segment").limit(11)


@query("select round(greatest(0, least(1, ((select count(distinct url) from tfidf) - 1)::double / (select count(distinct url) from page_meta))), 6) as ratio")
def build_progress(spark: SparkSession, d: str) -> DataFrame:
    done = _t(spark, d, "tfidf").select("url").where("url is not null").distinct()
    total = _t(spark, d, "page_meta").agg(F.count_distinct("url")).first()[0]
    return spark.range(1).select(F.round(S.completion_ratio(done, total), 6).alias("ratio"))


@query("select url, title[1:0] || coalesce(w[1], '') as a, coalesce(w[2], w[1]) as b, coalesce(w[3], w[1]) as c from (select url, title, list_filter(string_split_regex(trim(title), '\\s+'), lambda x: x <> '') as w from page_meta where title is not null) where len(w) > 0")
def keyword_triples(spark: SparkSession, d: str) -> DataFrame:
    k = _t(spark, d, "page_meta").select("url", T.three_keywords(F.col("title")).alias("k")).where(F.size("k") > 0)
    return k.select("url", F.col("k")[0].alias("a"), F.col("k")[1].alias("b"), F.col("k")[2].alias("c"))


@query("select * from (values ('{\"address\":{\"town\":\"T\",\"county\":\"C\"}}', 'T'), ('{\"city\":\"X\"}', 'X'), ('{}', null)) t(json, city)")
def city_from_json(spark: SparkSession, d: str) -> DataFrame:
    rows = [('{"address":{"town":"T","county":"C"}}',), ('{"city":"X"}',), ("{}",)]
    return spark.createDataFrame(rows, "json string").select("json", T.first_city(F.col("json")).alias("city"))


# ---------------------------------------------------------------- loops and streams


def _crawl_sql(rounds: int) -> str:
    """Rounds as joins: what is reached and allowed, then its links that no earlier round had. No cap is reached here."""
    out = f"""{_canon_sql("wb", "crawl", "url")}, w1 as (select canon as url, page, content_type from (select *, row_number() over (partition by canon order by stored_at desc nulls last, crawl_id desc) as r from wb where page is not null and canon is not null) where r = 1),
t as (select url, {_text(None)} as html from w1), x as (select url, regexp_extract_all(html, {_HREF}, 1) as l from t), y0 as (select url, unnest(l) as href from x),
y as (select url, trim(regexp_replace(href, '^["'']|["'']$', '', 'g')) as href from y0), {_resolve_sql("z", "y")}, e as materialized (select distinct url as src, canon as dst from z where {_policy_sql("canon")}), {_ROBOTS},
hp as (select url, {_HOST} as host, case when regexp_extract(url, {_REST}, 1) = '' then '/' else regexp_extract(url, {_REST}, 1) end as path from w1), no as ({_denied_sql("hp", "url", "host", "path")}),
ok as materialized (select url from w1 where url not in (select url from no)), {_canon_sql("fc", "frontier", "url")}, f0 as materialized (select distinct canon as url from fc where canon is not null), r0 as materialized (select url from f0 where url in (select url from ok))"""
    for i in range(1, rounds):
        seen = "".join(f" except select url from f{k}" for k in range(i))
        out += f", f{i} as materialized (select distinct dst as url from e join r{i - 1} on src = url{seen}), r{i} as materialized (select url from f{i} where url in (select url from ok))"
    return out


@query(f"with {_crawl_sql(6)} " + " union all ".join(f"select url, {i}::int as depth from r{i}" for i in range(6)))
def crawl_frontier(spark: SparkSession, d: str) -> DataFrame:
    """From the frontier's urls over the stored pages, as far as robots rules allow, until no url is left or the page cap
    is reached. The SQL has six rounds, which is enough where it is compared, and no cap, which is not reached there."""
    return C.crawl(_t(spark, d, "crawl"), _t(spark, d, "frontier").select("url"), hosts=_t(spark, d, "hosts"))


@query(f"with {_INDEX} select word, url, tf from idx")
def stream_index_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The stream's index is that of all rows at once."""
    from weftline.streaming.incremental import index_incrementally

    return index_incrementally(stream_table(spark, d, "crawl"), scratch(spark, "index"))


@query(f"with {_WEIGHTS} select word, url, round(tfidf, 6) as tfidf from wts")
def stream_weights_incremental(spark: SparkSession, d: str) -> DataFrame:
    from weftline.streaming.incremental import maintain_index

    return maintain_index(stream_table(spark, d, "crawl"), scratch(spark, "index"))[2].select("word", "url", F.round("tfidf", 6).alias("tfidf"))


@query(rf"""with h as (select lower(host) as host, case when crawl_delay >= 0 then ceil(crawl_delay * 1000)::bigint end as ms from hosts), f as (select {_HOST} as host, epoch_us(queued_at) // 1000 as ts from frontier where queued_at is not null and url is not null),
k as (select f.host, ts, coalesce(ms, 1000) as ms, row_number() over (partition by f.host order by ts) as k from f left join h on h.host = f.host where f.host <> ''),
g as (select host, ts, k * ms + max(ts - k * ms) over (partition by host order by k rows unbounded preceding) as granted from k)
select host, count(*) as requests, sum((granted > ts)::bigint)::bigint as waited, max(granted)::bigint as last from g group by 1""")
def host_throttle(spark: SparkSession, d: str) -> DataFrame:
    """When the delays of hosts let the requests of the frontier through; what waits is let through later."""
    from weftline.streaming.incremental import throttle

    delays = _t(spark, d, "hosts").select(F.lower("host").alias("host"), F.col("crawl_delay").alias("delay"))
    f = stream_table(spark, d, "frontier").select(U.url_host(F.col("url")).alias("host"), F.col("queued_at").alias("ts")).where("host <> '' and ts is not null")
    return throttle(f.join(delays, "host", "left"), scratch(spark, "throttle"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Ranked search over the stored index, weights and page metadata."""
    return search_ranked(spark, d)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)



