from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from weftline.operators import kv
from weftline.operators.dataset import Dataset, PairDataset, append_capped, default_join, page_of
from weftline.operators.ranking import number_rows, rank_by_score
from weftline.operators.salted import heavy_keys, salted_counts


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_join_is_a_bag(spark):
    left = PairDataset(spark.createDataFrame([("k", "a"), ("k", "b")], "key string, value string"))
    right = PairDataset(spark.createDataFrame([("k", "x"), ("k", "y"), ("z", "q")], "key string, value string"))
    assert sorted(left.join(right).collect()) == [("k", "a,x"), ("k", "a,y"), ("k", "b,x"), ("k", "b,y")]


def test_filter_fold_distinct(spark):
    d = Dataset.parallelize(spark, ["a", "a", "b"])
    assert d.filter(lambda v: F.lit(True)).count() == 3 and d.filter(lambda v: F.lit(True), distinct=True).count() == 2
    assert d.distinct().count() == d.distinct().distinct().count() == 2
    assert Dataset(spark.createDataFrame([(1,), (2,), (3,)], "value int")).fold(F.sum).first()[0] == 6
    assert sorted(d.intersection(Dataset.parallelize(spark, ["a", "c"])).collect()) == ["a"]
    assert d.flat_map(lambda v: F.array(v, F.lit(None))).count() == 3
    assert len(d.take(2)) == 2 and d.sample(1.0).count() == 3
    pairs = d.map_to_pair(lambda v: v, lambda v: F.lit(1)).fold_by_key(F.sum)
    assert sorted(pairs.collect()) == [("a", 2), ("b", 1)]
    assert d.group_by(lambda v: F.when(v == "a", v)).count() == 2


def test_append_capped(spark):
    df = spark.createDataFrame([("k", i % 7, i) for i in range(30)] + [("z", 1, 0)], "k string, v int, o int")
    assert rows(append_capped(df, "k", "v", ["o"], 5)) == [("k", [0, 1, 2, 3, 4]), ("z", [1])]
    assert rows(append_capped(df, "k", "v", ["o"], 5, 3)) == [("k", 0, [0, 1, 2]), ("k", 1, [3, 4]), ("z", 0, [1])]


def test_pages_cover_everything(spark):
    df = spark.range(23)
    got = [r[0] for p in (1, 2, 3) for r in page_of(df, [F.col("id")], p).collect()]
    assert got == list(range(23)) and [r[0] for r in page_of(df, [F.col("id")], 99).collect()] == [20, 21, 22]
    assert page_of(df.limit(0), [F.col("id")], 1).count() == 0


def test_default_join(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 5)], "k int, n int")
    assert rows(default_join(a, b, "k", {"n": F.lit(0)})) == [(1, 5), (2, 0)]


def test_kv_table(spark, tmp_path):
    t = kv.KVTable(spark, f"{tmp_path}/t")
    assert t.count() == 0 and t.get("a", "x") is None and not t.exists()
    cells = lambda *c: spark.createDataFrame(c, "key string, col string, value string")
    v1 = t.put(cells(("a", "x", "1"), ("b", "x", "2")))
    t.put(cells(("a", "x", "3")))
    assert t.get("a", "x") == "3" and t.get("a", "x", version=v1) == "1" and t.exists_row("b") and t.count() == 2
    t.put_row("a", {"y": "9"})
    assert t.get("a", "x") is None and t.get("a", "y") == "9"
    t.delete_row("b")
    assert not t.exists_row("b") and t.count() == 1
    small = t.compact(f"{tmp_path}/c")
    assert rows(small.rows()) == rows(t.rows())
    moved = small.rename(f"{tmp_path}/m")
    assert moved.exists() and not small.exists()
    with pytest.raises(FileNotFoundError):
        small.rename(f"{tmp_path}/n")
    with pytest.raises(FileExistsError):
        moved.rename(f"{tmp_path}/t")
    moved.drop()
    assert not moved.exists()


def test_conditional_put(spark):
    now = spark.createDataFrame([("a", "c", "1"), ("a", "v", "old"), ("b", "c", "2")], "key string, col string, value string")
    puts = spark.createDataFrame([("a", "v", "new", "c", "1"), ("b", "v", "new", "c", "1"), ("z", "v", "new", "c", "1")], "key string, col string, value string, if_col string, equals string")
    assert rows(kv.conditional(now, puts)) == [("a", "OK", "new"), ("b", "FAIL", None), ("z", "FAIL", None)]


def test_salted_counts_against_brute_force(spark):
    random.seed(3)
    data = [("hot" if random.random() < 0.4 else f"w{random.randint(0, 40)}", f"u{random.randint(0, 60)}", random.choice([None, 1, 2, 5])) for _ in range(3000)]
    data += [(None, "u1", 1), ("solo", None, 3), ("hot", "u1", 7), ("hot", "u1", 7)]
    best, n = defaultdict(dict), Counter()
    for w, u, v in data:
        if w is not None:
            n[w] += 1
            if u is not None:
                best[w][u] = max(best[w].get(u, 0), v or 0)
    want = sorted((w, n[w], len(best[w]), sum(best[w].values())) for w in n)
    df = spark.createDataFrame(data, "k string, i string, v bigint").withColumn("_k", F.lit("clash")).withColumn("rows", F.lit(1))
    for share in (1e-4, 0.01, 0.2):
        assert rows(salted_counts(df, "k", "i", "v", share)) == sorted(want, key=repr)
    assert rows(salted_counts(df.limit(0), "k", "i", "v")) == []
    top = rows(heavy_keys(df.select("k"), "k", 0.2))
    assert top == [("hot", n["hot"], len(data))]


def test_rank_by_score_against_brute_force(spark):
    random.seed(4)
    data = [(random.randint(0, 3), random.choice([None, 0.0, 1e-9, 1e-9, 0.5, 3.0, 1e12, random.random()])) for _ in range(500)] + [(None, 1.0), (None, None)]
    got = rank_by_score(spark.createDataFrame(data, "q int, s double"), ["q"], "s", "r").collect()
    assert len(got) == len(data)
    for r in got:
        peers = [s for q, s in data if q == r["q"]]
        better = sum(s is not None and (r["s"] is None or s > r["s"]) for s in peers)
        assert r["r"] == better + 1


def test_number_rows(spark):
    df = spark.range(1000).select((F.col("id") % 3 == 0).alias("g"), "id")
    got = number_rows(df, ["g"], ["id"], "n", 16).collect()
    for g in (True, False):
        assert sorted(r["n"] for r in got if r["g"] is g) == list(range(sum(r["g"] is g for r in got)))
    assert number_rows(df.limit(0), ["g"], ["id"], "n").count() == 0


def test_save_as_table(spark):
    name = "saved_pairs_test"
    spark.sql(f"drop table if exists {name}")
    pairs = PairDataset(spark.createDataFrame([("k", "a"), ("k", "b")], "key string, value string"))
    pairs.save_as_table(name)
    assert rows(spark.table(name)) == [("k", "b")]
    with pytest.raises(Exception, match="already exists"):
        Dataset(spark.table(name)).save_as_table(name)
    spark.sql(f"drop table {name}")


def test_fetch(spark):
    from weftline.sources.fetch import fetch

    def web(url):
        if url == "boom":
            raise OSError(url)
        return {"a": (200, "Text/HTML; charset=utf-8", b"x" * 10), "b": (200, "image/png", b"y"), "c": (404, "text/html", b"z")}.get(url)

    df = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("boom",), (None,)], "url string")
    got = {r["url"]: (r["response_code"], bytes(r["page"]) if r["page"] else None, r["length"]) for r in fetch(df, web, 4).collect()}
    assert got == {"a": (200, b"xxxx", 10), "b": (200, None, 1), "c": (404, None, 1), "d": (None, None, None), "boom": (None, None, None)}


def test_pages_of_results_beyond_the_last(spark):
    from weftline.operators.dataset import page_of

    df = spark.range(23)
    got = lambda k: [r[0] for r in page_of(df, [F.col("id")], k, 10).collect()]
    assert got(1) == list(range(10)) and got(3) == [20, 21, 22] and got(9) == got(3) and got(-1) == got(1)
    assert page_of(df.limit(0), [F.col("id")], 2).count() == 0


def test_versions_need_no_read(spark, tmp_path):
    from weftline.operators.kv import KVTable

    t = KVTable(spark, f"{tmp_path}/t")
    versions = [t.next_version() for _ in range(100)]
    assert versions == sorted(set(versions))
    t.put_row("a", {"x": "1", "y": "2"})
    t.put_row("a", {"x": "3"})
    assert [tuple(r) for r in t.rows().collect()] == [("a", "x", "3")]


def test_job_output():
    from weftline.operators.dataset import JobOutput

    out = JobOutput()
    assert out.text() == "No output"
    out.output("a")
    out.output(None)
    out.output("b")
    assert out.text() == "ab"


def test_fetch_asks_for_the_head_first(spark):
    from weftline.sources.fetch import fetch

    heads = {"http://h/1": (200, "text/html; charset=x", "en-GB", None), "http://h/2": (301, None, None, "/1"), "http://h/3": (200, "text/html", "de", None), "http://h/4": (200, "image/png", None, None), "http://h/5": (404, "text/html", None, None)}
    urls = spark.createDataFrame([(u,) for u in [*heads, "http://h/6", None]], "url string")
    got = {r["url"]: r for r in fetch(urls, lambda u: (200, "text/html", b"x" * 9), 4, heads.get).collect()}
    assert bytes(got["http://h/1"]["page"]) == b"xxxx" and got["http://h/1"]["length"] == 9
    assert got["http://h/2"]["location"] == "http://h/1" and [u for u, r in got.items() if r["page"] is not None] == ["http://h/1"] and len(got) == 6


def test_ranks_of_scores_that_share_their_magnitude(spark):
    rnd = random.Random(6)
    data = [("q", 1.0 + rnd.randrange(400) * 1e-7) for _ in range(300)] + [("q", None), ("q", None), ("q", 0.0), (None, 2.0), (None, 3.0), ("r", 1e-300), ("r", 1e300)]
    got = rows(rank_by_score(spark.createDataFrame(data, "k string, s double"), ["k"], "s", "rank"))
    value = lambda s: -1.0 if s is None else s
    want = sorted(((k, s, 1 + sum(k2 == k and value(s2) > value(s) for k2, s2 in data)) for k, s in data), key=repr)
    assert got == want


def test_rows_without_an_item_are_spread(spark):
    df = spark.range(4000).repartition(4).selectExpr("'w' as word", "cast(null as string) as url", "1L as tf")
    assert [tuple(r) for r in salted_counts(df, "word", "url", "tf").collect()] == [("w", 4000, 0, 0)]
