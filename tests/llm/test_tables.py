"""Problems 1, 6, 7, 8, 9: operators over tables, against brute force and exact round trips."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.llm import distinctive, encode, fusion, pack, seen


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- 1


def test_fusion_against_brute_force(spark):
    random.seed(1)
    data = [(random.randint(0, 2), f"u{i}", random.choice([None, float("nan"), -1.0, 0.0, random.random() * 1e-6]), random.choice([None, 5.0, random.random() * 1e6])) for i in range(300)]
    df = spark.createDataFrame(data, "query_id int, url string, a double, b double").withColumn("fused", F.lit("clash"))
    got = fusion.fuse_rankings(df, ["query_id"], ["a", "b"]).collect()
    assert len(got) == 300

    def rank(q, s, at):
        ok = lambda x: x is not None and x >= 0
        return 1 + sum(ok(r[at]) and (not ok(s) or r[at] > s) for r in data if r[0] == q)

    for r in got:
        ra, rb = rank(r["query_id"], r["a"], 2), rank(r["query_id"], r["b"], 3)
        assert (r["rank_a"], r["rank_b"]) == (ra, rb) and r["fused"] == pytest.approx(1 / (60 + ra) + 1 / (60 + rb))
    assert fusion.fuse_rankings(df.limit(0), ["query_id"], ["a", "b"]).count() == 0


def test_candidates_take_the_latest_row_and_the_best_weight(spark):
    terms = spark.createDataFrame([(1, " Cat"), (2, None), (3, "none")], "query_id bigint, word string")
    tf = spark.createDataFrame([("cat", "u", 1.0), ("CAT ", "u", 2.0), ("cat", "v", float("nan")), (None, "w", 1.0), ("cat", None, 1.0)], "word string, url string, tfidf double")
    meta = spark.sql("select * from values ('u', timestamp'2025-01-01', 9.0D), ('u', timestamp'2025-01-02', -1.0D), ('u', null, 8.0D) t(url, ranked_at, pagerank)")
    assert rows(fusion.query_candidates(terms, tf, meta)) == [(1, "u", 2.0, None), (1, "v", None, None)]
    top = fusion.top_per_query(fusion.fuse_rankings(fusion.query_candidates(terms, tf, meta), ["query_id"], ["tfidf", "pagerank"]), 1)
    assert [r["url"] for r in top.collect()] == ["u"]


# ---- 6


def test_term_scores_against_brute_force(spark):
    random.seed(2)
    data = [(random.choice([None, "", "  ", " The", "the ", "x", "Y"] + [f"w{i}" for i in range(20)]), random.choice([None] + [f"u{i}" for i in range(15)]), random.choice([None, -2, 0, 1, 3, 9])) for _ in range(600)]
    best: dict = {}
    for w, u, t in data:
        w = (w or "").strip().lower()
        if w and u is not None:
            best[u, w] = max(best.get((u, w), 0), max(1, t or 1))
    n, df, length = len({u for u, _ in best}), Counter(w for _, w in best), Counter()
    for (u, _), t in best.items():
        length[u] += t
    want = {(u, w): t / length[u] * math.log((1 + n) / (1 + df[w])) for (u, w), t in best.items()}
    terms = distinctive.distinct_terms(spark.createDataFrame(data, "word string, url string, tf bigint").withColumn("score", F.lit("clash")))
    for share in (1e-4, 0.05):
        got = {(r["url"], r["word"]): r["score"] for r in distinctive.term_scores(terms, share=share).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    keys = spark.createDataFrame([("u1",), ("u1",), ("u2",), ("nowhere",), (None,)], "url string")
    top = {r["url"]: r["word"] for r in distinctive.most_distinctive(distinctive.term_scores(terms, only=keys), keys).collect()}
    assert top == {u: min((-s, w) for (x, w), s in want.items() if x == u)[1] for u in ("u1", "u2")}
    assert distinctive.term_scores(terms.limit(0)).count() == 0


# ---- 7


def _tables(spark, path, frontier, visited):
    spark.createDataFrame(frontier, "queue_id bigint, url string, depth int").coalesce(1).write.parquet(f"{path}/frontier.parquet")
    spark.createDataFrame(visited, "url string, visited_at string").coalesce(1).write.parquet(f"{path}/visited.parquet")
    return str(path)


def test_seen_before(spark, tmp_path):
    front = [(5, "http://h/a", 1), (1, "http://H:80/a#x", None), (2, None, 1), (3, "", 1), (4, " ", 1), (6, "http://h/v", 1), (7, "http://h/A", 1), (8, "http://h/b/../a", 0)]
    d = _tables(spark, tmp_path, front, [("HTTP://h/v", None), ("http://h/v", None), (None, None), ("", None)])
    got = {r["queue_id"]: r["seen"] for r in seen.seen_before(spark, d).collect()}
    assert got == {1: False, 2: False, 3: False, 4: False, 5: True, 6: True, 7: False, 8: True}
    assert seen.error_rate(seen.seen_before(spark, d), spark, d).first()["rate"] == 0.0


def test_seen_before_with_empty_tables(spark, tmp_path):
    d = _tables(spark, tmp_path, [], [])
    assert seen.seen_before(spark, d).count() == 0


def _keys(spark, src, out, new, per_batch=None):
    if new:
        spark.createDataFrame(new, "key string, place bigint").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("key string, place bigint")
    stream = stream.option("maxFilesPerTrigger", per_batch) if per_batch else stream
    return rows(seen.first_or_repeat(stream.parquet(src), out, 3))


def test_state_goes_on_where_it_stopped(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    first = [(2, "b", False), (5, "a", False), (6, "a", True)]
    assert _keys(spark, src, out, [("a", 5), ("b", 2), ("a", 6), ("v", -1), ("v", -1)]) == first
    assert _keys(spark, src, out, []) == first
    more = [(7, "v", True), (8, None, False), (9, "a", True), (10, "c", False), (10, "c", False), (11, "b", True)]
    assert _keys(spark, src, out, [("a", 9), ("c", 10), ("c", 10), ("b", 11), ("v", 7), (None, 8), (None, -1)]) == sorted(first + more, key=repr)
    early = _keys(spark, src, out, [("a", 1), ("z", 12)])  # comes late, but nothing has a smaller place
    assert (1, "a", False) in early and (12, "z", False) in early and len(early) == len(first + more) + 2
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    assert provider is None or "RocksDB" not in provider  # the caller's session is as it was


def test_seen_in_several_micro_batches_of_one_run(spark, tmp_path):
    rnd = random.Random(2)
    data = [(f"k{rnd.randrange(20)}", i) for i in range(60)]
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for i in range(0, 60, 20):
        spark.createDataFrame(data[i : i + 20], "key string, place bigint").coalesce(1).write.mode("append").parquet(src)
    known, want = set(), []
    for k, i in data:
        want.append((i, k, k in known))
        known.add(k)
    assert _keys(spark, src, out, [], per_batch=1) == sorted(want, key=repr)


def test_a_run_that_failed_is_answered_once(spark, tmp_path, monkeypatch):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    drain, calls = seen._drain, []

    def failing(writer, checkpoint, sink):
        calls.append(checkpoint)
        if checkpoint.endswith("/keys"):
            raise RuntimeError("executor lost")
        drain(writer, checkpoint, sink)

    monkeypatch.setattr(seen, "_drain", failing)
    with pytest.raises(RuntimeError):
        _keys(spark, src, out, [("a", 1), ("b", 2), ("a", 3)])
    monkeypatch.setattr(seen, "_drain", drain)
    assert _keys(spark, src, out, [("b", 4)]) == [(1, "a", False), (2, "b", False), (3, "a", True), (4, "b", True)]


def test_seen_before_reads_only_new_rows_with_the_same_path(spark, tmp_path):
    d = _tables(spark, tmp_path, [(1, "http://h/a", 1)], [("http://h/v", None)])
    state = f"{tmp_path}/state"
    assert rows(seen.seen_before(spark, d, state)) == [(1, "http://h/a", False)]
    new = spark.createDataFrame([(2, "http://H/a", 1), (3, "http://h/v#x", 1)], "queue_id bigint, url string, depth int")
    new.select(*[c for c in spark.read.parquet(f"{d}/frontier.parquet").columns if c in new.columns]).write.mode("append").parquet(f"{d}/frontier.parquet")
    assert rows(seen.seen_before(spark, d, state)) == [(1, "http://h/a", False), (2, "http://h/a", True), (3, "http://h/v", True)]


# ---- 8

_PARTS = ["a", "ha", "ab ", "  ", "é", "漢字", "'s", "'re", "12", "...", "\n", "Hello", " world", "🙂", "ll", "\t", "\u00a0", "<|endoftext|>", "\x1c", "_"]


def test_tree_concatenation_is_exact():
    enc = encode.encoding()
    random.seed(5)
    for _ in range(1500):
        parts = random.sample(_PARTS, random.choice([1, 2, 3, 20]))
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 120)))
        assert encode.encode_text(enc, text, random.choice([17, 25, 40, 64])) == enc.encode_ordinary(text), text
    for text in ("ha" * 30_000, " " * 20_000 + "x", "漢字" * 9_000, "1234567890" * 3_000):
        assert encode.encode_text(enc, text, 4_000) == enc.encode_ordinary(text)


def test_no_long_text_is_taken_whole():
    enc = encode.encoding()
    rnd = random.Random(8)
    for _ in range(300):
        text = " " * rnd.randrange(40_000) + "?!" * rnd.randrange(20_000) + "ab" * rnd.randrange(20_000) + rnd.choice(["", " x", "'s", "\n"])
        parts = encode.leaves(text, 4_000)
        assert all(len(t) <= 4_000 for t, _ in parts) and "".join(t for t, _ in parts) == text
    text = " " * 9_000 + "?!" * 5_000 + "ab" * 9_000
    assert encode.encode_text(enc, text, 4_000) == enc.encode_ordinary(text)


def test_windows_over_a_corpus(spark, monkeypatch):
    """Texts that no place parts, longer than a leaf with production parameters: their joins are encoded in windows."""
    rnd = random.Random(4)
    letters = "".join(rnd.choice("abcdefghijklmnop") for _ in range(40_000))
    texts = ["ha" * 20_000, letters, " " * 40_000 + "x", "漢字" * 12_000, "1234567890" * 4_000, "=" * 50_000, " " * 20_000 + "?!" * 12_000 + "ab" * 9_000, "word " * 9_000 + letters + " end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    enc, joins = encode.encoding(), []
    join = encode.join_ids
    monkeypatch.setattr(encode, "join_ids", lambda e, a, b: joins.append(1) or join(e, a, b))
    for t in texts:
        assert encode.encode_text(enc, t) == enc.encode_ordinary(t)
    assert len(joins) >= 2 * len(texts)  # in this process; the tasks below do the same
    got = {r["doc_id"]: r["ids"] for r in encode.encode_documents(df).collect()}
    assert all(got[i] == enc.encode_ordinary(t) for i, t in enumerate(texts))


def test_same_ids_as_the_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encode.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in ("<|endoftext|> it's 12 o'clock\n\n  ok", "naïve 漢字 🙂", " \u00a0\t x"):
        assert encode.encode_text(encode.encoding(), text, 16) == t.encode(text, add_special_tokens=False).ids


def test_encode_documents(spark):
    enc = encode.encoding()
    long = "word " * 40 + "x" * 300
    data = [(1, None), (2, ""), (3, " "), (4, long), (4, long), (5, "<|endoftext|>"), (None, "n"), (6, "y" * 500)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("ids", F.lit("clash")).withColumn("_seq", F.lit(1))
    got = encode.encode_documents(df, limit=64)
    assert sorted(((r["doc_id"], r["ids"]) for r in got.collect()), key=repr) == sorted(((i, enc.encode_ordinary(t) if t else []) for i, t in data), key=repr)
    assert {r["doc_id"]: r["tokens"] for r in encode.encode_documents(df, limit=64, out="tokens").where("doc_id = 6").collect()} == {6: len(enc.encode_ordinary("y" * 500))}
    assert encode.encode_documents(df.limit(0)).count() == 0


# ---- 9


@pytest.mark.parametrize("capacity", [1, 7, 64, 100, 333, 2048])
def test_plan_holds_every_item_once(capacity):
    random.seed(capacity)
    for _ in range(30):
        hist = Counter(random.randint(1, capacity) for _ in range(random.randint(0, 300)))
        got: Counter = Counter()
        for sizes, n in pack.plan_containers(hist, capacity):
            assert sum(sizes) <= capacity and n > 0
            for s in sizes:
                got[s] += n
        assert got == hist
    with pytest.raises(ValueError):
        pack.plan_containers({capacity + 1: 1}, capacity)


def test_plan_fills_well():
    random.seed(0)
    hist = Counter(min(2048, int(random.lognormvariate(5.5, 1))) or 1 for _ in range(20_000))
    plan = pack.plan_containers(hist, 2048)
    assert sum(s * c for s, c in hist.items()) / (2048 * sum(n for _, n in plan)) > 0.995


def test_pack(spark):
    random.seed(6)
    data = [(i, random.choice([None, 0, 5, 99, 100, 101, 250, random.randint(1, 300)])) for i in range(500)] + [(7, 60), (7, 60), (None, 30)]
    df = spark.createDataFrame(data, "doc_id bigint, tokens int").withColumn("size", F.lit("clash"))
    out = pack.pack(df, capacity=100, classes=20).collect()
    used, spans = Counter(), {}
    for r in out:
        if r["container_id"] is None:
            assert r["size"] == 0
            continue
        used[r["container_id"]] += r["size"]
        spans.setdefault(r["container_id"], []).append((r["offset"], r["offset"] + r["size"]))
    assert max(used.values()) <= 100 and all(a[1] <= b[0] for s in spans.values() for a, b in zip(sorted(s), sorted(s)[1:]))
    total = Counter()
    for i, t in data:
        total[i] += t or 0
    got = Counter()
    for r in out:
        got[r["doc_id"]] += r["size"]
    assert got == total
    cut = [r for r in out if r["piece"] > 0]
    assert all(r["start"] == 100 * r["piece"] for r in cut) and sum(r["size"] == 0 for r in out) == sum(not t for _, t in data)
    assert pack.fill_report(pack.pack(df, capacity=100), 100).first()["over"] == 0
    assert pack.pack(df.limit(0)).count() == 0
