"""Ranked search, spelling, completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.stopwords import STOP_WORDS

PAGE_SIZE, SUGGESTIONS, MAX_DISTANCE = 10, 8, 2
#: So many tokens at most are sent to all tasks when words are looked for.
FEW_TOKENS = 1000


def words_of_query(query: str) -> list[str]:
    """The query's words, as ``query_terms`` gives them; a query is a parameter, not data."""
    import re

    return [w for w in re.split(r"\s+", query.lower()) if w and w not in STOP_WORDS]


def candidates(postings: DataFrame, words: list[str]) -> DataFrame:
    """(url): pages that have all different words. The word filter reaches the scan; the count has partial results."""
    need = sorted(set(words))
    hits = postings.where(F.col("word").isin(*need)).select("url", "word").distinct()
    return hits.groupBy("url").agg(F.count("*").alias("_n")).where(F.col("_n") == len(need)).select("url")


def score(pagerank: Column, tfidf: Column, title: Column, url: Column, snippet: Column, words: list[str], completion: Column, city: str | None = None) -> Column:
    """The score of a result: link rank, mean weight of the matched words, words in title and url, place, url length."""
    n = max(1, len(words))
    share = lambda c: sum((F.lower(c).contains(w).cast("int") for w in words), F.lit(0)) / F.lit(float(n))
    pr, tf = F.log1p(F.greatest(pagerank, F.lit(0.0))), F.greatest(tfidf, F.lit(0.0)) * completion
    near = F.lit(0.0)
    if city:
        near = (F.lower(title).contains(city.lower()) | F.lower(url).contains(city.lower()) | F.lower(snippet).contains(city.lower())).cast("double")
    long = F.when(F.length(url) <= 120, F.lit(1.0)).otherwise(1.0 / (1.0 + (F.length(url) - 120) / 60.0))
    return (0.45 * pr + 0.45 * tf + 0.07 * share(title) + 0.03 * share(url)) * (1.0 + 0.2 * near) * long


def search(postings: DataFrame, tfidf: DataFrame, meta: DataFrame, query: str, completion: Column | None = None, city: str | None = None) -> DataFrame:
    """(url, title, snippet, pagerank, tfidf, score) of all results: pages with all words of the query, of pages with
    the same title the best. No words, no rows. Missing metadata get defaults: rank 0.1, the url as title, "..." as
    snippet. ``meta`` has a row for each url at most, or a column ``ranked_at`` by which the latest one counts."""
    words = words_of_query(query)
    done = completion if completion is not None else F.lit(1.0)
    cand = candidates(postings, words) if words else postings.select("url").limit(0)
    mean = tfidf.where(F.col("word").isin(*sorted(set(words))) & (F.col("tfidf") > 0)) if words else tfidf.limit(0)
    mean = mean.groupBy("url").agg(F.avg("tfidf").alias("tfidf"))
    if "ranked_at" in meta.columns:  # candidates first, so that only their metadata are sorted
        meta = latest_meta(meta.join(cand, "url", "left_semi"))
    m = meta.select("url", F.col("title").alias("_t"), F.col("snippet").alias("_s"), F.col("pagerank").alias("_p"))
    full = cand.join(mean, "url", "left").join(m, "url", "left").select(
        "url",
        F.coalesce(F.nullif(F.trim("_t"), F.lit("")), F.col("url")).alias("title"),
        F.coalesce("_s", F.lit("...")).alias("snippet"),
        F.coalesce(F.when(F.isnan("_p"), None).otherwise(F.col("_p")), F.lit(0.1)).alias("pagerank"),
        F.coalesce("tfidf", F.lit(0.0)).alias("tfidf"),
    )
    scored = full.withColumn("score", score(F.col("pagerank"), F.col("tfidf"), F.col("title"), F.col("url"), F.col("snippet"), words, done, city))
    return best_per_title(scored)


def best_per_title(scored: DataFrame) -> DataFrame:
    """Of results with the same title, without regard to case and outer blanks, the best; blank titles never merge."""
    name = F.lower(F.trim("title"))
    key = F.when(F.coalesce(name, F.lit("")) == "", F.concat(F.lit("\u0000"), F.col("url"))).otherwise(name)
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "url")
    return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def result_page(results: DataFrame, page: int, size: int = PAGE_SIZE) -> DataFrame:
    from weftline.operators.dataset import page_of

    return page_of(results, [F.col("score").desc(), F.col("url")], page, size)


def latest_meta(page_meta: DataFrame) -> DataFrame:
    """Of each url the metadata that were written last."""
    w = Window.partitionBy("url").orderBy(F.col("ranked_at").desc_nulls_last(), F.col("pagerank").desc_nulls_last(), F.col("title").desc_nulls_last(), F.col("snippet").desc_nulls_last())
    return page_meta.where(F.col("url").isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def completion_ratio(done: DataFrame, total: int) -> Column:
    """Progress of a build, between 0 and 1; 1 where the total is unknown."""
    return F.lit(1.0) if total <= 0 else F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(max(0, done.count() - 1) / total)))


def dictionary(vocab: DataFrame) -> DataFrame:
    return vocab.select(F.lower(F.trim("word")).alias("word")).where(F.col("word") != "").distinct()


def complete(words: DataFrame, prefix: str, n: int = SUGGESTIONS) -> DataFrame:
    """The first ``n`` words with a prefix."""
    p = prefix.strip().lower()
    return words.where(F.col("word").startswith(p) if p else F.lit(False)).orderBy("word").limit(n)


def spell(words: DataFrame, tokens: DataFrame, few: int = FEW_TOKENS) -> DataFrame:
    """(token, suggestion): the token itself if it is a word, else the word of the least (distance, word) within two
    edits, else the token. Each task keeps its best word for each token (a partial minimum).

    Up to ``few`` tokens, which are counted first, are sent to the dictionary's parts; its words are pruned by length
    before the distance, which stops at its bound. More tokens meet words by what is left of both when up to two
    letters are deleted, which two words within two edits always have in common: an equality join of any size."""
    t = tokens.select("token").where(F.col("token").isNotNull()).distinct()
    if t.limit(few + 1).count() <= few:
        near = words.join(F.broadcast(t), (F.length("word") >= F.length("token") - MAX_DISTANCE) & (F.length("word") <= F.length("token") + MAX_DISTANCE))
    else:
        left = t.select("token", F.explode(deletions(F.col("token"))).alias("_rest"))
        near = left.join(words.select("word", F.explode(deletions(F.col("word"))).alias("_rest")), "_rest")
    near = near.withColumn("_d", F.levenshtein("word", "token", MAX_DISTANCE)).where(F.col("_d") >= 0)
    best = near.groupBy("token").agg(F.min(F.struct("_d", "word")).alias("b"))
    return tokens.join(best, "token", "left").select("token", F.coalesce("b.word", "token").alias("suggestion"))


def deletions(word: Column, most: int = MAX_DISTANCE) -> Column:
    """The different texts that are left of a word when at most ``most`` of its characters are deleted."""
    out = F.array(word)
    for _ in range(most):
        less = F.flatten(F.transform(out, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))))
        out = F.array_union(out, less)
    return out


def term_parts(tfidf: DataFrame, results: DataFrame, query: str, most: int = 5) -> DataFrame:
    """(url, pos, word, tf, idf, tfidf): for each result the words of the query that have a weight there, in the order of
    the query, ``most`` at most."""
    words = list(dict.fromkeys(words_of_query(query)))
    place = F.array_position(F.array(*map(F.lit, words)), F.col("word")) if words else F.lit(None)
    rows = tfidf.where(F.col("word").isin(*words) & (F.col("tfidf") > 0)).join(results.select("url"), "url", "left_semi")
    w = Window.partitionBy("url").orderBy("_p")
    ranked = rows.withColumn("_p", place).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most)
    return ranked.select("url", "pos", "word", "tf", "idf", "tfidf")


def store_index(postings: DataFrame, path: str, word: Column) -> None:
    """Writes postings (word, url, tf) with words in normal spelling, in ranges of words and sorted by them: a word filter
    then reads the row groups of its words only."""
    normal = postings.select(word.alias("word"), "url", "tf").where(F.col("word").isNotNull())
    normal.repartitionByRange("word", "url").sortWithinPartitions("word", "url").write.parquet(path)
