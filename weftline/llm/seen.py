"""Has this key been seen before? (problem 7): exact keyed state on disk with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.url import normalize_url
from weftline.session import scratch
from weftline.sources.tables import read_table, stream_table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings of the session that holds the state: on disk, changes written as a log, no count of rows, no empty batches.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: Bytes of the first files for each partition of the state, whose number stays what it is then.
BYTES_PER_PARTITION = 32 << 20
_ROWS, _ANSWERS, _MARKS = "key string, place bigint, turn int", "place bigint, key string, seen boolean, step int", "upto int, step int"


def state_session(spark: SparkSession, partitions: int) -> SparkSession:
    """A session of its own beside ``spark``, with its settings and those of the state; ``spark`` is left as it is."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if k.startswith("spark.sql.") and own.conf.isModifiable(k):
            own.conf.set(k, v)
    for k, v in {**STATE, "spark.sql.shuffle.partitions": str(partitions)}.items():
        own.conf.set(k, v)
    return own


def partitions_for(*tables: DataFrame) -> int:
    """How many partitions the state of keys from such tables gets: by their size, and a task for each core at least."""
    size = sum(int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in tables)
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-size // BYTES_PER_PARTITION))


def first_or_repeat(stream: DataFrame, path: str, partitions: int | None = None) -> DataFrame:
    """Runs a stream of (key, place) to its present end and returns (place, key, seen) of every row so far whose place is not
    negative: whether its key occurs with a smaller place, in the same micro-batch or any earlier one.

    State is a row for each key, its first place, in a RocksDB state store: on disk, partitioned by the key, checkpointed
    under ``path`` with every micro-batch; nothing ever expires, so answers are exact however long ago the first
    occurrence was, and memory is bounded by the store's cache. A micro-batch sends the smallest place of each of its
    keys to the store (map-side first, so that a key with a third of the rows is one row of each task), the store gives
    back the first place of these keys, and each row of the micro-batch is answered by it, once: no answer is looked
    at again. Rows of negative place (keys known from elsewhere) are remembered and not answered; null keys are never
    seen; rows with the same key and place are the same record.

    Run again with the same ``path``, the stream goes on where it stopped, with all keys it knows: it reads and answers
    new rows only. What a failed run left is done first. A row that comes after rows of larger place is answered by
    what has a smaller place; the answers that were given already stay. ``partitions`` of the state hold for good from
    the first run on (default: those of shuffles)."""
    spark = stream.sparkSession
    own = state_session(spark, partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))

    def keep(batch: DataFrame, turn: int) -> None:
        batch.select(F.col("key").cast("string").alias("key"), F.col("place").cast("bigint").alias("place")).write.mode("overwrite").parquet(f"{path}/rows/turn={turn}")

    def answer(touched: DataFrame, step: int) -> None:
        at = touched.sparkSession
        done = at.read.schema(_MARKS).parquet(f"{path}/marks").where(F.col("step") < step).agg(F.max("upto")).first()[0] if step else None
        upto = max(_turns(at, f"{path}/rows"))
        rows = at.read.schema(_ROWS).parquet(f"{path}/rows").where((F.col("turn") > (-1 if done is None else done)) & (F.col("turn") <= upto) & (F.col("place") >= 0))
        answered = rows.join(touched, "key", "left").select("place", "key", F.coalesce(F.col("first") < F.col("place"), F.lit(False)).alias("seen"))
        answered.write.mode("overwrite").parquet(f"{path}/answers/step={step}")
        at.createDataFrame([(upto,)], "upto int").write.mode("overwrite").parquet(f"{path}/marks/step={step}")

    def take() -> None:
        if _turns(spark, f"{path}/rows"):
            staged = own.readStream.schema(_ROWS).parquet(f"{path}/rows")
            firsts = staged.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("place").alias("first"))
            _drain(firsts.writeStream.outputMode("update"), f"{path}/keys", answer)

    take()
    _drain(stream.writeStream, f"{path}/stream", keep)
    take()
    found = spark.read.schema(_ANSWERS).parquet(f"{path}/answers") if _turns(spark, f"{path}/answers", "step=") else spark.createDataFrame([], _ANSWERS)
    return found.drop("step")


def _drain(writer, checkpoint: str, sink) -> None:
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def _turns(spark: SparkSession, path: str, prefix: str = "turn=") -> list[int]:
    """The numbers of the folders that are written completely under ``path``."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return [int(n[len(prefix) :]) for n in names if n.startswith(prefix) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]


def seen_before(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """(queue_id, url_key, seen): for each frontier row, in order of queue_id, whether its normalised url occurs in
    ``visited`` or in a frontier row before it. Null and empty urls have a null key and are never seen; repeated rows of
    ``visited`` change nothing.

    ``path`` is the folder of the state; with one that earlier calls used, only rows that are new since are read. By
    default a new one in the shared folder."""
    key = normalize_url(F.col("url")).alias("key")
    visited = stream_table(spark, sf_dir, "visited", None).select(key, F.lit(-1).cast("bigint").alias("place"))
    frontier = stream_table(spark, sf_dir, "frontier", None).select(key, F.col("queue_id").alias("place"))
    rows = visited.where(F.col("key").isNotNull()).unionByName(frontier)
    partitions = partitions_for(read_table(spark, sf_dir, "visited"), read_table(spark, sf_dir, "frontier"))
    answers = first_or_repeat(rows, path or scratch(spark, "seen"), partitions)
    return answers.select(F.col("place").alias("queue_id"), F.col("key").alias("url_key"), "seen")


def error_rate(answers: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rows, false_seen, false_new, rate): the answers held against an independent batch computation, which compares
    each row with the smallest place of its key found by a plain aggregation."""
    f = read_table(spark, sf_dir, "frontier").select("queue_id", normalize_url(F.col("url")).alias("k"))
    v = read_table(spark, sf_dir, "visited").select(normalize_url(F.col("url")).alias("k"), F.lit(-1).cast("bigint").alias("queue_id"))
    first = f.unionByName(v).where(F.col("k").isNotNull()).groupBy("k").agg(F.min("queue_id").alias("first"))
    truth = f.join(first, "k", "left").select("queue_id", F.coalesce(F.col("first") < F.col("queue_id"), F.lit(False)).alias("truth"))
    both = answers.join(truth, "queue_id")
    wrong = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return both.agg(
        F.count("*").alias("rows"),
        wrong(F.col("seen") & ~F.col("truth")).alias("false_seen"),
        wrong(~F.col("seen") & F.col("truth")).alias("false_new"),
        (wrong(F.col("seen") != F.col("truth")) / F.greatest(F.count("*"), F.lit(1))).alias("rate"),
    )
