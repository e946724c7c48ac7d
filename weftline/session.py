"""Session building and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "weftline", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ANSI mode stays on. Anything in ``conf`` wins (dots as ``__``)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Only where that is unset, as in
    local tests, a temporary folder is made and kept for the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if "local-cluster" in spark.sparkContext.master or not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/weftline/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Cuts the lineage of ``df``: writes it as a table in the shared folder, now, and reads that. It survives the loss
    of executors, is columnar, so that later steps read only the columns they need, and is as small as Parquet."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def remove(df: DataFrame | None) -> None:
    """Deletes the table behind a result of ``cut``, once all that reads it has been written; others are left alone."""
    path = getattr(df, "_cut_path", None)
    if path:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def scan_parts(df: DataFrame) -> int | None:
    """How many parts a plan of nothing but filters and projections over one scan of files has; null for any other plan.
    The scan is asked for its splits: nothing runs."""
    node = df._jdf.queryExecution().sparkPlan()
    while node.getClass().getSimpleName() in ("FilterExec", "ProjectExec"):
        node = node.child()
    return node.inputRDD().getNumPartitions() if node.getClass().getSimpleName() == "FileSourceScanExec" else None


def spread(df: DataFrame, by: str) -> DataFrame:
    """``df`` in as many parts as tasks can run at once, where a scan of few files has fewer, by the hash of a column: for
    maps that cost far more than a shuffle of their rows. Scans of many parts, and plans that shuffle anyway, stay as
    they are."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    parts = scan_parts(df)
    return df if parts is None or parts >= tasks else df.repartition(tasks, by)
