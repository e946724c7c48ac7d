"""Reading the tables of a data folder: one Parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a folder, on whatever file system it names."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = 8) -> DataFrame:
    """The same table as a file stream; new files of the folder become new micro-batches, ``max_files`` at a time, or all
    there are if None."""
    path = table_path(sf_dir, name)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def table_names(spark: SparkSession, sf_dir: str) -> list[str]:
    """The tables that lie in a folder, by listing it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    found = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(p)
    return sorted(f.getPath().getName()[: -len(".parquet")] for f in found if f.getPath().getName().endswith(".parquet"))
