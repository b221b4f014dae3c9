"""Checkpoints and stored rows in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Where spark.checkpoint.dir says. Only a local session without that setting, as in tests, gets a temporary folder of its own."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def cut(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Checkpoints df: loops then don't grow their lineage, and a lost executor costs no rerun. tasks: into so many files at most."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return (df if tasks is None else df.coalesce(tasks)).checkpoint()


def forget(df: DataFrame) -> None:
    """Deletes the files of a checkpoint that nothing reads any more, as a loop's earlier rounds."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_folder(spark: SparkSession) -> str:
    """A folder for store(), deleted by discard() or with the session."""
    folder = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    path, files = _path(spark, folder)
    files.deleteOnExit(path)
    return folder


def store(df: DataFrame, folder: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Adds df to Parquet files and reads all of them: a fraction of a checkpoint's bytes, and df's shuffle files go as soon as it is written.

    folder: of new_folder(), where the caller needs it. by: columns with folders of their own; a filter on them reads those alone.
    """
    spark = df.sparkSession
    folder = folder or new_folder(spark)
    empty = [c for c, kind in df.dtypes if kind == "void"]  # a type that files don't have
    kept = df.drop(*empty)
    before = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        kept.write.mode("append").option("compression", "zstd").partitionBy(*by).parquet(folder)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    rows = spark.read.schema(kept.schema).parquet(folder)
    return rows.select(*[F.lit(None).alias(c) if c in empty else rows[c] for c in df.columns])


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes stored rows that nothing reads any more."""
    path, files = _path(spark, folder)
    files.delete(path, True)


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())
