"""Shared-folder helpers: lineage cuts and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="panelspark-")
    sc.setCheckpointDir(own)
    return own


def application_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/panelspark/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the application's folder."""
    return f"{application_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def located(spark: SparkSession, path: str):
    """A path and its file system, whatever store that is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """The folders below ``path``; none if it does not exist."""
    at, fs = located(spark, path)
    return [str(x.getPath().toString()) for x in fs.listStatus(at) if x.isDirectory()] if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at, fs = located(spark, path)
    fs.delete(at, True)


def release(spark: SparkSession) -> None:
    """Remove the tables this application wrote; call it when no DataFrame reads them any more."""
    remove(spark, application_dir(spark))


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it from there.

    All later reads see the same rows, only the columns they need, and a lost executor does not
    recompute what came before.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(stored: DataFrame) -> None:
    """Remove a table that ``cut_lineage`` returned; call it when nothing reads it any more."""
    remove(stored.sparkSession, stored.stored_at)
