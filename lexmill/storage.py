"""Intermediate tables in a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _located(spark: SparkSession, path: str):
    """(path, file system) of the session's JVM, which reads whatever store Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    path, files = _located(spark, path)
    return files.exists(path)


def listed(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, length, time of change) of a folder's entries or of a file; empty if there is none."""
    path, files = _located(spark, path)
    return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in files.listStatus(path)) if files.exists(path) else []


def delete(spark: SparkSession, path: str) -> None:
    path, files = _located(spark, path)
    files.delete(path, True)


def claim(spark: SparkSession, path: str, content: str) -> bool:
    """Create a small file with a text; false if it is there already, so of many writers one gets it."""
    if exists(spark, path):
        return False
    where, files = _located(spark, path)
    try:
        out = files.create(where, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception) or "already exists" in str(error.java_exception):
            return False
        raise
    out.write(bytearray(content.encode()))
    out.close()
    return True


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a session in local mode gets one of its own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = Path(tempfile.mkdtemp(prefix="lexmill-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lexmill"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``staged`` wrote and nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df.staged_path)
