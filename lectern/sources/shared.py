"""Tables that a query writes and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where that is unset and everything runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), "lectern-shared")
    os.makedirs(path, exist_ok=True)
    return f"file://{path}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{folder(spark)}/lectern-core-{tag}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written once, and read as often as it is needed; the caller deletes it, or the folder's owner."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file, from the driver."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
