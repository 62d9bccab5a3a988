"""Upload and report folders as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_uploads(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Files under ``path/<request_id>/<idx>_<name>`` with their size and bytes; prune ``content`` when it is not needed.

    With ``max_bytes`` larger files have null ``content``: the scan knows their length and does not open them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.regexp_extract
    where = r"/([^/]+)/(\d+)_([^/]+)$"

    def named(found: DataFrame, content: Column) -> DataFrame:
        return found.select(
            parts("path", where, 1).alias("request_id"),
            parts("path", where, 2).cast("int").alias("idx"),
            parts("path", where, 3).alias("file_name"),
            F.col("length").alias("bytes"),
            content.alias("content"),
        )

    if max_bytes is None:
        return named(files, F.col("content"))
    small, large = files.where(F.col("length") <= max_bytes), files.where(F.col("length") > max_bytes)
    return named(small, F.col("content")).unionByName(named(large, F.lit(None).cast("binary")))


def read_session_files(spark: SparkSession, root: str) -> DataFrame:
    """(session, path, mtime) of every file under ``root/<session>/``; the scan reads no file contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("/")[-1]
    return files.select(
        F.regexp_extract("path", rf"/{base}/([^/]+)/", 1).alias("session"),
        "path",
        F.col("modificationTime").cast("double").alias("mtime"),
    )
