"""Report history: an append-only change log compacted to the newest row per session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scenequarry.operators.runs import latest_reports

REPORT_SCHEMA = "user_id bigint, session_id string, query string, task string, title string, created_at double"


def append_reports(changes: DataFrame, path: str) -> None:
    changes.write.mode("append").parquet(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return latest_reports(spark.read.schema(REPORT_SCHEMA).parquet(path))


def compact_reports(spark: SparkSession, path: str, compacted: str) -> DataFrame:
    """Write the current state beside the log and read it back."""
    read_reports(spark, path).write.mode("overwrite").parquet(compacted)
    return spark.read.schema(REPORT_SCHEMA).parquet(compacted)
