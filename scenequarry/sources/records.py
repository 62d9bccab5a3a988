"""Run records: one JSON document per analysed request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE = (
    "struct<pipeline_id: string, task: string, routing: string, routing_reason: string, "
    "nodes_traversed: array<string>, telemetry: string, warnings: array<string>, "
    "validation_status: string, execution_status: string>"
)
RECORD_SCHEMA = (
    f"query string, answer string, agent_execution_trace {TRACE}, "
    "chat_history array<struct<role: string, content: string>>, scan string, _corrupt_record string"
)


def read_run_records(spark: SparkSession, path: str) -> DataFrame:
    """Records with a declared schema; unreadable ones keep their text in ``_corrupt_record``."""
    return spark.read.schema(RECORD_SCHEMA).json(path)


def parse_run_records(texts: DataFrame, column: str) -> DataFrame:
    """The same from a text column."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return texts.withColumn("record", F.from_json(column, RECORD_SCHEMA, options)).select(
        *[c for c in texts.columns if c != column], "record.*"
    )


def write_run_records(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)
