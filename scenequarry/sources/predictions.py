"""Predictions log, run configuration and summary outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTION_SCHEMA = (
    "seq bigint, item_id string, qtype string, question string, answer string, reply string, predicted string, "
    "confidence double, correct boolean, error string, latency_s double"
)
RUN_IDENTITY = ("benchmark", "split", "limit", "seed", "predictor", "adapter")


def append_predictions(predictions: DataFrame, path: str) -> None:
    """Append to the log; files carry no order, so every record brings its own increasing ``seq``."""
    predictions.write.mode("append").json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The log with the last record per item; blank lines are skipped by the JSON reader."""
    return latest_predictions(spark.read.schema(PREDICTION_SCHEMA).json(path))


def latest_predictions(log: DataFrame) -> DataFrame:
    columns = [c for c in log.columns if c != "item_id"]
    last = log.groupBy("item_id").agg(F.max_by(F.struct(*columns), "seq").alias("r"))
    return last.select("item_id", "r.*")


def same_run(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Identity fields on which two one-row run configurations differ (nulls compare equal)."""
    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias(name)) for k in RUN_IDENTITY])
        return df.select("run_id", F.explode(pairs).alias("p")).select("run_id", "p.*")

    both = long(stored, "stored").join(long(wanted, "wanted"), ["run_id", "field"])
    return both.where(~F.col("stored").eqNullSafe(F.col("wanted")))


def guard_run(spark: SparkSession, path: str, config: dict) -> None:
    """Refuse to reuse a result folder for a different run; write the configuration when the folder is new."""
    fields = ", ".join(f"{k} string" for k in ("run_id", *RUN_IDENTITY))
    row = [("run", *[None if config.get(k) is None else str(config.get(k)) for k in RUN_IDENTITY])]
    wanted = spark.createDataFrame(row, fields)
    try:
        stored = spark.read.schema(fields).json(path)
        known = not stored.isEmpty()
    except Exception as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        known = False
    if not known:
        wanted.write.mode("overwrite").json(path)
        return
    different = [r["field"] for r in same_run(stored, wanted).collect()]      # at most one row per identity field
    if different:
        raise ValueError(f"{path} holds a different run (differs in {', '.join(sorted(different))})")


def write_summary(tables: dict[str, DataFrame], path: str) -> None:
    """One parquet and one JSON folder per result table of a run."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
        table.write.mode("overwrite").json(f"{path}/{name}.json")


def report_lines(report: DataFrame) -> DataFrame:
    """The flat per-type report as text rows."""
    pct = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    return report.select(
        "qtype",
        F.concat(
            F.lit("| "), F.col("qtype"), F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), pct("accuracy"),
            F.lit(" | "), pct("ci_low"), F.lit("-"), pct("ci_high"), F.lit(" | "), pct("floor"), F.lit(" |"),
        ).alias("line"),
    )
