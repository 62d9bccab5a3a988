"""Incremental scoring: only new items are asked, every batch's results have their place, the checkpoint resumes the run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scenequarry.operators.items import missing_images
from scenequarry.operators.predictor import run_predictor
from scenequarry.operators.scoring import score_replies, unanswered, with_prompts
from scenequarry.session import cut_lineage
from scenequarry.sources.predictions import PREDICTION_SCHEMA, guard_run

COLUMNS = [field.split()[0] for field in PREDICTION_SCHEMA.split(", ")]


def score_new_items(
    items: DataFrame, spaces: DataFrame, predictor: Callable, log: DataFrame | None, inventory: DataFrame | None = None
) -> DataFrame:
    """Predictions for the items not in ``log`` yet, in the log's columns; with an image ``inventory(path)``, items
    whose images are missing become error records unasked."""
    todo = items.dropDuplicates(["item_id"])
    todo = unanswered(todo, log) if log is not None else todo
    asked = with_prompts(todo.withColumn("seq", F.col("pos")), spaces)
    if inventory is not None:
        asked = asked.join(missing_images(todo, inventory), "item_id", "left")
    return score_replies(run_predictor(asked, predictor), spaces).select(*COLUMNS)


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(PREDICTION_SCHEMA).json(path)
    except Exception as err:
        if "PATH_NOT_FOUND" in str(err):
            return None
        raise


def start_scoring(
    items: DataFrame, spaces: DataFrame, predictor: Callable, run_folder: str, config: dict,
    inventory: DataFrame | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Score a stream of items into ``run_folder/predictions``; a folder of another run is refused.

    The stream's state keeps the ids that were asked, so no log is read again, and a batch writes the folder of its number: one that is
    replayed after a failure replaces what it left. State and numbers live in the checkpoint, so predictions without theirs are refused.
    """
    spark = items.sparkSession
    guard_run(spark, f"{run_folder}/config", config)
    log_path, checkpoint = f"{run_folder}/predictions", f"{run_folder}/checkpoint"
    if read_log(spark, log_path) is not None and not _exists(spark, f"{checkpoint}/metadata"):
        raise ValueError(f"{run_folder} holds predictions but not the checkpoint they belong to")

    spaces = cut_lineage(spaces)        # read twice by every batch

    def put(batch: DataFrame, batch_id: int) -> None:
        score_new_items(batch, spaces, predictor, None, inventory).write.mode("overwrite").json(f"{log_path}/batch={batch_id}")

    writer = items.dropDuplicates(["item_id"]).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path).limit(1).collect()
        return True
    except Exception as err:
        if "PATH_NOT_FOUND" in str(err):
            return False
        raise
