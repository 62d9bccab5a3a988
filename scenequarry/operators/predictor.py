"""Hooks for a caller's models, called with batches: a predictor over prompted items and a captioner over crops."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPLY_FIELDS = "reply string, confidence double, error string, latency_s double"
BATCH = 64               # rows handed to a model at once


def _answers(model: Callable, rows: list) -> list[tuple]:
    """(answer, error) per row of one call of the model; where the call fails, each row is tried alone."""
    if not rows:
        return []
    try:
        answers = list(model(rows))
        if len(answers) != len(rows):
            raise ValueError(f"{len(answers)} answers for {len(rows)} rows")
        return [(a, None) for a in answers]
    except Exception as err:
        if len(rows) == 1:
            return [(None, f"{type(err).__name__}: {err}")]
        return [pair for row in rows for pair in _answers(model, [row])]


def run_predictor(prompted: DataFrame, predictor: Callable[[list[dict]], list[tuple[str, float | None]]], size: int = BATCH) -> DataFrame:
    """Adds reply, confidence, error and latency_s to prompted items; an exception becomes the error of the item that raises it.

    ``predictor(items)`` gets up to ``size`` items with their ``prompt`` and returns a (reply, confidence) for each, inside the
    executors' Python workers. Rows with an ``error`` already set (a missing image) are passed through unasked. The latency is the
    batch's divided by its rows. Repartition by image first when the predictor caches.
    """
    source = prompted if "error" in prompted.columns else prompted.withColumn("error", F.lit(None).cast("string"))
    kept = [f for f in source.schema.fields if f.name != "error"]
    schema = T.StructType(kept + list(T.StructType.fromDDL(REPLY_FIELDS).fields))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for batch in (frame.iloc[i : i + size] for i in range(0, len(frame), size)):
                asked = ~batch["error"].map(lambda e: isinstance(e, str))
                start = time.perf_counter()
                found = _answers(predictor, batch[asked].drop(columns="error").to_dict("records"))
                each = round((time.perf_counter() - start) / max(1, len(found)), 3)
                rows = [(*(answer or (None, None)), error, each) for answer, error in found]
                told = [(None, None, error, 0.0) for error in batch.loc[~asked, "error"]]
                index = [*batch.index[asked], *batch.index[~asked]]
                answered = pd.DataFrame(rows + told, columns=["reply", "confidence", "error", "latency_s"], index=index).astype({"confidence": float})
                yield pd.concat([batch.drop(columns="error"), answered], axis=1)[[f.name for f in schema.fields]]

    return source.mapInPandas(run, schema)


def run_captioner(crops: DataFrame, captioner: Callable[[list[dict]], list[str]], size: int = BATCH) -> DataFrame:
    """Adds ``caption`` to crops, ``size`` at a call; a crop that fails gets empty text, so a report is never lost to a caption."""
    schema = T.StructType([*crops.schema.fields, T.StructField("caption", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for batch in (frame.iloc[i : i + size] for i in range(0, len(frame), size)):
                found = _answers(captioner, batch.to_dict("records"))
                yield batch.assign(caption=[" ".join((text or "").split()) for text, _ in found])

    return crops.mapInPandas(run, schema)
