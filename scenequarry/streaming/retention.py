"""The hourly retention sweep over a growing inventory of session files: every session has a timer and is reported once."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from scenequarry.operators.runs import SESSION_FOLDER

EXPIRED = "session string, newest double"


class SweepProcessor(StatefulProcessor):
    """Per live session: the time of its newest file and its timer."""

    def __init__(self, max_age_s: float):
        self.max_age_s = max_age_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "newest double, timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return iter(())
        newest, timer = self.state.get() if self.state.exists() else (float("-inf"), None)
        newest = max(newest, *(float(batch["mtime"].max()) for batch in rows))
        due = math.floor((newest + self.max_age_s) * 1000) + 1
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if timer != due:
            self.handle.registerTimer(due)
        self.state.update((newest, due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            newest, _ = self.state.get()
            self.state.clear()
            yield pd.DataFrame({"session": [key[0]], "newest": [newest]})

    def close(self) -> None:
        pass


def start_sweeps(
    inventory: DataFrame, max_age_hours: float, expire: Callable[[DataFrame], None], checkpoint: str, every: str | None = "1 hour", delay: str = "0 seconds",
) -> StreamingQuery:
    """Sweep on every trigger of a stream of inventory rows(session, path, mtime, listed); ``every`` None runs what is there.

    ``listed`` (seconds) is when the row was seen and the stream's clock: it may be up to ``delay`` out of order, while ``mtime`` may be of any age. Rows
    without a session only move the clock. ``expire`` receives the sessions (session, newest) whose newest file is older than the limit by
    that clock, each once; a session that gets files again starts anew. State is two numbers per live session and goes with it.
    Needs the RocksDB state store. A limit of 0 or less expires nothing.
    """
    timed = inventory.withColumn("at", F.timestamp_millis(F.floor(F.col("listed") * 1000).cast("long"))).withWatermark("at", delay)
    # a filter may be pushed below the watermark, so the rows that only move the clock are the group without a key
    known = F.col("session").rlike(SESSION_FOLDER) & F.lit(max_age_hours > 0) & F.col("mtime").isNotNull()
    sessions = timed.where(F.col("session").isNull() | known)
    expired = sessions.select("session", F.col("mtime").cast("double").alias("mtime"), "at").groupBy("session").transformWithStateInPandas(
        statefulProcessor=SweepProcessor(max_age_hours * 3600), outputStructType=EXPIRED, outputMode="Append", timeMode="EventTime"
    )
    writer = expired.writeStream.outputMode("append").foreachBatch(lambda batch, _: expire(batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
