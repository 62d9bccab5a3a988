"""Failed-login lockout: five failures within fifteen minutes of the first one refuse an account until the window ends.

The window starts at the first failure and does not slide; refused attempts are not counted; a success clears the
count; an expired window starts afresh.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from scenequarry.operators.ranking import bucketed_previous, bucketed_running_sum

# --- Fixed values: the lockout rule. ---
MAX_FAILURES = 5
WINDOW_SECONDS = 15 * 60
# --- End of fixed values. ---

VERDICTS = "account string, t double, seq bigint, verdict string, wait_s bigint"
DAY = 86400.0
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def judge(failures: int, first_at: float, t: float, ok: bool) -> tuple[str, int | None, int, float]:
    """One attempt against the count so far: (verdict, seconds to wait, failures, start of the window)."""
    remaining = first_at + WINDOW_SECONDS - t if failures else 0.0
    if remaining <= 0:
        failures, first_at = 0, 0.0
    elif failures >= MAX_FAILURES:
        return "refused", int(remaining) + 1, failures, first_at
    if ok:
        return "ok", None, 0, 0.0
    return "failed", None, failures + 1, first_at if failures else t


def lockout_verdicts(attempts: DataFrame) -> DataFrame:
    """Batch form over attempts(account, t seconds, ok, seq).

    A pause of a whole window always clears the state, so an account's history falls into independent stretches;
    these are spread over the cluster and each is folded as a sorted stream of rows with two numbers of state.
    """
    bucketed = attempts.select(
        F.col("account").cast("string").alias("account"), F.col("t").cast("double").alias("t"), "ok",
        F.col("seq").cast("long").alias("seq"), F.floor(F.col("t") / DAY).alias("_day"),
    )
    spaced = bucketed_previous(bucketed, ["account"], "_day", "t", "seq", "_prev")
    fresh = F.when(F.col("_prev").isNull() | (F.col("t") - F.col("_prev") >= WINDOW_SECONDS), 1).otherwise(0)
    stretched = bucketed_running_sum(spaced, ["account"], "_day", ["t", "seq"], {"stretch": fresh})
    spread = stretched.select("account", "stretch", "t", "ok", "seq").repartition("account", "stretch")
    ordered = spread.sortWithinPartitions("account", "stretch", "t", "seq")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, failures, first_at = None, 0, 0.0
        for batch in batches:
            verdicts, waits = [], []
            for row in batch.itertuples(index=False):
                if (row.account, row.stretch) != current:
                    current, failures, first_at = (row.account, row.stretch), 0, 0.0
                verdict, wait, failures, first_at = judge(failures, first_at, row.t, row.ok)
                verdicts.append(verdict)
                waits.append(wait)
            yield batch[["account", "t", "seq"]].assign(verdict=verdicts, wait_s=pd.array(waits, dtype="Int64"))

    return ordered.mapInPandas(fold, VERDICTS)


class LockoutProcessor(StatefulProcessor):
    """Per account with failures: their number, start of the window, the last attempt folded, and the timer that ends the window."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lockout", "failures int, first_at double, last_t double, timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return
        failures, first_at, last_t, timer = self.state.get() if self.state.exists() else (0, 0.0, float("-inf"), None)
        batch = pd.concat(list(rows)).sort_values(["t", "seq"])        # one trigger's rows of one account
        verdicts, waits = [], []
        for row in batch.itertuples(index=False):
            if row.t < last_t:
                verdict, wait = "late", None                          # already folded past it
            else:
                verdict, wait, failures, first_at = judge(failures, first_at, row.t, row.ok)
                last_t = row.t
            verdicts.append(verdict)
            waits.append(wait)
        ends = math.ceil((first_at + WINDOW_SECONDS) * 1000) if failures else None
        if timer is not None and timer != ends:
            self.handle.deleteTimer(timer)
        if ends is None:
            self.state.clear()                                        # nothing to remember of an account without failures
        else:
            if timer != ends:
                self.handle.registerTimer(ends)
            self.state.update((int(failures), float(first_at), float(last_t), ends))
        yield batch[["account", "t", "seq"]].assign(verdict=verdicts, wait_s=pd.array(waits, dtype="Int64"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def lockout_stream(attempts: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Stream form over the same columns; needs the RocksDB state store (``ROCKSDB``) in the session.

    ``t`` is event time: attempts may come up to ``delay`` out of order (older than one already judged: ``late``); Spark drops those
    older than the watermark. A window's timer fires when the watermark passes its end, so only accounts in an open window
    have state. Rows without an account are ticks of the clock: they move the watermark and have no verdict.
    """
    seconds = F.col("t").cast("double")
    shaped = attempts.select(
        F.col("account").cast("string").alias("account"), seconds.alias("t"), "ok", F.col("seq").cast("long").alias("seq"),
        F.timestamp_millis(F.floor(seconds * 1000).cast("long")).alias("at"),
    )
    # a filter would be pushed below the watermark, so ticks are the group without a key
    return shaped.withWatermark("at", delay).groupBy("account").transformWithStateInPandas(
        statefulProcessor=LockoutProcessor(), outputStructType=VERDICTS, outputMode="Append", timeMode="EventTime"
    )
