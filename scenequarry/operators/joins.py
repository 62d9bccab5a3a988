"""Joins of a large table with a small one, whose size is looked at before it is sent anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenequarry.session import cut_lineage

BROADCAST_ROWS = 10_000     # a small side of so many rows at most goes to every task
SALTS = 32


def join_small(large: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """``large`` joined with ``small`` (inner or left), so that no key of ``large`` decides the size of a task.

    The small side is written once and counted. Up to BROADCAST_ROWS rows it is broadcast and the large side is not shuffled;
    beyond, the large side's keys are salted and the small side is repeated per salt. The result is the same. That join is always a merge: Spark
    sizes rows that come from an explode by the table before it, and would send many times its broadcast limit to the driver.
    """
    on = list(on)
    stored = cut_lineage(small)
    if stored.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return large.join(F.broadcast(stored), on, how)
    salted = large.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    repeated = stored.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated.hint("merge"), [*on, "_salt"], how).drop("_salt")
