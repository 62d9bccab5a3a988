"""Ranks, running totals and exact percentiles that never put a whole group into one task.

A plain window over a group sorts the group in a single task, which breaks as soon as one group holds a
large share of the table. Here a group is first cut into ordered buckets; only the small table of bucket
totals is windowed per group, and the rows are windowed per (group, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_DIGITS = 3          # 16^3 buckets per group for hash-ordered ranks
SKETCH_ACCURACY = 10_000 # a sketch's rank is off by one in so many rows at most
BRACKET = 0.001          # share of a group's rows between the sketch's values around a wanted rank


def seeded_hash(seed: int, *parts: Column) -> Column:
    """A reproducible draw order: md5 over the seed and the row's identity."""
    return F.md5(F.concat_ws("\u0001", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_bucket(digest: Column) -> Column:
    return F.substring(digest, 1, HASH_DIGITS)


def bucket_offsets(df: DataFrame, keys: Sequence[str], bucket: str, out: str = "_before") -> DataFrame:
    """(keys, bucket, rows in the bucket, rows of the group in earlier buckets)."""
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_bucket_rows"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum("_bucket_rows").over(earlier), F.lit(0)))


def bucketed_row_number(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence, out: str) -> DataFrame:
    """row_number over ``keys`` ordered by (bucket, order)."""
    keys = list(keys)
    offsets = bucket_offsets(df, keys, bucket).drop("_bucket_rows")
    within = Window.partitionBy(*keys, bucket).orderBy(*order)
    return (
        df.withColumn("_in_bucket", F.row_number().over(within))
        .join(offsets, [*keys, bucket])
        .withColumn(out, F.col("_before") + F.col("_in_bucket"))
        .drop("_before", "_in_bucket")
    )


def bucketed_running_sum(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence, sums: dict[str, Column]
) -> DataFrame:
    """Running sums (named expressions) over ``keys`` ordered by (bucket, order), inclusive of the row."""
    keys = list(keys)
    totals = df.groupBy(*keys, bucket).agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    earlier = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(bucket)
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, bucket, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = df.select("*", *[F.sum(e).over(within).alias(f"_w_{n}") for n, e in sums.items()])
    joined = ranked.join(offsets, [*keys, bucket])
    for name in sums:
        joined = joined.withColumn(name, F.col(f"_o_{name}") + F.col(f"_w_{name}")).drop(f"_o_{name}", f"_w_{name}")
    return joined


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, percents: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles per group: one row per ``keys`` with a column per named percent (0..1).

    A mergeable sketch brackets each wanted rank, the values below the bracket are only counted, and only those inside it are
    ordered: about ``BRACKET`` of the group, wherever its values lie. A bracket that misses its rank is widened to the group.
    """
    if not keys:
        alone = exact_percentiles(df.withColumn("_all", F.lit(0)), ["_all"], value, percents)
        return alone.drop("_all")
    keys = list(keys)
    values = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    names = list(percents)
    edges = [min(1.0, max(0.0, p + e)) for p in percents.values() for e in (-BRACKET / 2, BRACKET / 2)]
    spread = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
        F.percentile_approx("_v", [float(e) for e in edges], SKETCH_ACCURACY).alias("_edges"),
    )
    wanted = F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), ((F.col("_rows") - 1) * F.lit(p)).alias("at"), F.col("_edges")[2 * i].alias("from"), F.col("_edges")[2 * i + 1].alias("to"))
        for i, (n, p) in enumerate(percents.items())
    ]))
    brackets = spread.select(*keys, "_lo", "_hi", wanted.alias("_w")).select(*keys, "_lo", "_hi", "_w.*")
    counted = values.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    inside = F.col("_v").between(F.col("from"), F.col("to"))
    tallied = counted.join(brackets, keys).groupBy(*keys, "name", "at", "from", "to", "_lo", "_hi").agg(
        F.sum(F.when(F.col("_v") < F.col("from"), F.col("_n")).otherwise(0)).alias("_below"), F.sum(F.when(inside, F.col("_n")).otherwise(0)).alias("_inside")
    )
    holds = (F.col("_below") <= F.floor("at")) & (F.ceil("at") < F.col("_below") + F.col("_inside"))
    placed = tallied.select(
        *keys, "name", "at", F.when(holds, F.col("from")).otherwise(F.col("_lo")).alias("from"),
        F.when(holds, F.col("to")).otherwise(F.col("_hi")).alias("to"), F.when(holds, F.col("_below")).otherwise(0).alias("_below"),
    )
    running = Window.partitionBy(*keys, "name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.join(placed, keys).where(inside).withColumn("_last", F.col("_below") + F.sum("_n").over(running))

    def value_at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_last") - F.col("_n")) & (rank < F.col("_last")), F.col("_v")))

    found = ranked.groupBy(*keys, "name", "at").agg(value_at(F.floor("at")).alias("_a"), value_at(F.ceil("at")).alias("_b"))
    found = found.withColumn("_p", F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("at") - F.floor("at")))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("_p"))).alias(n) for n in names])


def bucketed_previous(df: DataFrame, keys: Sequence[str], bucket: str, order: str, tie: str, out: str) -> DataFrame:
    """The ``order`` value of the row before each row of its key; buckets follow ``order``."""
    keys = list(keys)
    tops = df.groupBy(*keys, bucket).agg(F.max(order).alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*keys, bucket, F.max("_top").over(earlier).alias("_carried"))
    within = Window.partitionBy(*keys, bucket).orderBy(order, tie)
    ranked = df.withColumn("_before", F.lag(order).over(within)).join(carried, [*keys, bucket])
    return ranked.withColumn(out, F.coalesce("_before", "_carried")).drop("_before", "_carried")
