"""Reproducible stratified samples that keep each question type's share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenequarry.operators.ranking import bucket_offsets, hash_bucket, seeded_hash


def sample_quotas(items: DataFrame, limit: int) -> DataFrame:
    """(qtype, size, quota): ``max(1, half-even(limit * share))``, the excess taken back one at a time from the
    currently largest quota (never below one; the type seen first on ties).

    Taking units back from the largest quota is the same as dropping the highest-numbered units of all quotas
    in order, so the loop becomes a ranking of units.
    """
    sizes = items.groupBy("qtype").agg(F.count(F.lit(1)).alias("size"), F.min("pos").alias("first_pos"))
    total = items.agg(F.count(F.lit(1)).alias("total")).withColumn("_k", F.lit(0))
    raw = sizes.withColumn("_k", F.lit(0)).join(total, "_k").withColumn(
        "quota", F.greatest(F.lit(1), F.bround(F.lit(float(limit)) * F.col("size") / F.col("total")).cast("long"))
    )
    excess = raw.agg(F.greatest(F.sum("quota") - F.lit(limit), F.lit(0)).alias("excess")).withColumn("_k", F.lit(0))
    # Units above the water level: only the top ``excess + 1`` layers of a quota can be touched.
    units = raw.join(excess, "_k").where(F.col("quota") > 1).select(
        "qtype",
        "first_pos",
        "excess",
        F.explode(F.sequence(F.greatest(F.lit(2).cast("long"), F.col("quota") - F.col("excess")), F.col("quota"))).alias("unit"),
    )
    ranked = units.withColumn(
        "taken", F.row_number().over(Window.partitionBy("excess").orderBy(F.desc("unit"), "first_pos"))
    )
    lost = ranked.where(F.col("taken") <= F.col("excess")).groupBy("qtype").agg(F.count(F.lit(1)).alias("lost"))
    return raw.join(lost, "qtype", "left").select(
        "qtype", "size", (F.col("quota") - F.coalesce("lost", F.lit(0))).alias("quota")
    )


def stratified_sample(items: DataFrame, limit: int | None, seed: int = 0) -> DataFrame:
    """About ``limit`` items with every type's share kept; no limit, or one at least the table size, keeps all.

    Within a type the draw order is the seeded hash of the item id. Whole hash buckets below the quota are kept
    without ordering; only the rest is ranked, per (type, bucket).
    """
    if not limit:
        return items
    quotas = sample_quotas(items, limit).select("qtype", F.when(F.col("size") > 0, F.col("quota")).alias("quota"))
    total = items.agg(F.count(F.lit(1)).alias("total")).select((F.col("total") <= limit).alias("_all"), F.lit(0).alias("_k"))
    drawn = items.withColumn("_draw", seeded_hash(seed, F.col("item_id"))).withColumn("_b", hash_bucket(F.col("_draw")))
    offsets = (
        bucket_offsets(drawn.select("qtype", "_b"), ["qtype"], "_b")
        .join(quotas, "qtype")
        .withColumn("_k", F.lit(0))
        .join(total, "_k")
        .where((F.col("_before") < F.col("quota")) | F.col("_all"))
        .select("qtype", "_b", "_before", "quota", "_all")
    )
    within = Window.partitionBy("qtype", "_b").orderBy("_draw", "item_id")
    return (
        drawn.join(offsets, ["qtype", "_b"])
        .withColumn("_rn", F.col("_before") + F.row_number().over(within))
        .where((F.col("_rn") <= F.col("quota")) | F.col("_all"))
        .select(*items.columns)
    )
