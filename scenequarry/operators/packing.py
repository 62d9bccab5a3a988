"""Training packs: several questions about one image in one conversation, and the loss mask over tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenequarry.functions import answers as A
from scenequarry.operators.joins import join_small
from scenequarry.operators.ranking import bucketed_row_number, hash_bucket, seeded_hash


def build_packs(items: DataFrame, spaces: DataFrame, per_pack: int = 8, seed: int = 0) -> DataFrame:
    """(image_key, pack_no, image_paths, turns, pack_order): every question exactly once, never across images.

    Questions of an image are ordered by a seeded hash and cut every ``per_pack``; ``pack_order`` shuffles packs.
    """
    prepared = (
        join_small(items, spaces.select("qtype", "kind", "options"), ["qtype"])
        .select(
            F.concat_ws("|", "image_paths").alias("image_key"),
            "image_paths",
            "item_id",
            A.benchmark_prompt(
                F.col("question"), F.col("kind"), F.col("options"), F.size("image_paths") == 2
            ).alias("prompt"),
            A.target_text(F.col("kind"), F.col("answer")).alias("target"),
        )
        .withColumn("_draw", seeded_hash(seed, F.col("item_id")))
        .withColumn("_b", hash_bucket(F.col("_draw")))
    )
    ranked = bucketed_row_number(prepared, ["image_key"], "_b", ["_draw", "item_id"], "_rn")
    packs = (
        ranked.withColumn("pack_no", F.floor((F.col("_rn") - 1) / per_pack))
        .groupBy("image_key", "pack_no")
        .agg(
            F.first("image_paths").alias("image_paths"),
            F.array_sort(F.collect_list(F.struct("_rn", "item_id", "prompt", "target"))).alias("turns"),
        )
    )
    turns = F.transform("turns", lambda t: F.struct(t["item_id"].alias("item_id"), t["prompt"].alias("prompt"), t["target"].alias("target")))
    return packs.withColumn("turns", turns).withColumn(
        "pack_order", seeded_hash(seed, F.col("image_key"), F.col("pack_no"))
    )


def pack_messages(packs: DataFrame) -> DataFrame:
    """(image_key, pack_no, position, role, n_images, text): image markers only in the first user message."""
    messages = F.flatten(
        F.transform(
            "turns",
            lambda t, i: F.array(
                F.struct(
                    F.lit("user").alias("role"),
                    F.when(i == 0, F.size("image_paths")).otherwise(0).alias("n_images"),
                    t["prompt"].alias("text"),
                ),
                F.struct(F.lit("assistant").alias("role"), F.lit(0).alias("n_images"), t["target"].alias("text")),
            ),
        )
    )
    return packs.select("image_key", "pack_no", F.posexplode(messages).alias("position", "m")).select(
        "image_key", "pack_no", "position", "m.*"
    )


def loss_mask(sequences: DataFrame, start: int, end: int, header: Sequence[int]) -> DataFrame:
    """(seq_id, pos, token, in_loss) from sequences(seq_id, tokens).

    A reply runs from just after ``start`` + ``header`` up to and including the next ``end``; a token is in the
    loss when the last reply start at or before it comes after the last end token before it.
    """
    tokens = sequences.select("seq_id", F.posexplode("tokens").alias("pos", "token"))
    order = Window.partitionBy("seq_id").orderBy("pos")
    opens = F.lag("token", len(header) + 1).over(order) == start
    for i, value in enumerate(header):
        opens = opens & (F.lag("token", len(header) - i).over(order) == value)
    marked = tokens.withColumn("_begin", F.when(opens, F.col("pos"))).withColumn(
        "_end", F.when(F.col("token") == end, F.col("pos"))
    )
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last_begin = F.max("_begin").over(upto)
    last_end = F.coalesce(F.max("_end").over(before), F.lit(-1))
    return marked.select(
        "seq_id", "pos", "token", F.coalesce(last_begin > last_end, F.lit(False)).alias("in_loss")
    )
