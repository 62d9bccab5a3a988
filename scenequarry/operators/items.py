"""Benchmark items: the question / answer / image join, image availability and split leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_active(flag: Column) -> Column:
    """A missing flag counts as active."""
    return F.coalesce(flag, F.lit(True))


def first_answer_triplets(questions: DataFrame, answers: DataFrame, images: DataFrame) -> DataFrame:
    """Active questions with their first present active answer (list order) and their active image.

    questions(id, img_id, type, question, answers_ids, active[, pos]), answers(id, answer, active),
    images(id, file_name, active). Questions without either partner drop out.
    """
    live_questions = questions.where(is_active(F.col("active")))
    listed = live_questions.select(F.col("id").alias("q_id"), F.posexplode("answers_ids").alias("a_pos", "a_id"))
    live_answers = answers.where(is_active(F.col("active"))).select(F.col("id").alias("a_id"), "answer")
    chosen = (
        listed.join(live_answers, "a_id")
        .groupBy("q_id")
        .agg(F.min_by("answer", "a_pos").cast("string").alias("answer"))
    )
    live_images = images.where(is_active(F.col("active"))).select(F.col("id").alias("img_id"), "file_name")
    order = F.col("pos") if "pos" in questions.columns else F.col("id")
    return (
        live_questions.select(F.col("id").alias("q_id"), "img_id", "type", "question", order.alias("pos"))
        .join(chosen, "q_id")
        .join(live_images, "img_id")
    )


def _items(triplets: DataFrame, benchmark: str, paths: Column) -> DataFrame:
    return triplets.select(
        F.lit(benchmark).alias("benchmark"),
        F.col("q_id").cast("string").alias("item_id"),
        "question",
        "answer",
        F.coalesce("type", F.lit("unknown")).alias("qtype"),
        paths.alias("image_paths"),
        "pos",
    )


def assemble_single_items(triplets: DataFrame, benchmark: str, image_dir: str) -> DataFrame:
    """One-image layout: ``<image_dir>/<image id>.tif``."""
    return _items(triplets, benchmark, F.array(F.format_string(f"{image_dir}/%d.tif", "img_id")))


def assemble_pair_items(triplets: DataFrame, benchmark: str, image_root: str) -> DataFrame:
    """Before / after layout: the same file name under ``im1`` and ``im2``."""
    before, after = (F.concat_ws("/", F.lit(f"{image_root}/{side}"), "file_name") for side in ("im1", "im2"))
    return _items(triplets, benchmark, F.array(before, after))


def missing_images(items: DataFrame, inventory: DataFrame) -> DataFrame:
    """(item_id, error) for items whose images are not all in ``inventory(path)``: the first missing path is named."""
    wanted = items.select("item_id", F.posexplode("image_paths").alias("p_pos", "path"))
    return (
        wanted.join(inventory.select("path").distinct(), "path", "left_anti")
        .groupBy("item_id")
        .agg(F.concat(F.lit("FileNotFoundError: image not found: "), F.min_by("path", "p_pos")).alias("error"))
    )


def split_leakage(split_images: DataFrame) -> DataFrame:
    """Images used by more than one split, from (split, image)."""
    return (
        split_images.distinct()
        .groupBy("image")
        .agg(F.count(F.lit(1)).alias("n_splits"), F.array_join(F.array_sort(F.collect_list("split")), ",").alias("splits"))
        .where(F.col("n_splits") > 1)
    )


def distinct_images(items: DataFrame) -> DataFrame:
    return items.select(F.explode("image_paths").alias("path")).distinct()
