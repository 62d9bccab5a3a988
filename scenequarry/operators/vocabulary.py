"""Answer vocabularies per question type and the prior predictor built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenequarry.functions import answers as A


def distinct_answers(items: DataFrame) -> DataFrame:
    return items.select("qtype", F.col("answer").cast("string").alias("answer")).distinct()


def build_answer_spaces(items: DataFrame) -> DataFrame:
    """(qtype, kind, options, forms) over the whole split, never over a sample of it.

    A type whose answers are all digits is numeric; one with few distinct normalised answers is closed, with its
    options in display order; the rest is open. Only closed vocabularies are ever gathered into an array, and of the spellings of one
    normalised answer only the first in that order, so no array is longer than MAX_CLOSED_OPTIONS.
    """
    answers = distinct_answers(items).withColumn("norm", A.normalize(F.col("answer")))
    kinds = (
        answers.groupBy("qtype", "norm")
        .agg(F.count(F.lit(1)).alias("spellings"))
        .groupBy("qtype")
        .agg(F.bool_and(A.is_digits(F.col("norm"))).alias("all_digits"), F.count(F.lit(1)).alias("n_norm"))
        .select(
            "qtype",
            F.when(F.col("all_digits"), "numeric")
            .when(F.col("n_norm") <= A.MAX_CLOSED_OPTIONS, "closed")
            .otherwise("open")
            .alias("kind"),
        )
    )
    options = (
        answers.groupBy("qtype", "norm")
        .agg(F.min(A.option_order(F.col("answer"))).alias("option"))
        .join(kinds.where(F.col("kind") == "closed"), "qtype")
        .groupBy("qtype")
        .agg(F.array_sort(F.collect_list("option")).alias("ordered"))
        .select("qtype", F.transform("ordered", lambda o: o["code"]).alias("options"))
    )
    empty = F.array().cast("array<string>")
    spaces = kinds.join(options, "qtype", "left").withColumn("options", F.coalesce("options", empty))
    return spaces.withColumn("forms", A.option_forms(F.col("options")))


def prior_answers(items: DataFrame) -> DataFrame:
    """(qtype, prior): the most common answer of each type over the whole split, first seen on ties."""
    return (
        items.groupBy("qtype", "answer")
        .agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
        .groupBy("qtype")
        .agg(F.min_by("answer", F.struct((-F.col("n")).alias("n"), "first_pos")).alias("prior"))
    )
