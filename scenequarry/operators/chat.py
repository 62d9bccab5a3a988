"""Conversation windows, clarification gates and question routing over tables of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenequarry.functions import language as L
from scenequarry.functions.answers import strip


def model_history(turns: DataFrame, prompts: DataFrame, max_turns: int = L.HISTORY_TURNS) -> DataFrame:
    """The last ``max_turns`` usable turns per conversation, clipped.

    turns(conv_id, turn, role, text[, scope]); prompts(conv_id, prompt). Two-image turns, other roles, pseudo-turns
    and blanks are dropped, and so is a trailing user turn that repeats the current prompt. One turn more than
    needed is ranked, so the limit is applied before the shuffle however long a conversation is.
    """
    role = F.when(F.col("role").isin("ai", "assistant"), "assistant").when(F.col("role") == "user", "user")
    usable = turns.withColumn("role", role).where(
        F.col("role").isNotNull()
        & (strip(F.col("text")) != "")
        & ~strip(F.col("text")).startswith(L.PSEUDO_TURN)
    )
    if "scope" in turns.columns:
        usable = usable.where(~F.col("scope").eqNullSafe(F.lit("pair")))
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    ranked = usable.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= max_turns + 1)
    current = (F.col("_rn") == 1) & (F.col("role") == "user") & (strip(F.col("text")) == strip(F.col("prompt")))
    flagged = ranked.join(prompts, "conv_id", "left").withColumn("_current", F.coalesce(current, F.lit(False)))
    dropped = F.max(F.col("_current").cast("int")).over(Window.partitionBy("conv_id"))
    return (
        flagged.withColumn("_dropped", dropped)
        .where(~F.col("_current") & (F.col("_rn") - F.col("_dropped") <= max_turns))
        .select("conv_id", "turn", "role", L.compress_turn(F.col("role"), F.col("text")).alias("content"))
    )


def clarification_gate(turns: DataFrame) -> DataFrame:
    """(conv_id, reason) for conversations whose opening question is empty or vague."""
    opening = turns.where(F.col("role") == "user").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return opening.select("conv_id", L.vague_opening(F.col("text")).alias("reason")).where("reason IS NOT NULL")


def route_counts(questions: DataFrame) -> DataFrame:
    routed = questions.select(
        L.question_route(F.col("question")).alias("route"),
        L.adapter_route(F.col("question")).isNotNull().alias("to_adapter"),
    )
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.count_if("to_adapter").alias("to_adapter"))
