"""Scoring predictions and summarising runs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenequarry.functions import answers as A
from scenequarry.functions.measures import wilson_bounds
from scenequarry.operators.joins import join_small
from scenequarry.operators.ranking import bucketed_running_sum, exact_percentiles

# --- Fixed values: question types left out of the published protocol. ---
PAPER_EXCLUDED_TYPES = {"rsvqa-lr": ("area", "count"), "rsvqa-hr": ("area", "count")}
CALIBRATION_BINS = 10
PROGRESS_EVERY = 25
# --- End of fixed values. ---

OVERALL = "(all)"


def with_prompts(items: DataFrame, spaces: DataFrame) -> DataFrame:
    """Items with the text asked of the predictor."""
    prompt = A.benchmark_prompt(
        F.col("question"), F.col("kind"), F.col("options"), F.size("image_paths") == 2
    )
    return join_small(items, spaces.select("qtype", "kind", "options"), ["qtype"]).select(items["*"], prompt.alias("prompt"))


def score_replies(records: DataFrame, spaces: DataFrame) -> DataFrame:
    """Adds predicted and correct to records(qtype, answer, reply[, error]); a failed record is wrong, not dropped."""
    failed = F.col("error").isNotNull() if "error" in records.columns else F.lit(False)
    joined = join_small(records, spaces.select("qtype", "kind", "forms"), ["qtype"])
    predicted = F.when(~failed, A.canonical(F.col("kind"), F.col("forms"), F.col("reply")))
    return (
        joined.withColumn("predicted", predicted)
        .withColumn(
            "correct",
            ~failed & A.is_correct(F.col("kind"), F.col("predicted"), F.col("reply"), F.col("answer")),
        )
        .drop("kind", "forms")
    )


def unanswered(items: DataFrame, predictions: DataFrame) -> DataFrame:
    """Resume: items without a stored prediction."""
    return items.join(predictions.select("item_id"), "item_id", "left_anti")


def wanted_only(predictions: DataFrame, items: DataFrame) -> DataFrame:
    return predictions.join(items.select("item_id"), "item_id", "left_semi")


def accuracy_columns(n: Column, correct: Column) -> list[Column]:
    """n, correct, accuracy and the Wilson 95% interval as aggregate output columns."""
    low, high = wilson_bounds(correct, n)
    return [
        n.alias("n"),
        correct.alias("correct"),
        F.when(n > 0, correct / n).otherwise(0.0).alias("accuracy"),
        low.alias("ci_low"),
        high.alias("ci_high"),
    ]


def accuracy_summary(records: DataFrame) -> DataFrame:
    """Overall and per-type accuracy with interval and failure count, in one pass."""
    failed = F.col("error").isNotNull() if "error" in records.columns else F.lit(False)
    counted = records.select("qtype", "correct", failed.alias("failed")).rollup("qtype").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if("correct").alias("_k"),
        F.count_if("failed").alias("errors"),
        F.grouping("qtype").alias("_all"),
    )
    return counted.select(
        F.when(F.col("_all") == 1, F.lit(OVERALL)).otherwise(F.col("qtype")).alias("qtype"),
        *accuracy_columns(F.col("_n"), F.col("_k")),
        "errors",
    )


def average_over_types(summary: DataFrame, excluded: Iterable[str] = ()) -> DataFrame:
    """Mean of the per-type accuracies without ``excluded`` types, and which excluded types were present."""
    excluded = list(excluded)
    skip = F.col("qtype").isin(*excluded) if excluded else F.lit(False)
    return summary.where(F.col("qtype") != OVERALL).agg(
        F.coalesce(F.avg(F.when(~skip, F.col("accuracy"))), F.lit(0.0)).alias("average_over_types"),
        F.array_join(F.array_sort(F.collect_set(F.when(skip, F.col("qtype")))), ",").alias("excludes"),
    )


def excluded_types_present(records: DataFrame, excluded: DataFrame) -> DataFrame:
    """Excluded types that occur, as a set intersection."""
    return records.select("qtype").intersect(excluded.select("qtype"))


def calibration(records: DataFrame, bins: int = CALIBRATION_BINS) -> DataFrame:
    """One row (n, ece, mce, brier, mean_confidence); nulls when no row carries a confidence."""
    failed = F.col("error").isNotNull() if "error" in records.columns else F.lit(False)
    conf, hit = F.col("confidence"), F.col("correct").cast("double")
    binned = (
        records.where(~failed & conf.isNotNull())
        .groupBy(F.least(F.floor(conf * bins), F.lit(bins - 1)).alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("m"),
            F.sum(conf).alias("conf"),
            F.sum(hit).alias("hits"),
            F.sum((conf - hit) * (conf - hit)).alias("squares"),
        )
        .withColumn("gap", F.abs(F.col("conf") / F.col("m") - F.col("hits") / F.col("m")))
    )
    total = F.sum("m")
    return binned.agg(
        F.coalesce(total, F.lit(0)).alias("n"),
        F.try_divide(F.sum(F.col("gap") * F.col("m")), total).alias("ece"),
        F.max("gap").alias("mce"),
        F.try_divide(F.sum("squares"), total).alias("brier"),
        F.try_divide(F.sum("conf"), total).alias("mean_confidence"),
    )


def latency_summary(records: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean, median and maximum latency over records that ran."""
    ran = records.where(F.col("latency_s").isNotNull())
    if "error" in records.columns:
        ran = ran.where(F.col("error").isNull())
    keyed = ran.withColumn("_all", F.lit(0))
    group = list(keys) or ["_all"]
    plain = keyed.groupBy(*group).agg(F.avg("latency_s").alias("mean_s"), F.max("latency_s").alias("max_s"))
    middle = exact_percentiles(keyed, group, "latency_s", {"median_s": 0.5})
    return plain.join(middle, group).drop("_all")


def majority_floor(records: DataFrame) -> DataFrame:
    """The answer-prior floor: accuracy of always giving each type's most common answer (smallest text on ties)."""
    per_answer = records.groupBy("qtype", "answer").agg(F.count(F.lit(1)).alias("n"))
    per_type = per_answer.groupBy("qtype").agg(
        F.sum("n").alias("total"),
        F.max("n").alias("hits"),
        F.min_by("answer", F.struct((-F.col("n")).alias("n"), "answer")).alias("floor_answer"),
    )
    rolled = per_type.rollup("qtype").agg(
        F.sum("total").alias("_n"),
        F.sum("hits").alias("_k"),
        F.max("floor_answer").alias("floor_answer"),
        F.grouping("qtype").alias("_all"),
    )
    return rolled.select(
        F.when(F.col("_all") == 1, F.lit(OVERALL)).otherwise(F.col("qtype")).alias("qtype"),
        F.when(F.col("_all") == 0, F.col("floor_answer")).alias("floor_answer"),
        *accuracy_columns(F.col("_n"), F.col("_k")),
    )


def report_table(model: DataFrame, floor: DataFrame) -> DataFrame:
    """Per-type model metrics beside the floor; a type without a floor gets 0."""
    floors = floor.select("qtype", F.col("accuracy").alias("floor"))
    return model.join(floors, "qtype", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))


def paper_protocol(records: DataFrame, excluded: DataFrame) -> DataFrame:
    """The records left after dropping each benchmark's excluded types; excluded(benchmark, qtype)."""
    return records.join(excluded, ["benchmark", "qtype"], "left_anti")


def running_progress(
    predictions: DataFrame, total: int, every: int = PROGRESS_EVERY, bucket_rows: int = 1_000_000
) -> DataFrame:
    """Every ``every`` answers and at the end: answered so far, running accuracy, seconds per item, minutes left."""
    marked = predictions.select(
        "seq", F.col("correct").cast("long").alias("hit"), "latency_s", F.floor(F.col("seq") / bucket_rows).alias("_b")
    )
    running = bucketed_running_sum(
        marked, [], "_b", ["seq"], {"done": F.lit(1), "hits": F.col("hit"), "seconds": F.col("latency_s")}
    )
    per_item = F.col("seconds") / F.col("done")
    last = F.max("seq")
    end = predictions.agg(last.alias("seq")).withColumn("_end", F.lit(True))
    return (
        running.join(end, "seq", "left")
        .where((F.col("done") % every == 0) | F.col("_end"))
        .select(
            "seq",
            "done",
            (F.col("hits") / F.col("done")).alias("running_accuracy"),
            per_item.alias("seconds_per_item"),
            (per_item * (F.lit(total) - F.col("done")) / 60).alias("minutes_left"),
        )
    )
