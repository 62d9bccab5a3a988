"""Benchmark annotation files as DataFrames.

The published files are single JSON objects, which cannot be split: read them once, write parquet, and run every later
job from the parquet copy (``convert_to_parquet``). The layout "lines", a folder of JSON lines per list, is read in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenequarry.operators.items import assemble_pair_items, assemble_single_items, first_answer_triplets

# --- Fixed values: file layouts and default splits of the supported benchmarks. ---
QUESTION = "id bigint, img_id bigint, type string, question string, answers_ids array<bigint>, active boolean"
ANSWER = "id bigint, question_id bigint, answer string, active boolean"
IMAGE = "id bigint, file_name string, active boolean"
FLAT = "image_id string, question string, ground_truth string, question_id bigint, type string, dataset string"
DEFAULT_SPLITS = {"rsvqa-lr": "test", "rsvqa-hr": "test", "cdvqa": "Test", "vrsbench-vqa": None}
FLAT_FILE = "VRSBench_EVAL_vqa.json"
FLAT_IMAGES = "Images_val"
# --- End of fixed values. ---

LIST_SCHEMAS = {"questions": QUESTION, "answers": ANSWER, "images": IMAGE}


def read_list(spark: SparkSession, path: str, key: str, layout: str = "object") -> DataFrame:
    """Rows of the one list an annotation file holds under ``key``; another shape is an error naming the keys found.

    With the layout "lines" the path (without .json) holds one record per line, and positions only keep the order of reading.
    """
    if layout == "lines":
        rows = spark.read.schema(LIST_SCHEMAS[key]).json(path.removesuffix(".json"))
        return rows.select(F.monotonically_increasing_id().alias("pos"), "*")
    entry = ", ".join(": ".join(field.split(" ", 1)) for field in LIST_SCHEMAS[key].split(", "))
    whole = spark.read.schema(f"{key} array<struct<{entry}>>").json(path, multiLine=True)
    if whole.where(F.col(key).isNotNull()).isEmpty():
        text = spark.read.text(path, wholetext=True)
        found = text.select(F.explode_outer(F.json_object_keys("value")).alias("k")).where("k is not null")
        names = sorted(r["k"] for r in found.collect())
        raise ValueError(f"{path}: expected a '{key}' list, found keys {names}")
    return whole.select(F.posexplode(key).alias("pos", "entry")).select("pos", "entry.*")


def read_three_files(spark: SparkSession, base: str, layout: str = "object") -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(read_list(spark, f"{base}_{key}.json", key, layout) for key in ("questions", "answers", "images"))


def read_flat_items(spark: SparkSession, path: str, image_dir: str, benchmark: str = "vrsbench-vqa", layout: str = "object") -> DataFrame:
    """Items of a plain-list annotation file."""
    rows = spark.read.schema(FLAT).json(path.removesuffix(".json") if layout == "lines" else path, multiLine=layout != "lines")
    return rows.select(
        F.lit(benchmark).alias("benchmark"),
        F.col("question_id").cast("string").alias("item_id"),
        "question",
        F.col("ground_truth").alias("answer"),
        F.coalesce("type", F.lit("unknown")).alias("qtype"),
        F.array(F.concat_ws("/", F.lit(image_dir), "image_id")).alias("image_paths"),
        F.monotonically_increasing_id().alias("pos"),
    )


def load_benchmark(
    spark: SparkSession, name: str, root: str, split: str | None = None, image_dir: str | None = None, layout: str = "object"
) -> DataFrame:
    """Items of a benchmark by name; an unknown name is an error."""
    if name not in DEFAULT_SPLITS:
        raise ValueError(f"Unknown benchmark {name!r}; choose from {', '.join(DEFAULT_SPLITS)}")
    split = split or DEFAULT_SPLITS[name]
    if name == "vrsbench-vqa":
        return read_flat_items(spark, f"{root}/{FLAT_FILE}", image_dir or f"{root}/{FLAT_IMAGES}", name, layout)
    if name == "cdvqa":
        parts = read_three_files(spark, f"{root}/{split}", layout)
        return assemble_pair_items(first_answer_triplets(*parts), name, image_dir or f"{root}/images/{split}")
    prefix = name.split("-")[1].upper()
    parts = read_three_files(spark, f"{root}/{prefix}_split_{split}", layout)
    return assemble_single_items(first_answer_triplets(*parts), name, image_dir or f"{root}/Images_{prefix}")


def convert_to_parquet(items: DataFrame, path: str) -> DataFrame:
    """Write items once in a splittable form and read them back."""
    items.write.mode("overwrite").parquet(path)
    return items.sparkSession.read.parquet(path)
