"""Upload inventory checks: kind from bytes, sizes, declared types, pair consistency and task routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values: magic bytes (hex), accepted types and limits. ---
PNG = "89504E470D0A1A0A"
JPEG = "FFD8FF"
TIFF = ("49492A00", "4D4D002A", "49492B00", "4D4D002B")
RIFF, WEBP = "52494646", "57454250"
DECLARED_TYPES = ("image/jpeg", "image/png", "image/webp", "image/tiff")
MODALITIES = ("optical", "sar")
ADAPTERS = ("agriculture", "deforestation", "general", "mining")
MAX_FILES = 2
MAX_UPLOAD_BYTES = 100 * 1024 * 1024
FORM_BYTES = 1024 * 1024
SINGLE, CHANGE, FUSION = "SINGLE_IMAGE_VQA", "CHANGE_DETECTION", "OPTICAL_SAR_FUSION"
# --- End of fixed values. ---


def image_kind(content: Column) -> Column:
    """png | jpeg | tiff | webp from the first bytes, null when unrecognised."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith(PNG), "png")
        .when(head.startswith(JPEG), "jpeg")
        .when(F.substring(head, 1, 8).isin(*TIFF), "tiff")
        .when(head.startswith(RIFF) & (F.substring(head, 17, 8) == WEBP), "webp")
    )


def inventory(uploads: DataFrame) -> DataFrame:
    """Everything later checks need, without carrying the bytes along.

    uploads(request_id, idx, file_name, declared_type, modality, content[, bytes]): a given size in ``bytes`` is taken as it is, so the length of
    a file that was not opened is known; null ``content`` has no kind.
    """
    size = F.col("bytes") if "bytes" in uploads.columns else F.length("content")
    return uploads.select(
        "request_id", "idx", "file_name", "declared_type", F.lower("modality").alias("modality"),
        image_kind(F.col("content")).alias("kind"), size.cast("long").alias("bytes"),
    )


def with_rejections(files: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Each file with its reject reason (first failing check), null when acceptable."""
    return files.withColumn(
        "reason",
        F.when(F.coalesce(F.col("file_name"), F.lit("")) == "", "no file name")
        .when(~F.coalesce(F.col("modality").isin(*MODALITIES), F.lit(False)), "invalid modality")
        .when(~F.coalesce(F.col("declared_type").isin(*DECLARED_TYPES), F.lit(False)), "unsupported type")
        .when(F.col("bytes") > max_bytes, "file too large")
        .when(F.col("kind").isNull(), "not an image"),
    )


def judge_requests(files: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """(request_id, n_images, total_bytes, reason): one verdict per request from judged files."""
    per_request = with_rejections(files, max_bytes).groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_images"),
        F.sum("bytes").alias("total_bytes"),
        F.count_if(F.col("kind") == "tiff").alias("tiffs"),
        F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("idx"))).alias("file_reason"),
    )
    return per_request.select(
        "request_id",
        "n_images",
        "total_bytes",
        F.when(F.col("total_bytes") > MAX_FILES * max_bytes + FORM_BYTES, "request too large")
        .when(F.col("n_images") > MAX_FILES, "too many images")
        .when(F.col("file_reason").isNotNull(), F.col("file_reason"))
        .when((F.col("n_images") == 2) & (F.col("tiffs") == 1), "mixed file kinds")
        .alias("reason"),
    )


def adapter_is_known(adapter: Column) -> Column:
    return F.coalesce(adapter.isin(*ADAPTERS), F.lit(False))


def route_tasks(files: DataFrame) -> DataFrame:
    """(request_id, task, reason) from the image count and the sensor types, in upload order."""
    counted = files.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("modality", "idx").alias("first"),
        F.max_by("modality", "idx").alias("second"),
    )
    pair = F.concat(F.lit(" sensor type"), F.when(F.col("first") != F.col("second"), "s").otherwise(""), F.lit(" ("), F.col("first"), F.lit(" + "), F.col("second"), F.lit(")"))
    return counted.where(F.col("n") <= MAX_FILES).select(
        "request_id",
        F.when(F.col("n") == 1, SINGLE).when(F.col("first") == F.col("second"), CHANGE).otherwise(FUSION).alias("task"),
        F.when(F.col("n") == 1, "1 image uploaded")
        .when(F.col("first") == F.col("second"), F.concat(F.lit("2 images of the same"), pair))
        .otherwise(F.concat(F.lit("2 images of different"), pair))
        .alias("reason"),
    )
