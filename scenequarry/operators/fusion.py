"""Optical-radar fusion: radar brightness lightens or darkens the optical scene."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenequarry.functions.colour import with_value
from scenequarry.functions.measures import clamp
from scenequarry.operators.joins import join_small
from scenequarry.operators.ranking import exact_percentiles
from scenequarry.operators.rasters import bilateral_filter, gaussian_blur
from scenequarry.session import cut_lineage

# --- Fixed values: percentiles, smoothing and weight. ---
LOW, HIGH = 0.02, 0.98
BILATERAL_DIAMETER, BILATERAL_VALUE_SIGMA = 9, 40.0
DEFAULT_WEIGHT = 0.7
# --- End of fixed values. ---

PAIR = ["pair_id"]


def fusion_weight(weight: float | None) -> float:
    """How far radar may move the brightness: 0 keeps the optical scene, 1 is the full swing."""
    return DEFAULT_WEIGHT if weight is None else min(1.0, max(0.0, weight))


def to_eight_bit(pixels: DataFrame) -> DataFrame:
    """Optical scenes of another depth rescaled by their peak."""
    peaks = pixels.groupBy("scene_id").agg(F.max(F.greatest("r", "g", "b")).alias("_peak"))
    scale = F.when(F.col("_peak") > 0, F.col("_peak")).otherwise(1.0)
    scaled = {c: F.floor(F.col(c) / scale * 255).cast("int") for c in "rgb"}
    return join_small(pixels, peaks, ["scene_id"]).withColumns(scaled).drop("_peak")


def normalised_radar(joined: DataFrame) -> DataFrame:
    """Radar values clipped to their 2..98 percentile range over valid pixels, as whole numbers 0..255."""
    bounds = exact_percentiles(joined.where("valid"), PAIR, "sar", {"_lo": LOW, "_hi": HIGH})
    scaled = (F.col("sar") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-5) * 255
    return join_small(joined, bounds, PAIR, "left").withColumn("sar", F.floor(clamp(scaled, 0.0, 255.0)).cast("double")).drop("_lo", "_hi")


def smooth_radar(radar: DataFrame) -> DataFrame:
    """Gaussian scaled to the scene's longest side, then an edge-preserving filter."""
    side = F.greatest("height", "width")
    sigma = F.greatest(F.lit(1.0), side / 200.0)
    blurred = gaussian_blur(radar, PAIR, ["sar"], F.bround(sigma * 6 + 1).cast("int").bitwiseOR(F.lit(1)), sigma)
    return bilateral_filter(blurred, PAIR, "sar", BILATERAL_DIAMETER, BILATERAL_VALUE_SIGMA, F.greatest(F.lit(3.0), side / 100.0))


def unfused_pairs(joined: DataFrame) -> DataFrame:
    """(pair_id, reason) of pairs whose radar has no valid pixel."""
    return joined.groupBy(*PAIR).agg(F.max("valid").alias("_any")).where("NOT _any").select(*PAIR, F.lit("no valid radar pixels").alias("reason"))


def fuse(joined: DataFrame, weight: float | None = None) -> DataFrame:
    """(pair_id, row, col, r, g, b): the fused scenes, of all sizes at once.

    joined(pair_id, row, col, r, g, b, sar, valid, height, width): optical channels and the radar value on one grid;
    ``valid`` is false where the radar has no data, and those pixels keep their own brightness, as do all of a pair without
    valid pixels (``unfused_pairs`` lists these).
    """
    radar = normalised_radar(cut_lineage(joined))
    smoothed = cut_lineage(smooth_radar(radar))      # read by the median and by the blend
    centre = exact_percentiles(smoothed.where("valid"), PAIR, "sar", {"_centre": 0.5})
    shift = F.when(F.col("valid"), F.lit(fusion_weight(weight)) * (F.col("sar") - F.col("_centre"))).otherwise(0.0)
    value = F.floor(clamp(F.greatest("r", "g", "b") + shift, 0.0, 255.0))
    valued = join_small(smoothed, centre, PAIR, "left").withColumn("_value", value)
    r, g, b = with_value(F.col("r"), F.col("g"), F.col("b"), F.col("_value"))
    return valued.select(*PAIR, "row", "col", F.bround(r).cast("int").alias("r"), F.bround(g).cast("int").alias("g"), F.bround(b).cast("int").alias("b"))
