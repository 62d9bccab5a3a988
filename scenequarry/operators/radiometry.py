"""From raw bands to comparable pixels: band choice, validity, shared stretch and radar despeckling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenequarry.functions.measures import clamp
from scenequarry.operators.joins import join_small
from scenequarry.operators.ranking import bucketed_row_number, exact_percentiles
from scenequarry.operators.rasters import SYMMETRIC, box_mean
from scenequarry.session import cut_lineage

# --- Fixed values: band names, percentiles, sample size and radar limits. ---
BAND_COLOURS = {"red": "red", "b04": "red", "green": "green", "b03": "green", "blue": "blue", "b02": "blue"}
BAND_WARNING = "Band order is not declared in the file; assumed the first three bands are R, G, B."
LOW, HIGH = 0.02, 0.98
MIN_LINEAR = 1e-6
NOISE_BOUNDS = (0.02, 0.5)
RADAR_WINDOW, PREVIEW_WINDOW = 7, 5
# --- End of fixed values. ---

COLOURS = ("red", "green", "blue")


def choose_bands(band_meta: DataFrame) -> DataFrame:
    """(scene_id, bands, warning): the bands read as R, G, B of optical rasters.

    Declared colours first, then unambiguous band names, then bands 1 to 3 with a warning; the lowest band number
    wins within a colour, and rasters of one or two bands keep theirs.
    """
    named = None
    for name, colour in BAND_COLOURS.items():
        is_name = F.lower(F.trim("description")) == name
        named = F.when(is_name, colour) if named is None else named.when(is_name, colour)
    found = band_meta.withColumn("_named", named).groupBy("scene_id").agg(
        F.max("band").alias("_n"),
        *[F.min(F.when(F.col("colorinterp") == c, F.col("band"))).alias(f"_d_{c}") for c in COLOURS],
        *[F.min(F.when(F.col("_named") == c, F.col("band"))).alias(f"_w_{c}") for c in COLOURS],
    )

    def triple(prefix: str) -> Column:
        parts = [F.col(f"{prefix}_{c}") for c in COLOURS]
        return F.when(parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull(), F.array(*parts))

    first = F.sequence(F.lit(1), F.least("_n", F.lit(3)))
    evidence = F.coalesce(triple("_d"), triple("_w"))
    return found.select(
        "scene_id",
        F.when(F.col("_n") <= 2, first).otherwise(F.coalesce(evidence, first)).alias("bands"),
        F.when((F.col("_n") > 2) & evidence.isNull(), F.lit(BAND_WARNING)).alias("warning"),
    )


def standard_pixels(bands: DataFrame, choice: DataFrame, nodata: DataFrame) -> DataFrame:
    """(scene_id, row, col, r, g, b, valid) from bands(scene_id, band, row, col, value).

    choice(scene_id, bands) names the bands in channel order; nodata(scene_id, nodata, alpha_band) is nullable in
    both values. A pixel is valid when finite in all chosen bands, not nodata in all of them and inside the alpha
    band. One channel is repeated three times, a third is the mean of two.
    """
    tagged = bands.join(choice.select("scene_id", "bands"), "scene_id").join(nodata, "scene_id", "left")
    channel = F.array_position("bands", F.col("band"))
    chosen = channel > 0
    finite = ~F.isnan("value") & (F.abs("value") != float("inf"))
    is_alpha = F.col("band").eqNullSafe(F.col("alpha_band"))
    clean = F.when(finite, F.col("value")).otherwise(0.0)
    wide = (
        tagged.where(chosen | is_alpha)
        .groupBy("scene_id", "row", "col")
        .agg(
            *[F.max(F.when(channel == i, clean)).alias(f"_c{i}") for i in (1, 2, 3)],
            F.bool_and(F.when(chosen, F.coalesce(finite, F.lit(False)))).alias("_finite"),
            F.bool_and(F.when(chosen, F.coalesce(F.col("value") == F.col("nodata"), F.lit(False)))).alias("_empty"),
            F.max(F.when(is_alpha, F.col("value"))).alias("_alpha"),
            F.max(F.size("bands")).alias("_k"),
        )
    )
    mean = (F.col("_c1") + F.col("_c2")) / 2
    return wide.select(
        "scene_id", "row", "col",
        F.col("_c1").alias("r"),
        F.when(F.col("_k") == 1, F.col("_c1")).otherwise(F.col("_c2")).alias("g"),
        F.when(F.col("_k") == 1, F.col("_c1")).when(F.col("_k") == 2, mean).otherwise(F.col("_c3")).alias("b"),
        (F.col("_finite") & ~F.col("_empty") & F.coalesce(F.col("_alpha") > 0, F.lit(True))).alias("valid"),
    )


def scenes_without_data(pixels: DataFrame) -> DataFrame:
    """Scenes with no valid pixel, which cannot be analysed."""
    seen = pixels.groupBy("scene_id").agg(F.bool_or("valid").alias("any_valid"))
    return seen.where(~F.col("any_valid")).select("scene_id", F.lit("no valid pixels").alias("error"))


def payload_violations(pixels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, reason) for pairs whose scenes differ in shape or leave the 8-bit range."""
    measured = pixels.groupBy("scene_id").agg(
        F.max("row").alias("h"), F.max("col").alias("w"),
        F.min(F.least("r", "g", "b")).alias("lo"), F.max(F.greatest("r", "g", "b")).alias("hi"),
        F.bool_or(F.col("r").isNull() | F.col("g").isNull() | F.col("b").isNull()).alias("holes"),
    )
    side = lambda s: measured.select(F.col("scene_id").alias(f"scene_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("h", "w", "lo", "hi", "holes")])
    joined = pairs.join(side("a"), "scene_a").join(side("b"), "scene_b")
    outside = (F.least("lo_a", "lo_b") < 0) | (F.greatest("hi_a", "hi_b") > 255)
    reason = (
        F.when(F.col("holes_a") | F.col("holes_b"), "not three channels")
        .when(outside, "not 8-bit")
        .when((F.col("h_a") != F.col("h_b")) | (F.col("w_a") != F.col("w_b")), "shape mismatch")
    )
    return joined.select("pair_id", reason.alias("reason")).where("reason IS NOT NULL")


def to_bands(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long form: one row per pixel and channel 1..3."""
    channels = F.array(*[F.struct(F.lit(i).alias("band"), F.col(c).cast("double").alias("value")) for i, c in enumerate("rgb", 1)])
    return pixels.select(*keys, "row", "col", "valid", F.explode(channels).alias("ch")).select(
        *keys, "row", "col", "valid", "ch.band", "ch.value"
    )


def shared_bounds(pixels: DataFrame) -> DataFrame:
    """(group_id, band, lo, hi): 2nd and 98th percentile of the valid pixels of all scenes of a group together.

    pixels(group_id, scene_id, row, col, r, g, b, valid). A group without valid pixels has no bounds.
    """
    return _bounds(pixels.where("valid"))


def sampled_bounds(pixels: DataFrame, sample_limit: int) -> DataFrame:
    """The same bounds where scenes above ``sample_limit`` valid pixels contribute every n-th one, in reading order."""
    valid = pixels.where("valid")
    counts = valid.groupBy("scene_id").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / sample_limit)).alias("_step"))
    stepped = valid.join(counts, "scene_id")
    placed = bucketed_row_number(stepped.where("_step > 1"), ["scene_id"], "row", ["col"], "_rn")
    return _bounds(stepped.where("_step = 1").unionByName(placed.where((F.col("_rn") - 1) % F.col("_step") == 0).drop("_rn")))


def _bounds(valid: DataFrame) -> DataFrame:
    found = exact_percentiles(to_bands(valid, ["group_id"]), ["group_id", "band"], "value", {"lo": LOW, "hi": HIGH})
    return found.withColumn("hi", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")))


def stretch(pixels: DataFrame, bounds: DataFrame) -> DataFrame:
    """Pixels scaled to whole numbers 0..255 with their group's bounds; invalid ones, and all of a group without bounds, become 0."""
    wide = bounds.groupBy("group_id").agg(
        *[F.max(F.when(F.col("band") == i, F.col(e))).alias(f"_{e}_{c}") for i, c in enumerate("rgb", 1) for e in ("lo", "hi")]
    )
    joined = join_small(pixels, wide, ["group_id"], "left")
    scaled = {
        c: F.when(
            F.col("valid"),
            F.floor(clamp((F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) * 255, 0.0, 255.0)),
        ).otherwise(0).cast("int")
        for c in "rgb"
    }
    return joined.withColumns(scaled).drop(*[f"_{e}_{c}" for c in "rgb" for e in ("lo", "hi")])


def normalization_labels(pixels: DataFrame) -> DataFrame:
    """Whether a group's stretch was shared between scenes or belongs to a single one."""
    scenes = pixels.select("group_id", "scene_id").distinct().groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    return scenes.select("group_id", F.when(F.col("n") > 1, "shared").otherwise("single-image").alias("normalization"))


# ------------------------------------------------------------------ radar


def local_variation(df: DataFrame, keys: Sequence[str], value: str, window: int) -> DataFrame:
    """Adds the local mean and squared coefficient of variation of ``value``."""
    squared = df.withColumns({"mean": F.col(value), "_sq": F.col(value) * F.col(value)})
    local = box_mean(squared, keys, ["mean", "_sq"], window, SYMMETRIC)
    variance = F.greatest(F.col("_sq") - F.col("mean") * F.col("mean"), F.lit(0.0))
    return local.withColumn("ci2", variance / F.greatest(F.col("mean") * F.col("mean"), F.lit(1e-12))).drop("_sq")


def noise_level(varied: DataFrame, keys: Sequence[str], max_side: int | None = None) -> DataFrame:
    """(keys, cu2): lower quartile of the local variation, clamped; with ``max_side`` on a grid of at most so many steps a side."""
    if max_side:
        step = lambda side: F.greatest(F.lit(1), F.floor(F.col(side) / max_side))
        varied = varied.where((F.col("row") % step("height") == 0) & (F.col("col") % step("width") == 0))
    level = exact_percentiles(varied, keys, "ci2", {"cu2": 0.25})
    return level.withColumn("cu2", clamp(F.col("cu2"), *NOISE_BOUNDS))


def lee_filter(df: DataFrame, keys: Sequence[str], value: str, window: int = RADAR_WINDOW) -> DataFrame:
    """Adaptive speckle filter: flat areas become their local mean, edges and targets stay."""
    varied = cut_lineage(local_variation(df, keys, value, window))      # read by the noise level and the blend
    joined = join_small(varied, noise_level(varied, keys), list(keys))
    weight = clamp(1 - F.col("cu2") / F.greatest("ci2", F.lit(1e-12)), 0.0, 1.0)
    filtered = F.col("mean") + weight * (F.col(value) - F.col("mean"))
    return joined.withColumn(value, filtered).drop("mean", "ci2", "cu2")


def radar_units(bands: DataFrame, integer_scenes: DataFrame) -> DataFrame:
    """(scene_id, band, units): display for integer rasters, db when a valid value is negative, else linear."""
    lowest = bands.where("valid").groupBy("scene_id", "band").agg(F.min("value").alias("_min"))
    flagged = lowest.join(integer_scenes.select("scene_id", F.lit(True).alias("_int")), "scene_id", "left")
    units = F.when(F.col("_int"), "display").when(F.col("_min") < 0, "db").otherwise("linear")
    return flagged.select("scene_id", "band", units.alias("units"))


def to_linear(db: Column) -> Column:
    return F.greatest(F.pow(F.lit(10.0), db / 10), F.lit(MIN_LINEAR))


def to_db(linear: Column) -> Column:
    return 10 * F.log10(F.greatest(linear, F.lit(MIN_LINEAR)))


def fill_invalid(bands: DataFrame) -> DataFrame:
    """Invalid values replaced by the valid median of their band, so they do not bleed into neighbours; null in a band without any."""
    medians = exact_percentiles(bands.where("valid"), ["scene_id", "band"], "value", {"_median": 0.5})
    joined = join_small(bands, medians, ["scene_id", "band"], "left")
    return joined.withColumn("value", F.when(F.col("valid"), F.col("value")).otherwise(F.col("_median"))).drop("_median")


def despeckle(bands: DataFrame, integer_scenes: DataFrame) -> DataFrame:
    """Radar bands filtered in the linear domain and returned in dB; display rasters are filtered as they are.

    bands(scene_id, band, row, col, value, valid, height, width).
    """
    keys = ["scene_id", "band"]
    filled = join_small(fill_invalid(bands), radar_units(bands, integer_scenes), list(keys))
    value, units = F.col("value"), F.col("units")
    linear = F.when(units == "db", to_linear(value)).when(units == "linear", F.greatest(value, F.lit(MIN_LINEAR))).otherwise(value)
    filtered = lee_filter(filled.withColumn("value", linear), keys, "value")
    return filtered.withColumn("value", F.when(units == "display", value).otherwise(to_db(value)))


def despeckle_previews(pixels: DataFrame) -> DataFrame:
    """8-bit radar previews(scene_id, row, col, r, g, b, height, width): window 5, gray scenes filtered once."""
    gray = pixels.groupBy("scene_id").agg(F.bool_and((F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))).alias("_gray"))
    marked = join_small(pixels, gray, ["scene_id"])
    channels = [F.struct(F.lit(i).alias("band"), F.col(c).cast("double").alias("value")) for i, c in enumerate("rgb", 1)]
    wanted = F.when(F.col("_gray"), F.array(channels[0])).otherwise(F.array(*channels))
    long = marked.select("scene_id", "row", "col", "height", "width", F.explode(wanted).alias("ch")).select(
        "scene_id", "row", "col", "height", "width", "ch.band", "ch.value"
    )
    filtered = lee_filter(long, ["scene_id", "band"], "value", PREVIEW_WINDOW)
    # a kept pixel can come out a hair below its whole value
    whole = F.floor(clamp(F.col("value"), 0.0, 255.0) + 1e-9).cast("int")
    wide = filtered.groupBy("scene_id", "row", "col").agg(*[F.max(F.when(F.col("band") == i, whole)).alias(c) for i, c in enumerate("rgb", 1)])
    return wide.withColumns({"g": F.coalesce("g", "r"), "b": F.coalesce("b", "r")})
