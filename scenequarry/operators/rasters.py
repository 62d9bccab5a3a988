"""Neighbourhood operators over pixel tables.

A pixel table has one row per pixel: key columns (a scene, a pair, a band), ``row``, ``col`` and values, dense
within a scene. ``with_shape`` adds ``height`` and ``width``. Windows run along one image row or one image column,
so a task never holds more than one side of a scene at a time, whatever the size of the scene.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenequarry.operators.stencils import over_lines, over_tiles

REFLECT = "reflect"        # edge pixel not repeated: c b | a b c
SYMMETRIC = "symmetric"    # edge pixel repeated: b a | a b c


def scene_shapes(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pixels.groupBy(*keys).agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))


def with_shape(pixels: DataFrame, shapes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pixels.join(shapes.select(*keys, "height", "width"), list(keys))


def mirror_pad(df: DataFrame, axis: str, radius: int, mode: str) -> DataFrame:
    """Adds mirrored copies within ``radius`` beyond both ends of ``axis``; only edge pixels are copied."""
    size = F.col("width" if axis == "col" else "height")
    here = F.col(axis)
    shift = 0 if mode == REFLECT else 1
    period = F.greatest(F.lit(1), 2 * size - 2 + 2 * shift)
    turns = F.ceil((F.lit(radius) + size) / period).cast("int")
    steps = F.sequence(-turns, turns)
    places = F.concat(
        F.transform(steps, lambda k: here + k * period), F.transform(steps, lambda k: k * period - here - shift)
    )
    wanted = F.array_distinct(F.filter(places, lambda p: (p >= -radius) & (p < size + radius)))
    near_edge = (here <= radius) | (here >= size - 1 - radius)
    copies = F.when(near_edge, wanted).otherwise(F.array(here))
    return df.withColumn("_at", F.explode(copies)).drop(axis).withColumnRenamed("_at", axis)


def unpad(df: DataFrame, axis: str) -> DataFrame:
    size = F.col("width" if axis == "col" else "height")
    return df.where((F.col(axis) >= 0) & (F.col(axis) < size))


def _line(keys: Sequence[str], axis: str):
    """The window along ``axis``: one image row or one image column."""
    across = "row" if axis == "col" else "col"
    return Window.partitionBy(*keys, across).orderBy(axis)


def _keep(df: DataFrame, values: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in df.columns if c not in values]


def box_mean(df: DataFrame, keys: Sequence[str], values: Sequence[str], window: int, mode: str = SYMMETRIC) -> DataFrame:
    """Mean over an odd square window, one axis after the other; the columns are replaced by their means."""
    radius = window // 2
    for axis in ("col", "row"):
        padded = mirror_pad(df, axis, radius, mode)
        line = _line(keys, axis).rowsBetween(-radius, radius)
        df = unpad(padded.select(*_keep(padded, values), *[F.avg(v).over(line).alias(v) for v in values]), axis)
    return df


def gaussian_weights(size: int, sigma: float | None = None) -> list[float]:
    """Normalised weights of an odd kernel; the default sigma follows from the size."""
    sigma = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [w / sum(raw) for w in raw]


@lru_cache(maxsize=256)
def _weights(size: int, sigma: float) -> np.ndarray:
    return np.array(gaussian_weights(size, sigma or None))


def gaussian_blur(df: DataFrame, keys: Sequence[str], values: Sequence[str], size: int | Column, sigma: float | Column | None = None) -> DataFrame:
    """Separable blur of several columns at once, one pass per axis; ``size`` and ``sigma`` may differ between scenes, never within one.

    The table has ``height`` and ``width``. Values that are null make null every pixel that they reach.
    """
    sized = df.withColumns({"_size": F.lit(size).cast("int"), "_half": F.floor(F.lit(size) / 2).cast("int"), "_sigma": F.coalesce(F.lit(sigma).cast("double"), F.lit(0.0))})

    def blurred(line: np.ndarray, first: dict) -> np.ndarray:
        return np.convolve(line, _weights(int(first["_size"]), float(first["_sigma"])), "valid")

    for axis in ("col", "row"):
        sized = over_lines(sized, keys, axis, values, "_half", blurred)
    return sized.select(*df.columns)


def erode_valid(df: DataFrame, keys: Sequence[str], valid: str, size: int | Column) -> DataFrame:
    """A boolean mask shrunk by a square kernel; outside the scene counts as valid. ``size`` may differ between scenes.

    Along a line a pixel stays where the nearest invalid ones before and behind lie beyond the kernel: two running values, for any kernel.
    """
    radius = F.floor(F.lit(size) / 2)
    sized = df.withColumn("_half", radius)
    for axis in ("col", "row"):
        line = _line(keys, axis)
        hole = F.when(~F.col(valid), F.col(axis))
        before = F.max(hole).over(line.rowsBetween(Window.unboundedPreceding, 0))
        behind = F.min(hole).over(line.rowsBetween(0, Window.unboundedFollowing))
        far = (F.coalesce(F.col(axis) - before, F.col("_half") + 1) > F.col("_half")) & (F.coalesce(behind - F.col(axis), F.col("_half") + 1) > F.col("_half"))
        sized = sized.select(*_keep(sized, [valid]), far.alias(valid))
    return sized.select(*[c for c in df.columns])


def gradient(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Gradient magnitude: central differences inside, one-sided at the edges."""

    def slope(axis: str) -> Column:
        line = _line(keys, axis)
        here, before, after = F.col(value), F.lag(value, 1).over(line), F.lead(value, 1).over(line)
        inside = (after - before) / 2
        return F.coalesce(inside, after - here, here - before, F.lit(0.0))

    return df.withColumn("_dx", slope("col")).withColumn("_dy", slope("row")).withColumn(
        out, F.hypot("_dx", "_dy")
    ).drop("_dx", "_dy")


def bilateral_filter(
    df: DataFrame, keys: Sequence[str], value: str, diameter: int, sigma_value: float, sigma_space: float | Column
) -> DataFrame:
    """Edge-preserving mean over a disc: neighbours weigh less the farther away and the more different they are.

    Tiles are shifted over themselves, and two sums are kept per pixel whatever the diameter. ``sigma_space`` may differ between scenes.
    """
    radius = diameter // 2
    disc = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]

    def smoothed(tile: np.ndarray, first: dict) -> np.ndarray:
        height, width = tile.shape[0] - 2 * radius, tile.shape[1] - 2 * radius
        here = tile[radius : radius + height, radius : radius + width]
        top, bottom = np.zeros_like(here), np.zeros_like(here)
        for dy, dx in disc:
            near = tile[radius + dy : radius + dy + height, radius + dx : radius + dx + width]
            weight = np.exp(-(dx * dx + dy * dy) / (2 * first["_space"] ** 2) - (near - here) ** 2 / (2 * sigma_value**2))
            top += near * weight
            bottom += weight
        return top / bottom

    spaced = df.withColumn("_space", F.lit(sigma_space).cast("double"))
    return over_tiles(spaced, keys, [value], radius, smoothed).select(*df.columns)


def area_resize(df: DataFrame, keys: Sequence[str], values: Sequence[str], new_height: Column, new_width: Column) -> DataFrame:
    """Area-averaged shrink: every source pixel is shared among the target cells it overlaps, by overlap."""

    def shares(axis: str, size: Column, target: Column) -> Column:
        factor = size / target
        start, end = F.col(axis) / factor, (F.col(axis) + 1) / factor
        first = F.floor(start).cast("int")
        last = F.greatest(first, F.least(F.ceil(end - 1e-9).cast("int") - 1, target.cast("int") - 1))
        return F.transform(
            F.sequence(first, last),
            lambda t: F.struct(t.alias("t"), (F.least(end, t + 1) - F.greatest(start, t)).alias("w")),
        )

    spread = df.withColumn("_r", F.explode(shares("row", F.col("height"), new_height))).withColumn(
        "_c", F.explode(shares("col", F.col("width"), new_width))
    )
    weight = F.col("_r.w") * F.col("_c.w")
    return spread.groupBy(*keys, F.col("_r.t").alias("row"), F.col("_c.t").alias("col")).agg(
        *[(F.sum(F.col(v) * weight) / F.sum(weight)).alias(v) for v in values]
    )


def preview(df: DataFrame, keys: Sequence[str], values: Sequence[str], longest: int = 2048) -> DataFrame:
    """Scenes shrunk so that no side exceeds ``longest``; smaller ones keep their size."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest("height", "width"))
    sized = lambda side: F.greatest(F.lit(1), F.bround(F.col(side) * scale).cast("int"))
    return area_resize(df, keys, values, sized("height"), sized("width"))


def nearest_resize(df: DataFrame, keys: Sequence[str], values: Sequence[str], new_height: Column, new_width: Column) -> DataFrame:
    """Nearest-pixel resize for masks: target cell t reads source pixel floor(t * size / target)."""

    def targets(axis: str, size: Column, target: Column) -> Column:
        first = F.ceil(F.col(axis) * target / size).cast("int")
        last = F.ceil((F.col(axis) + 1) * target / size).cast("int") - 1
        return F.when(first <= last, F.sequence(first, last))

    spread = df.withColumn("_r", F.explode(targets("row", F.col("height"), new_height))).withColumn(
        "_c", F.explode(targets("col", F.col("width"), new_width))
    )
    return spread.select(*keys, F.col("_r").alias("row"), F.col("_c").alias("col"), *values)
