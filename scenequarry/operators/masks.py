"""Binary masks as run tables: (keys, row, start, end, height, width), one row per horizontal run of set pixels.

Runs keep masks small, make morphology an interval union per image row, and feed component labelling without a
pixel-by-pixel graph.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenequarry.operators.components import connected_components
from scenequarry.operators.joins import join_small
from scenequarry.session import cut_lineage

BUCKET = 64         # columns per bucket when runs of neighbouring rows are matched
BAND = 64           # image rows that are labelled in one task


def scene_scale(reference_side: int = 512) -> Column:
    return F.sqrt(F.col("height").cast("double") * F.col("width")) / reference_side


def odd_kernel(base: int, scale: Column) -> Column:
    """An odd kernel side of at least 3 that grows with the scene."""
    size = F.greatest(F.lit(3), F.bround(base * scale).cast("int"))
    return size + 1 - size % 2


def to_runs(pixels: DataFrame, keys: Sequence[str], flag: Column) -> DataFrame:
    line = Window.partitionBy(*keys, "row").orderBy("col")
    islands = pixels.where(flag).select(
        *keys, "row", "col", "height", "width", (F.col("col") - F.row_number().over(line)).alias("_island")
    )
    return islands.groupBy(*keys, "row", "_island").agg(
        F.min("col").alias("start"), F.max("col").alias("end"), F.max("height").alias("height"), F.max("width").alias("width")
    ).drop("_island")


def to_pixels(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return runs.select(*keys, "row", F.explode(F.sequence("start", "end")).alias("col"))


def merge_runs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overlapping or touching runs of an image row become one."""
    line = Window.partitionBy(*keys, "row").orderBy("start", "end")
    reached = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    opened = runs.withColumn("_new", F.when(reached >= F.col("start") - 1, 0).otherwise(1))
    numbered = opened.withColumn("_island", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "row", "_island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("height").alias("height"), F.max("width").alias("width")
    ).drop("_island")


def complement(runs: DataFrame, shapes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The unset pixels of every scene in shapes(keys, height, width); runs must not overlap."""
    keys = list(keys)
    rows = shapes.select(*keys, "height", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row"))
    joined = rows.join(runs.select(*keys, "row", "start", "end"), [*keys, "row"], "left")
    line = Window.partitionBy(*keys, "row").orderBy("start")
    placed = joined.withColumns({"_first": F.row_number().over(line) == 1, "_next": F.lead("start").over(line)})
    gap = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    leading = F.when(F.col("_first"), gap(F.lit(0), F.coalesce("start", "width") - 1))
    following = F.when(F.col("start").isNotNull(), gap(F.col("end") + 1, F.coalesce("_next", "width") - 1))
    gaps = placed.select(*keys, "row", "height", "width", F.explode(F.array_compact(F.array(leading, following))).alias("_gap"))
    return gaps.where(F.col("_gap.start") <= F.col("_gap.end")).select(*keys, "row", "_gap.start", "_gap.end", "height", "width")


def dilate(runs: DataFrame, keys: Sequence[str], kernel: Column) -> DataFrame:
    """Growth by an elliptical kernel: every run is widened and copied to the rows the ellipse reaches."""
    spread = runs.withColumn("_r", F.floor((kernel - 1) / 2).cast("int")).select(
        "*", F.explode(F.sequence(-F.col("_r"), F.col("_r"))).alias("_dy")
    )
    half = F.bround(F.sqrt((F.col("_r") * F.col("_r") - F.col("_dy") * F.col("_dy")).cast("double"))).cast("int")
    moved = spread.withColumn("_half", half).withColumn("row", F.col("row") + F.col("_dy"))
    inside = moved.where((F.col("row") >= 0) & (F.col("row") < F.col("height")))
    grown = inside.select(
        *keys, "row",
        F.greatest(F.lit(0), F.col("start") - F.col("_half")).alias("start"),
        F.least(F.col("width") - 1, F.col("end") + F.col("_half")).alias("end"),
        "height", "width",
    )
    return merge_runs(grown, keys)


def erode(runs: DataFrame, shapes: DataFrame, keys: Sequence[str], kernel: Column) -> DataFrame:
    """Shrinkage by an elliptical kernel; outside the scene counts as set, so edges are not eaten."""
    return complement(dilate(complement(runs, shapes, keys), keys, kernel), shapes, keys)


def opened(runs: DataFrame, shapes: DataFrame, keys: Sequence[str], kernel: Column, times: int = 1) -> DataFrame:
    """Erosions then dilations; the complements between two erosions cancel out."""
    unset = complement(runs, shapes, keys)
    for _ in range(times):
        unset = dilate(unset, keys, kernel)
    kept = complement(unset, shapes, keys)
    for _ in range(times):
        kept = dilate(kept, keys, kernel)
    return kept


def closed(runs: DataFrame, shapes: DataFrame, keys: Sequence[str], kernel: Column, times: int = 1) -> DataFrame:
    for _ in range(times):
        runs = dilate(runs, keys, kernel)
    unset = complement(runs, shapes, keys)
    for _ in range(times):
        unset = dilate(unset, keys, kernel)
    return complement(unset, shapes, keys)


def union(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return merge_runs(a.unionByName(b), keys)


def subtract(a: DataFrame, b: DataFrame, shapes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels of ``a`` not in ``b``, as the complement of (not a) or b."""
    return complement(union(complement(a, shapes, keys), b.select(*a.columns), keys), shapes, keys)


def _touching(start: np.ndarray, end: np.ndarray, line: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs (sorted by image row and start) on neighbouring rows that touch."""
    span = int(end.max()) + 2 * reach + 2           # a number line on which the rows lie one after the other
    first = np.searchsorted(line * span + end, (line + 1) * span + start - reach, "left")
    past = np.searchsorted(line * span + start, (line + 1) * span + end + reach, "right")
    # runs of other rows between the two places: none, as only the next row lies on that stretch
    n = np.maximum(past - first, 0)
    upper = np.repeat(np.arange(len(line)), n)
    return upper, np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest member of each one's group, by union-find."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in zip(u.tolist(), v.tolist()):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.fromiter(map(root, range(n)), np.int64, n)


def label_runs(runs: DataFrame, keys: Sequence[str], connectivity: int = 8) -> DataFrame:
    """Adds ``label``: the id of the run's connected group (4- or 8-neighbour), its smallest row * width + start.

    Bands of BAND image rows are labelled in one task each; only the runs on both sides of a border between bands link
    labels, and only labels with such links go through the rounds for large graphs.
    """
    keys = list(keys)
    reach = 1 if connectivity == 8 else 0
    columns = [f.name for f in runs.schema.fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema.fields), "_label bigint"])

    def label_band(band: pa.Table) -> pa.Table:
        band = band.sort_by([("row", "ascending"), ("start", "ascending")])
        line, start, end, width = (band[c].to_numpy().astype(np.int64) for c in ("row", "start", "end", "width"))
        labels = _labels(len(line), *_touching(start, end, line - line[0], reach))
        return band.select(columns).append_column("_label", pa.array((line * width + start)[labels], pa.int64()))

    banded = runs.withColumn("_band", F.floor(F.col("row") / BAND))
    named = cut_lineage(banded.groupBy(*keys, "_band").applyInArrow(label_band, schema))
    bucket = lambda a, b: F.explode(F.sequence(F.floor(a / BUCKET), F.floor(b / BUCKET))).alias("_b")
    upper = named.where(F.col("row") % BAND == BAND - 1).select(
        *keys, (F.col("row") + 1).alias("row"), F.col("_label").alias("u"), F.col("start").alias("s1"), F.col("end").alias("e1"),
        bucket(F.col("start") - reach, F.col("end") + reach),
    )
    lower = named.where(F.col("row") % BAND == 0).select(
        *keys, "row", F.col("_label").alias("v"), F.col("start").alias("s2"), F.col("end").alias("e2"), bucket(F.col("start"), F.col("end"))
    )
    touching = (F.col("s1") <= F.col("e2") + reach) & (F.col("s2") <= F.col("e1") + reach)
    edges = cut_lineage(upper.join(lower, [*keys, "row", "_b"]).where(touching).select(*keys, "u", "v").distinct())
    linked = edges.select(*keys, F.col("u").alias("node")).union(edges.select(*keys, F.col("v"))).distinct()
    roots = connected_components(linked, edges, keys).select(*keys, F.col("node").alias("_label"), "root")
    return join_small(named, roots, [*keys, "_label"], "left").withColumn("label", F.coalesce("root", "_label")).drop("_label", "root")


def group_measures(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, label, x, y, w, h, area, frac, height, width): box, pixel count and share of the scene per group."""
    grouped = labelled.groupBy(*keys, "label").agg(
        F.min("start").alias("x"), F.min("row").alias("y"),
        (F.max("end") - F.min("start") + 1).alias("w"), (F.max("row") - F.min("row") + 1).alias("h"),
        F.sum(F.col("end") - F.col("start") + 1).alias("area"),
        F.max("height").alias("height"), F.max("width").alias("width"),
    )
    return grouped.withColumn("frac", F.col("area") / (F.col("height").cast("long") * F.col("width")))


def grow_seeds(loose: DataFrame, seeds: DataFrame, keys: Sequence[str], max_growth: float) -> DataFrame:
    """Two-level threshold: loose groups that hold seeds and are at most ``max_growth`` times their seeds, plus all
    seeds. Every seed run lies inside exactly one loose run of its row."""
    keys = list(keys)
    labelled = label_runs(loose, keys)
    held = labelled.select(*keys, "row", "label", F.col("start").alias("_s"), F.col("end").alias("_e"))
    bucket = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / BUCKET), F.floor(F.col(b) / BUCKET))).alias("_b")
    by_bucket = held.select("*", bucket("_s", "_e"))
    seeded = seeds.withColumn("_b", F.floor(F.col("start") / BUCKET)).join(by_bucket, [*keys, "row", "_b"])
    counts = seeded.where(F.col("start").between(F.col("_s"), F.col("_e"))).groupBy(*keys, "label").agg(
        F.sum(F.col("end") - F.col("start") + 1).alias("_seeds")
    )
    sizes = labelled.groupBy(*keys, "label").agg(F.sum(F.col("end") - F.col("start") + 1).alias("_size"))
    grown = sizes.join(counts, [*keys, "label"]).where(F.col("_size") <= max_growth * F.col("_seeds"))
    kept = labelled.join(grown.select(*keys, "label"), [*keys, "label"], "left_semi").drop("label")
    return union(kept.select(*seeds.columns), seeds, keys)
