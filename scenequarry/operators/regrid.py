"""Resampling one grid onto another of the same reference system, in blocks of the reference grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenequarry.operators.joins import join_small

BLOCK = 128          # side of a block of the reference grid
NEAR = 1e-6          # how much wider than exact, in reference cells, the search for a source cell's readers is
PIXELS = 1 << 19     # cells of a batch that is sent back
_GRID = ("a_x", "a_y", "a_res", "a_height", "a_width", "b_x", "b_y", "b_res", "b_height", "b_width")


def _readers(cell: str, shift: Column, size: str, method: str) -> Column:
    """The blocks along one axis with reference cells that read source cell ``cell``; null where none does.

    A reference cell n lies at (shift + (n + 0.5) * a_res) / b_res source cells. Two-point weights reach one source cell to both sides
    of a source centre, the nearest source cell is the one that holds the place.
    """
    reach = (-0.5, 1.5) if method == "bilinear" else (0.0, 1.0)
    at = lambda place: ((F.col(cell) + place) * F.col("b_res") - shift) / F.col("a_res") - 0.5
    first = F.greatest(F.lit(0), F.ceil(at(reach[0]) - NEAR))
    last = F.least(F.col(size) - 1, F.floor(at(reach[1]) + NEAR))
    return F.when(first <= last, F.sequence(F.floor(first / BLOCK), F.floor(last / BLOCK)))


def _sources(place: np.ndarray, method: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Source cells and weights along one axis."""
    if method == "nearest":
        return [(np.floor(place).astype(np.int64), np.ones(len(place)))]
    low = np.floor(place - 0.5)
    part = place - 0.5 - low
    return [(low.astype(np.int64), 1 - part), (low.astype(np.int64) + 1, part)]


def _resampled(grid: dict[str, float], first: tuple[int, int], cells: tuple[np.ndarray, ...], method: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of one block of the reference grid from the source cells (row, col, value) that it reads."""
    rows = np.arange(first[0], min(first[0] + BLOCK, int(grid["a_height"])))
    cols = np.arange(first[1], min(first[1] + BLOCK, int(grid["a_width"])))
    y = (grid["b_y"] - grid["a_y"] + (rows + 0.5) * grid["a_res"]) / grid["b_res"]
    x = (grid["a_x"] + (cols + 0.5) * grid["a_res"] - grid["b_x"]) / grid["b_res"]
    down, across = _sources(y, method), _sources(x, method)
    # only the source rows and columns that the block reads, however far apart they lie
    used = [np.unique(np.concatenate([at for at, _ in axis])) for axis in (down, across)]
    patch = np.full((len(used[0]), len(used[1])), np.nan)
    spot = [np.searchsorted(u, c) for u, c in zip(used, cells[:2])]
    kept = np.ones(len(cells[2]), bool)
    for u, s, c in zip(used, spot, cells[:2]):
        kept &= u[np.minimum(s, len(u) - 1)] == c
    patch[spot[0][kept], spot[1][kept]] = cells[2][kept]
    top, bottom = np.zeros((len(rows), len(cols))), np.zeros((len(rows), len(cols)))
    for at_y, w_y in down:
        for at_x, w_x in across:
            value = patch[np.searchsorted(used[0], at_y)[:, None], np.searchsorted(used[1], at_x)[None, :]]
            weight = np.where(np.isnan(value), 0.0, w_y[:, None] * w_x[None, :])
            top += np.where(weight > 0, value, 0.0) * weight
            bottom += weight
    inside = ((y >= 0) & (y < grid["b_height"]))[:, None] & ((x >= 0) & (x < grid["b_width"]))[None, :]
    with np.errstate(invalid="ignore", divide="ignore"):
        value = np.where(inside & (bottom > 0), top / bottom, np.nan)
    return np.repeat(rows, len(cols)), np.tile(cols, len(rows)), value.ravel()


def regrid(pairs: DataFrame, source: DataFrame, method: str = "bilinear") -> DataFrame:
    """(pair_id, row, col, value): source values on every cell of the reference grid, null outside the source.

    pairs(pair_id, a_x, a_y, a_res, a_height, a_width, b_x, b_y, b_res, b_height, b_width), one row per pair_id, hold both grids' upper-left
    corner, cell size and shape; source(pair_id, row, col, value[, valid]) has one row per cell. A reference cell reads one or four source
    cells; those that are missing, not valid, null or not a number drop out and the remaining weights are rescaled.

    Source cells go once to the blocks of the reference grid that read them (cells at a border to both blocks, cells that nobody reads
    to none), and a block is resampled in one piece, so neither side is multiplied per cell. The grids may have any ratio of cell sizes.
    """
    if method not in ("bilinear", "nearest"):
        raise ValueError(f"unknown method {method}")
    pairs = pairs.select("pair_id", *[F.col(c).cast("double").alias(c) for c in _GRID])
    usable = source.where("valid") if "valid" in source.columns else source
    cells = usable.select("pair_id", "row", "col", F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double")).alias("value")).where("value is not null")
    on_grid = (F.col("row") >= 0) & (F.col("row") < F.col("b_height")) & (F.col("col") >= 0) & (F.col("col") < F.col("b_width"))
    placed = (
        join_small(cells, pairs, ["pair_id"])
        .where(on_grid)
        .withColumn("_down", F.explode(_readers("row", F.col("b_y") - F.col("a_y"), "a_height", method)))
        .withColumn("_across", F.explode(_readers("col", F.col("a_x") - F.col("b_x"), "a_width", method)))
        .groupBy("pair_id", "_down", "_across")
        .agg(F.collect_list(F.struct("row", "col", "value")).alias("_cells"))
    )
    last = lambda size: F.floor((F.col(size) - 1) / BLOCK)
    blocks = (
        pairs.where("a_height > 0 and a_width > 0")
        .withColumn("_down", F.explode(F.sequence(F.lit(0).cast("long"), last("a_height"))))
        .withColumn("_across", F.explode(F.sequence(F.lit(0).cast("long"), last("a_width"))))
    )
    filled = blocks.join(placed, ["pair_id", "_down", "_across"], "left").withColumn("_cells", F.coalesce("_cells", F.array().cast(placed.schema["_cells"].dataType)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["pair_id", "row", "col", "value"]
        for batch in batches:
            lists = batch.column("_cells")
            ends, every = lists.offsets.to_numpy(), lists.values
            whole = [every.field(c).to_numpy(zero_copy_only=False) for c in ("row", "col", "value")]
            numbers = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*_GRID, "_down", "_across")}
            made: list[tuple[np.ndarray, ...]] = []
            size = 0

            def out() -> pa.RecordBatch:
                owner, row, col, value = (np.concatenate(part) for part in zip(*made))
                return pa.RecordBatch.from_arrays(
                    [batch.column("pair_id").take(pa.array(owner)), pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(value, mask=np.isnan(value))], names
                )

            for i, (a, b) in enumerate(zip(ends, ends[1:])):
                grid = {c: float(numbers[c][i]) for c in _GRID}
                first = (int(numbers["_down"][i]) * BLOCK, int(numbers["_across"][i]) * BLOCK)
                row, col, value = _resampled(grid, first, tuple(w[a:b] for w in whole), method)
                made.append((np.full(len(row), i), row, col, value))
                size += len(row)
                if size >= PIXELS:
                    yield out()
                    made, size = [], 0
            if made:
                yield out()

    return filled.mapInArrow(run, f"pair_id {pairs.schema['pair_id'].dataType.simpleString()}, row int, col int, value double")
