"""Stencils in blocks: image lines and tiles travel as arrays with a halo of the pixels around them, edges are mirrored in place.

A block's kernel comes from columns of its scene, so scenes of all sizes go through one plan, which does not grow with the kernel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = 1024          # pixels of a line in a block, without the halo
TILE = 128           # side of a tile, without the halo
PIXELS = 1 << 19     # pixels of a batch that is sent back


def _blocks(axis: str, size: Column, halo: Column, side: int) -> Column:
    """The blocks that a pixel belongs to or is a halo of."""
    last = F.floor((size - 1) / side)
    return F.sequence(F.greatest(F.lit(0), F.floor((F.col(axis) - halo) / side)), F.least(last, F.floor((F.col(axis) + halo) / side)))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _mapped(grouped: DataFrame, df: DataFrame, keys: Sequence[str], values: Sequence[str], work: Callable) -> DataFrame:
    """The pixels of ``df`` from rows (keys, .., _pixels: sorted structs); ``work`` gives a block's inner places and new values.

    Values that are null or not a number make null every pixel that they reach.
    """
    names = df.columns
    inner = [c for c in names if c not in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_pixels")
            ends, pixels = lists.offsets.to_numpy(), lists.values
            fields = {c: pixels.field(c) for c in inner}
            data = {c: _numbers(fields[c]) for c in inner if pa.types.is_floating(fields[c].type) or pa.types.is_integer(fields[c].type)}
            block = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c in ("_block", "_down", "_across")}
            rows, places, made, n = [], [], {v: [] for v in values}, 0

            def out():
                at = pa.array(np.concatenate(places))
                row = pa.array(np.concatenate(rows))
                new = {v: np.concatenate(made[v]) for v in values}
                return pa.RecordBatch.from_arrays(
                    [batch.column(c).take(row) if c in keys else pa.array(new[c], mask=np.isnan(new[c])) if c in values else fields[c].take(at) for c in names], names
                )

            for i, (a, b) in enumerate(zip(ends, ends[1:])):
                inside, new = work({c: x[a:b] for c, x in data.items()}, {c: int(x[i]) for c, x in block.items()})
                rows.append(np.full(len(inside), i))
                places.append(a + inside)
                for v in values:
                    made[v].append(new[v])
                n += len(inside)
                if n >= PIXELS:
                    yield out()
                    rows, places, made, n = [], [], {v: [] for v in values}, 0
            if n:
                yield out()

    schema = ", ".join(f"`{f.name}` {'double' if f.name in values else f.dataType.simpleString()}" for f in df.schema.fields)
    return grouped.mapInArrow(run, schema)


def _mirrored(x: np.ndarray, before: int, after: int) -> np.ndarray:
    return np.pad(x, (before, after), mode="reflect") if before or after else x


def over_lines(df: DataFrame, keys: Sequence[str], axis: str, values: Sequence[str], halo: str, work: Callable[[np.ndarray, dict], np.ndarray]) -> DataFrame:
    """Replaces ``values`` along ``axis``. ``work`` gets a block's values with as many neighbours as the column ``halo`` says on both
    sides, and the numbers of the first pixel, and returns the block's new values."""
    across = "row" if axis == "col" else "col"
    size = F.col("width" if axis == "col" else "height")
    spread = df.withColumn("_block", F.explode(_blocks(axis, size, F.col(halo), LINE)))
    others = [c for c in df.columns if c not in (*keys, across, axis)]
    grouped = spread.groupBy(*keys, across, "_block").agg(F.array_sort(F.collect_list(F.struct(axis, *others))).alias("_pixels"))

    def line(data: dict[str, np.ndarray], block: dict[str, int]) -> tuple[np.ndarray, dict]:
        at = data[axis].astype(np.int64)
        inside = np.flatnonzero(at // LINE == block["_block"])
        radius = int(data[halo][0])
        before, after = radius - inside[0], radius - (len(at) - 1 - inside[-1])
        first = {c: x[0] for c, x in data.items()}
        return inside, {v: work(_mirrored(data[v], before, after), first) for v in values}

    return _mapped(grouped, df, [*keys, across], values, line)


def over_tiles(df: DataFrame, keys: Sequence[str], values: Sequence[str], halo: int, work: Callable[[np.ndarray, dict], np.ndarray]) -> DataFrame:
    """Like ``over_lines`` for square tiles: ``work`` gets a tile with ``halo`` pixels around it."""
    radius = F.lit(halo)
    spread = df.withColumn("_down", F.explode(_blocks("row", F.col("height"), radius, TILE))).withColumn("_across", F.explode(_blocks("col", F.col("width"), radius, TILE)))
    others = [c for c in df.columns if c not in (*keys, "row", "col")]
    grouped = spread.groupBy(*keys, "_down", "_across").agg(F.array_sort(F.collect_list(F.struct("row", "col", *others))).alias("_pixels"))

    def tile(data: dict[str, np.ndarray], block: dict[str, int]) -> tuple[np.ndarray, dict]:
        row, col = data["row"].astype(np.int64), data["col"].astype(np.int64)
        shape = (row[-1] - row[0] + 1, col[-1] - col[0] + 1)
        inner = [np.flatnonzero(np.arange(first, first + n) // TILE == at) for first, n, at in ((row[0], shape[0], block["_down"]), (col[0], shape[1], block["_across"]))]
        pads = [(halo - x[0], halo - (n - 1 - x[-1])) for x, n in zip(inner, shape)]
        first = {c: x[0] for c, x in data.items()}
        inside = (inner[0][:, None] * shape[1] + inner[1]).ravel()
        return inside, {v: work(np.pad(data[v].reshape(shape), pads, mode="reflect"), first).ravel() for v in values}

    return _mapped(grouped, df, list(keys), values, tile)
