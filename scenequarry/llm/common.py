"""Helpers of the operators: tables, words, digests and positions in a global order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenequarry.session import cut_lineage

# The six white-space characters that separate words, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\f\r"
SPACE_BYTES = SPACES.encode()
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

SLICE_ROWS = 500       # texts of an Arrow batch worked on at once
BOUNDED_BYTES, BOUNDED_ROWS = 4 << 20, 2000     # a bounded slice of a batch ends before the text that passes one of these
ROW_BITS = 33          # monotonically_increasing_id keeps the row of a partition in its low 33 bits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The text, null as the empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words: the text without trailing space, each word with the space before it as one character."""
    return F.length(F.regexp_replace(F.rtrim(whole(text), F.lit(SPACES)), f"{SPACE_CLASS}*+{WORD_CLASS}++", "x")).cast("long")


def without_spaces(text: Column) -> Column:
    return F.regexp_replace(whole(text), f"{SPACE_CLASS}++", "")


def hex64(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of SLICE_ROWS rows, so that a worker holds few texts as Python objects beside the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def bounded(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of bounded rows and bytes; one text beyond the bound is a piece of its own."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text_at).cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = min(start + BOUNDED_ROWS, int(np.searchsorted(ends, base + BOUNDED_BYTES, "right")))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def byte_list(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column of an Arrow batch, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def schema_of(df: DataFrame, *more: str) -> str:
    """DDL of the frame's columns and some more."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *more])


def ordered(df: DataFrame, *order: Column | str, at: str = "position") -> DataFrame:
    """``df`` with ``at``: the row's place, from 0, in the given order over the whole table; written once and read back.

    The rows are range-partitioned and sorted; a row's place is its place in its partition and the sizes of the
    partitions before it. Only one number per partition is gathered: no task sees more than its range.
    """
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id()))
    block = F.shiftright("__row", ROW_BITS)
    sizes = placed.groupBy(block.alias("__block")).agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__block", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    placed = placed.withColumn("__block", block).join(F.broadcast(starts), "__block")          # one row per partition
    place = F.col("__start") + F.col("__row").bitwiseAND((1 << ROW_BITS) - 1)
    return placed.withColumn(at, place).drop("__block", "__row", "__start")
