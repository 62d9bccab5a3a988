"""Exact dedup by a content sort."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenequarry.llm.common import SPACE_BYTES, byte_list, schema_of, sliced, whole, without_spaces
from scenequarry.session import cut_lineage

PREFIX = 16            # leading characters of the normalised text in the sort key


def _walk(text_in: str | None, digests: bool):
    """Walks a sorted partition: compares each normalised text with the one before and numbers rows and runs of equal ones.

    The normalised texts of the partition's first and last row go along, for the comparison with its neighbours.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, row, run, before, digest, held = TaskContext.get().partitionId(), 0, -1, None, None, None

        def out(end: bytes | None) -> pa.RecordBatch:
            batch, marks, runs, leads, start, at = held
            n = batch.num_rows
            more = {
                "__sha256": pa.array(marks, pa.string()), "__lead": pa.array(leads, pa.bool_()), "__block": pa.array([block] * n, pa.int32()),
                "__row": pa.array(range(at, at + n), pa.int64()), "__run": pa.array(runs, pa.int64()),
                "__first": pa.array([start, *[None] * (n - 1)], pa.binary()), "__last": pa.array([*[None] * (n - 1), end], pa.binary()),
            }
            kept = [c for c in batch.schema.names if c != "__text"]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *more.values()], [*kept, *more])

        for batch in sliced(batches):
            if held:
                yield out(None)
            marks, runs, leads, start = [], [], [], None
            texts = batch.column("__text") if text_in is None else batch.column("__keep").field(text_in)
            for text in byte_list(texts):
                normal = text.translate(None, SPACE_BYTES)
                leads.append(normal != before)
                if leads[-1]:
                    before, run = normal, run + 1
                    digest = hashlib.sha256(normal).hexdigest() if digests else None
                    if run == 0:
                        start = normal
                marks.append(digest)
                runs.append(run)
            held = batch, marks, runs, leads, start, row
            row += batch.num_rows
        if held:
            yield out(before)

    return walk


def content_sort(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ("doc_id",), digests: bool = True) -> DataFrame:
    """__keep (struct of the columns ``keep``), __id, __chars, __sha256 and the place: __lead (first of a run of equal texts), __block, __row,
    __run, and on the first and last row of a block __first and __last, the normalised text.

    The sort key is (first characters, two hashes) of the text without white space, so equal texts are neighbours and the sampled
    splitters stay small however long the texts; texts count as equal by comparison only. A salt after the key lets a range
    boundary cut a group of copies: a group of any size is spread over as many partitions as it fills. Within a partition the best row
    of a run comes first. Without ``digests`` __sha256 is null.
    """
    normal = without_spaces(F.col(text))
    carried = [] if text in keep else [normal.alias("__text")]
    keyed = docs.select(
        F.struct(*keep).alias("__keep"), F.col(doc_id).alias("__id"), F.length(whole(text)).alias("__chars"), *carried,
        F.substring(normal, 1, PREFIX).alias("__prefix"), F.xxhash64(normal).alias("__hash"), F.xxhash64(normal, F.lit(PREFIX)).alias("__hash2"),
    ).withColumn("__salt", F.xxhash64("__id", "__chars"))
    key = ("__prefix", "__hash", "__hash2")
    ranged = keyed.repartitionByRange(*key, "__salt").sortWithinPartitions(*key, F.desc("__chars"), F.asc_nulls_last("__id"))
    kept = ranged.select("__keep", "__id", "__chars", *(["__text"] if carried else []))
    more = ("__sha256 string", "__lead boolean", "__block int", "__row bigint", "__run bigint", "__first binary", "__last binary")
    return kept.mapInArrow(_walk(text if text in keep else None, digests), schema_of(kept.drop("__text"), *more))


def _best() -> Column:
    """Least for the row that stays: longest original text, then smallest id (null last), then place."""
    return F.struct(
        (-F.col("__chars")).alias("less"), F.col("__id").isNull().alias("no_id"), F.col("__id").alias("id"),
        F.col("__block").alias("block"), F.col("__row").alias("row"),
    )


def _cut_runs(rows: DataFrame) -> DataFrame:
    """(__block, __run, __start): the runs that a range boundary cuts, with the (block, run) in which their texts begin.

    The last text of a partition is compared with the first of the next one that has rows. There are at most two such runs
    per partition, and one number per partition is ordered.
    """
    ends = rows.where("__last is not null").select("__block", F.col("__run").alias("__end"), "__last")
    blocks = Window.orderBy("__block")
    following = ends.select("__block", F.lead("__block").over(blocks).alias("__next"))
    firsts = rows.where("__first is not null").select(F.col("__block").alias("__next"), "__first")
    met = ends.join(following, "__block").join(firsts, "__next").where(F.col("__last") == F.col("__first"))
    met = met.select(F.col("__next").alias("__block"), F.lit(True).alias("__met"))
    marked = ends.select("__block", "__end").join(met, "__block", "left")
    begins = F.when(F.col("__met").isNull() | (F.col("__end") > 0), F.struct(F.col("__block").alias("block"), F.col("__end").alias("run")))
    start = F.last(begins, ignorenulls=True).over(blocks.rowsBetween(Window.unboundedPreceding, -1))
    later = cut_lineage(marked.withColumn("__start", start).where("__met").select("__block", F.lit(0).cast("long").alias("__run"), "__start"))
    first = later.select("__start").distinct().select(F.col("__start.block").alias("__block"), F.col("__start.run").alias("__run"), "__start")
    return later.unionByName(first)


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same without white space; null counts as empty, and all empty texts are one group. The longest
    original text stays, then the smallest id; a null id is the largest and is a possible keep_id only where all ids are
    null. Of fully repeated rows exactly one is kept. An empty table gives an empty one; other columns are ignored.

    Groups are the runs found by comparing neighbours. A row meets its own partition's run, so the rows of a large group meet as many
    keys as they fill partitions.
    """
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = cut_lineage(content_sort(ids))
    runs = rows.groupBy("__block", "__run").agg(F.count(F.lit(1)).alias("__size"), F.min(_best()).alias("__best"))
    cut = _cut_runs(rows)
    totals = runs.join(F.broadcast(cut), ["__block", "__run"]).groupBy("__start").agg(F.sum("__size").alias("__all"), F.min("__best").alias("__first_best"))
    stitched = cut_lineage(cut.join(totals, "__start").drop("__start"))
    groups = runs.join(F.broadcast(stitched), ["__block", "__run"], "left").select(      # at most two rows per partition
        "__block", "__run", F.coalesce("__all", "__size").alias("group_size"), F.coalesce("__first_best", "__best").alias("best")
    )
    kept = (F.col("__block") == F.col("best.block")) & (F.col("__row") == F.col("best.row"))
    joined = rows.join(groups, ["__block", "__run"])
    return joined.select(F.col("__keep.doc_id").alias("doc_id"), F.col("best.id").alias("keep_id"), "group_size", kept.alias("kept"), F.col("__sha256").alias("text_sha256"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, chosen as in ``exact_groups``; same columns, whatever their names.

    The sorted table holds the first row of each run, and the last row of a partition. A group is in several runs just where a range
    boundary cuts it, so the rows to take out again are at most two per partition.
    """
    rows = cut_lineage(content_sort(docs, doc_id, text, docs.columns, digests=False).where("__lead or __last is not null"))
    cut = cut_lineage(_cut_runs(rows))
    leads = rows.where("__lead").join(F.broadcast(cut), ["__block", "__run"]).select("__start", "__block", "__row", _best().alias("__best"))
    best = leads.groupBy("__start").agg(F.min("__best").alias("__first_best"))
    again = leads.join(best, "__start").where((F.col("__block") != F.col("__first_best.block")) | (F.col("__row") != F.col("__first_best.row")))
    again = cut_lineage(again.select("__block", "__row"))
    return rows.where("__lead").join(F.broadcast(again), ["__block", "__row"], "left_anti").select("__keep.*")
