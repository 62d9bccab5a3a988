"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenequarry.llm.common import ordered, word_count
from scenequarry.session import cut_lineage

SCALE_BITS = 24        # expected copies are whole multiples of 2^-24: prefix sums stay exact up to 2^38 rows of a source


def _targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """``sources`` with ``target``: a common level times the weight, at most ``cap`` times the source's size.

    Each round sums the capped sources and the free weights (two numbers come back) and raises the level by the
    excess; the capped ones only grow in number, so it ends when a round adds none.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget, level, capped = share * total, 0.0, -1
    while True:
        is_capped = cap * F.col("source_size") <= F.lit(level) * F.col("__weight")
        n, size, free = sources.agg(
            F.count_if(is_capped), F.sum(F.when(is_capped, F.col("source_size"))), F.sum(F.when(~is_capped, F.col("__weight")))
        ).first()
        if n == capped or not free:
            break
        capped, level = n, (budget - cap * (size or 0)) / free
    reached = F.least(cap * F.col("source_size"), F.lit(level) * F.col("__weight"))
    return sources.withColumn("target", reached if free else cap * F.col("source_size"))


def mix(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 42,
    doc_id: str = "doc_id", source: str = "source", text: str = "text", size: Column | None = None, keep: Sequence[str] | None = None,
) -> DataFrame:
    """The rows (columns ``keep``, by default all) with size, source_size, target, copies and taken.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` of all sizes; a target
    stops at ``cap`` times its source's size and the excess is shared anew by weight. Every document of a source
    expects target / source_size copies. In the order (size, doc_id, hash of the text) the expected copies are
    summed up within the source, one random offset per source is added, and a row is taken once for each integer the
    sum passes. Sizes grow along the order, so the words taken stray from the target by about one document.

    A null text or one without words has size 0 and takes part; sources of size 0 have target 0. A null source
    is a source of its own. Repeated rows and ties are rows of their own; null ids come first. An empty
    table gives an empty one. Columns of ``docs`` named like a result (size, source_size, target, copies, taken)
    are replaced by it.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    mixed = _mixed(docs, weights, share, cap, seed, doc_id, source, text, size, keep)
    return mixed.select(*(F.col("row")[c].alias(c) for c in keep), *made)


def emitted(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mix`` takes it; the same columns, whatever their names."""
    settings = {"weights": (3, 1, 2), "share": 1.5, "cap": 2.0, "seed": 42, "doc_id": "doc_id", "source": "source", "text": "text", "size": None}
    mixed = _mixed(docs, **(settings | options), keep=docs.columns)
    rows = mixed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def _mixed(docs, weights, share, cap, seed, doc_id, source, text, size, keep) -> DataFrame:
    """row (a struct of the columns ``keep``, so that they may have any names), size, source_size, target, copies, taken."""
    count = word_count(F.col(text)) if size is None else size
    sized = docs.select(
        F.struct(*keep).alias("row"), count.alias("size"), F.col(source).alias("__source"), F.col(doc_id).alias("__id"), F.xxhash64(text).alias("__tie")
    )
    placed = ordered(sized, F.asc_nulls_last("__source"), F.asc("size"), F.asc_nulls_first("__id"), F.asc("__tie"), at="__place")
    sources = placed.groupBy("__source").agg(F.sum("size").alias("source_size"), F.min("__place").alias("__first"))
    ranked = ordered(sources, "__first", at="__rank")
    weight = F.element_at(F.lit(list(weights)), (F.col("__rank") % len(weights)).cast("int") + 1)
    ranked = cut_lineage(ranked.withColumn("__weight", weight.cast("long")))
    ranked = cut_lineage(_targets(ranked, share, cap))
    one = 1 << SCALE_BITS
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * one + 0.5)).otherwise(0).cast("long")
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("__source", F.lit("")))), 1, SCALE_BITS // 4)
    rates = ranked.select(
        F.col("__source").alias("__of"), "source_size", "target", "__first", ratio.alias("__ratio"),
        F.conv(digits, 16, 10).cast("long").alias("__offset"),
    )
    before = (F.col("__place") - F.col("__first")) * F.col("__ratio") + F.col("__offset")
    copies = F.shiftright(before + F.col("__ratio"), SCALE_BITS) - F.shiftright(before, SCALE_BITS)
    mixed = placed.join(rates, F.col("__source").eqNullSafe(F.col("__of"))).withColumn("copies", copies)
    return mixed.withColumn("taken", F.col("copies") * F.col("size"))
