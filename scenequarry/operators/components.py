"""Connected components of very large graphs by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenequarry.session import cut_lineage


ROUNDS_PER_WRITE = 2


def _large_star(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or the node itself)."""
    both = pairs.unionByName(pairs.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    larger = both.where(F.col("v") > F.col("u")).join(smallest, [*keys, "u"])
    return larger.select(*keys, F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    smallest = pairs.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    rest = pairs.join(smallest, [*keys, "u"]).where(F.col("v") != F.col("m"))
    linked = rest.select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(smallest.select(*keys, "u", F.col("m").alias("v"))).distinct()


def _signature(pairs: DataFrame) -> tuple:
    """Row count and order-free checksum: two numbers come back to the driver per round."""
    digest = F.xxhash64(*pairs.columns).cast("decimal(38,0)")
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(digest)).first())


def connected_components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, node, root): the smallest node id of each component, per key.

    nodes(keys, node), edges(keys, u, v) with numeric ids unique within a key. Every second round is written
    to the checkpoint folder, so lost executors cost two rounds at most; rounds grow with the logarithm of the graph.
    """
    keys = list(keys)
    oriented = edges.where(F.col("u") != F.col("v")).select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    pairs = cut_lineage(oriented.distinct())
    before = _signature(pairs)
    while before[0]:
        for _ in range(ROUNDS_PER_WRITE):
            pairs = _small_star(_large_star(pairs, keys), keys)
        pairs = cut_lineage(pairs)
        after = _signature(pairs)
        if after == before:
            break
        before = after
    roots = pairs.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.join(roots, [*keys, "node"], "left").withColumn("root", F.coalesce("root", "node"))
