"""SimHash near-dedup: fingerprints of word shingles, linked through a byte-position index."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenequarry.llm.common import byte_list, hex64, schema_of, sliced
from scenequarry.operators.components import connected_components
from scenequarry.session import cut_lineage

SHINGLE, SEED, BITS = 3, 42, 3
BLOCK = 8192           # shingles whose bits are unpacked at once
SMALL = 32             # entries of an index list compared by shifts; longer lists are walked

# Fingerprints within 3 bits differ in at most 3 of 8 bytes, so at least 5 bytes are equal in place, and one
# half of the fingerprint holds 3 of them: every such pair shares a list of one of these 8 keys.
MATCHES = 8 - BITS
POSITIONS = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]


def fingerprint(text: bytes) -> int:
    """64 bits: set where over half of the shingles' hashes have the bit; no words: zero."""
    words = text.lower().split()          # bytes.lower and bytes.split know only A-Z and the six white-space characters
    if not words:
        return 0
    shingles = [b" ".join(x) for x in zip(*(words[i:] for i in range(SHINGLE)))] if len(words) >= SHINGLE else [b" ".join(words)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), BLOCK):
        block = shingles[at : at + BLOCK]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in block), np.uint64, len(block))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(shingles), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and __fp, the fingerprint as a signed long."""
    given = docs.select(*keep, F.col(text).alias("__text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            marks = [fingerprint(t) for t in byte_list(batch.columns[-1])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(marks, pa.int64())], [*batch.schema.names[:-1], "__fp"])

    return given.mapInArrow(mark, schema_of(given.drop("__text"), "__fp bigint"))


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tallies the bytes equal in place, keeps pairs with enough of them, and verifies the differing bits."""
    x = a ^ b
    y = x | (x >> np.uint64(4))
    y |= y >> np.uint64(2)
    y |= y >> np.uint64(1)
    matches = 8 - np.bitwise_count(y & np.uint64(0x0101010101010101)).astype(np.int8)
    enough = matches >= MATCHES
    enough[enough] = np.bitwise_count(x[enough]) <= BITS
    return enough


def _walk_list(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join what is connected inside one list: each entry is reached once, from whichever neighbour came first."""
    left, found = fps, []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            here = frontier.pop()
            hit = near(np.full(len(left), here), left)
            if hit.any():
                reached, left = left[hit], left[~hit]
                found.append((np.full(len(reached), here), reached))
                frontier.extend(reached)
    return found


def list_links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within sorted lists; keys and fps are parallel."""
    fps = fps.view(np.uint64)
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[edges, len(keys)])
    found = []
    size_at = np.repeat(sizes, sizes)
    rows = np.flatnonzero((size_at > 1) & (size_at <= SMALL))
    for step in range(1, SMALL):
        rows = rows[rows + step < len(keys)]
        rows = rows[keys[rows] == keys[rows + step]]
        if not len(rows):
            break
        hit = rows[near(fps[rows], fps[rows + step])]
        found.append((fps[hit], fps[hit + step]))
    for at, size in zip(edges[sizes > SMALL], sizes[sizes > SMALL]):
        found.extend(_walk_list(fps[at : at + size]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
    return a, b


def _link_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over a partition sorted by key; a list at the end of a batch waits for the next one."""

    def out(keys, fps):
        a, b = list_links(keys, fps)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.r_[keys, batch.column(0).to_numpy()]
        fps = np.r_[fps, batch.column(1).to_numpy()]
        cut = np.searchsorted(keys, keys[-1])
        if cut:
            yield out(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
    if len(keys):
        yield out(keys, fps)


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links among distinct fingerprints (column __fp) that join exactly what is within ``BITS`` bits, directly or by steps."""

    def byte(i: int) -> F.Column:
        return F.shiftrightunsigned("__fp", 8 * i).bitwiseAND(255)

    keys = [
        F.lit(n << 24).cast("long") + byte(i) * 65536 + byte(j) * 256 + byte(k)
        for n, (i, j, k) in enumerate(POSITIONS)
    ]
    index = distinct.select(F.explode(F.array(*keys)).alias("key"), "__fp")
    lists = index.repartition("key").sortWithinPartitions("key")
    return lists.mapInArrow(_link_lists, "a bigint, b bigint").distinct()


def _components(marked: DataFrame) -> DataFrame:
    """(__fp, __root): the fingerprints of ``marked``, each with a fingerprint that stands for its component."""
    distinct = marked.select("__fp").distinct()
    links = fingerprint_links(distinct).select(F.col("a").alias("u"), F.col("b").alias("v"))
    nodes = distinct.select(F.col("__fp").alias("node"))
    return connected_components(nodes, links, []).select(F.col("node").alias("__fp"), F.col("root").alias("__root"))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id (smallest doc_id reachable over fingerprints within 3 bits).

    Equal fingerprints are one node, so copies cost nothing in the index. Null counts as empty; texts without words have
    fingerprint zero and are linked like any other. A null id is never a component_id unless its component has no
    other. Repeated rows and ties stay rows of their own; an empty table gives an empty one.
    """
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = cut_lineage(fingerprints(ids))
    classes = marked.groupBy("__fp").agg(F.min("doc_id").alias("least"))
    rooted = cut_lineage(classes.join(_components(marked), "__fp"))
    least = rooted.groupBy("__root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.select("__fp", "__root").join(least, "__root").select("__fp", "component_id")
    return marked.join(by_fp, "__fp").select("doc_id", hex64(F.col("__fp")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, the one of the smallest id (null last); same columns."""
    numbered = docs.withColumn("__row", F.monotonically_increasing_id()).withColumn("__id", F.col(doc_id))
    marked = cut_lineage(fingerprints(numbered, text, [*docs.columns, "__id", "__row"]))
    rank = F.struct(F.col("__id").isNull().alias("no_id"), F.col("__id").alias("id"), F.col("__row").alias("row"))
    best = marked.groupBy("__fp").agg(F.min(rank).alias("best")).join(_components(marked), "__fp")
    stay = best.groupBy("__root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("__row"))
    return marked.join(stay, "__row", "left_semi").select(*docs.columns)
