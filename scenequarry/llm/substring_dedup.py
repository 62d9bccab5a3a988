"""Substring dedup: repeated windows of words found through difference-cover anchors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenequarry.llm.common import byte_list, schema_of, sliced

WINDOW = 35                        # words
# A perfect difference set: every difference modulo the period is one of two members, so of any two starts
# of the same words, shifted alike by fewer than PERIOD words, one pair of positions lies in the cover.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
ANCHOR = WINDOW - PERIOD + 1       # words hashed at a cover position: they lie within the window for every shift
BASE_A, BASE_B, MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))

ROWS = 1 << 16                     # rows of a batch sent back

POSTED = "part int, key bigint, positions binary, keys binary, counts binary, hashes binary, checks binary, sure binary"


def word_hashes(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rolled(words: np.ndarray, at: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Hashes of the ``length`` words from each position ``at``."""
    total = np.zeros(len(at), np.uint64)
    for k in range(length):
        total = total * base + words[at + k]
    return (total ^ (total >> np.uint64(32))) * MIX


def anchors_of(words: np.ndarray) -> np.ndarray:
    """Cover positions whose anchor lies in a text that has a window."""
    if len(words) < WINDOW:
        return np.empty(0, np.int64)
    at = np.arange(len(words) - ANCHOR + 1)
    return at[np.isin(at % PERIOD, COVER)]


def candidates_of(n: int, anchors: np.ndarray) -> np.ndarray:
    """Window starts that hold one of the repeated anchors within their first PERIOD positions."""
    last = n - WINDOW + 1
    change = np.zeros(n + 2, np.int32)
    np.add.at(change, np.maximum(anchors - PERIOD + 1, 0), 1)
    np.add.at(change, np.minimum(anchors + 1, n + 1), -1)
    return np.flatnonzero(np.cumsum(change)[:last] > 0)


def covered_by(n: int, starts: np.ndarray) -> np.ndarray:
    """Which of ``n`` words the windows from ``starts`` cover."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + WINDOW, -1)
    return np.cumsum(change)[:n] > 0


def _post(keys: list[int], found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], parts: int, tell: bool) -> Iterator[pa.RecordBatch]:
    """What one partition found (per text: positions, hashes, second hashes), as one block of bytes for each part of the hashes.

    What repeats within the partition is known to repeat: one of each such hash goes out, marked as sure, and if ``tell`` the
    positions of all go back to their texts at once. So a passage sends one entry per partition however often it occurs.
    """
    if not found:
        return
    of = np.repeat(np.arange(len(keys)), [len(x[0]) for x in found])
    at, hashes, checks = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((checks, hashes))
    fresh = np.r_[True, (hashes[order][1:] != hashes[order][:-1]) | (checks[order][1:] != checks[order][:-1])][: len(order)]
    sizes = np.diff(np.r_[np.flatnonzero(fresh), len(order)])
    first, sure = order[fresh], sizes > 1
    empty = b""

    def batch(rows):
        types = (pa.int32(), pa.int64(), *(pa.binary(),) * 6)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], [c.split()[0] for c in POSTED.split(", ")])

    if tell:
        again = np.sort(order[np.repeat(sure, sizes)])
        rows = [
            (int(keys[of[own[0]]] % parts), int(keys[of[own[0]]]), at[own].astype(np.int32).tobytes(), *(empty,) * 5)
            for own in np.split(again, np.flatnonzero(np.diff(of[again])) + 1) if len(own)
        ]
        if rows:
            yield batch(rows)
    back = np.argsort(first, kind="stable")
    first, sure = first[back], sure[back]
    part = (hashes[first] >> np.uint64(32)) % np.uint64(parts)
    to = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[to], np.arange(parts + 1, dtype=np.uint64))
    keys = np.array(keys, np.int64)
    for p in np.flatnonzero(np.diff(edges)):
        own = to[edges[p] : edges[p + 1]]
        rows, text = first[own], of[first[own]]
        begins = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        yield batch([(
            int(p), 0, at[rows].astype(np.int32).tobytes(), keys[text[begins]].tobytes(), np.diff(np.r_[begins, len(text)]).astype(np.int32).tobytes(),
            hashes[rows].astype(np.uint32 if tell else np.uint64).tobytes(), empty if tell else checks[rows].astype(np.uint32).tobytes(),
            np.packbits(sure[own]).tobytes(),
        )])


def _collected(batches: Iterator[pa.RecordBatch], repeated: bool) -> Iterator[pa.RecordBatch]:
    """(key, position) for the entries of one part whose hash is there more than once or sure, or else for the others."""
    wide = np.uint32 if repeated else np.uint64
    blocks = []

    def out(keys, at):
        for i in range(0, len(keys), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + ROWS]), pa.array(at[i : i + ROWS])], ["__key", "position"])

    for batch in batches:
        for row in batch.to_pylist():
            at = np.frombuffer(row["positions"], np.int32)
            if not row["keys"]:
                yield from out(np.full(len(at), row["key"], np.int64), at)
                continue
            counts = np.frombuffer(row["counts"], np.int32)
            checks = np.frombuffer(row["checks"], np.uint32) if row["checks"] else np.zeros(len(at), np.uint32)
            sure = np.unpackbits(np.frombuffer(row["sure"], np.uint8), count=len(at)).astype(bool)
            blocks.append((np.repeat(np.frombuffer(row["keys"], np.int64), counts), at, np.frombuffer(row["hashes"], wide), checks, sure))
    if not blocks:
        return
    keys, at, hashes, checks, sure = (np.concatenate(x) for x in zip(*blocks))
    order = np.lexsort((checks, hashes))
    fresh = np.r_[True, (hashes[order][1:] != hashes[order][:-1]) | (checks[order][1:] != checks[order][:-1])][: len(order)]
    group = np.cumsum(fresh) - 1
    many = (np.bincount(group) > 1) | (np.bincount(group, sure[order]) > 0)
    own = order[many[group] == repeated]
    yield from out(keys[own], at[own])


def _positions(column: pa.Array) -> list[np.ndarray | None]:
    """The distinct positions of each row of a list column, ascending; null where there are none."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    present = column.is_valid().to_pylist()
    return [np.unique(values[a:b]).astype(np.int64) if there else None for a, b, there in zip(ends, ends[1:], present)]


def drop_repeats(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with n_words, n_removed and kept_text (kept words joined by one space).

    Removed is every word of a window of WINDOW words whose sequence starts anywhere else too, in another text or the same;
    copies lose all their windows, the first one too. 1. Anchors: at cover positions ANCHOR words are hashed, and equal hashes meet.
    2. Extension: only windows around a repeated anchor are hashed whole (96 bits) and meet again; those that are alone go back
    to their texts. 3. The rest of the candidates are removed. A text without anchors in common never leaves stage 1,
    and the texts themselves are shuffled once, by row.

    Null counts as empty; texts shorter than a window lose nothing. Repeated rows and null ids are rows of their own, so
    a repeated row loses all its windows. Columns of other names do not matter. An empty table gives an empty one.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(*keep, F.monotonically_increasing_id().alias("__key"), F.col(text).alias("__text")).repartition("__key")
    key_at = len(keep)

    def over(find: Callable, tell: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, found = [], []
            for batch in sliced(batches):
                extra = _positions(batch.column(key_at + 2)) if batch.num_columns > key_at + 2 else [None] * batch.num_rows
                for key, text, more in zip(batch.column(key_at).to_pylist(), byte_list(batch.column(key_at + 1)), extra):
                    own = find(text, more)
                    if own is not None and len(own[0]):
                        keys.append(key)
                        found.append(own)
            yield from _post(keys, found, parts, tell)

        return run

    def anchors(text: bytes, _):
        words = word_hashes(text)
        at = anchors_of(words)
        return at, rolled(words, at, ANCHOR, BASE_A), np.zeros(len(at), np.uint64)

    def windows(text: bytes, repeated: np.ndarray):
        words = word_hashes(text)
        at = candidates_of(len(words), repeated)
        return at, rolled(words, at, WINDOW, BASE_A), rolled(words, at, WINDOW, BASE_B) >> np.uint64(32)

    def meet(posted: DataFrame, repeated: bool, name: str) -> DataFrame:
        dealt = posted.repartitionById(parts, F.col("part"))
        own = dealt.mapInArrow(lambda batches: _collected(batches, repeated), "__key bigint, position int")
        return own.groupBy("__key").agg(F.collect_list("position").alias(name))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n_words, n_removed, kept = [], [], []
            texts = byte_list(batch.column(key_at + 1))
            for text, repeated, alone in zip(texts, _positions(batch.column(key_at + 2)), _positions(batch.column(key_at + 3))):
                words = text.split()
                n = len(words)
                if repeated is not None:
                    starts = candidates_of(n, repeated)
                    starts = starts if alone is None else np.setdiff1d(starts, alone, assume_unique=True)
                    gone = covered_by(n, starts)
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                n_words.append(n)
                n_removed.append(n - len(words))
                kept.append(b" ".join(words))
            made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:key_at], *made], [*keep, "n_words", "n_removed", "kept_text"])

    repeated = meet(rows.mapInArrow(over(anchors, True), POSTED), True, "repeated")
    joined = rows.join(repeated, "__key").select(*keep, "__key", "__text", "repeated")
    alone = meet(joined.mapInArrow(over(windows, False), POSTED), False, "alone")
    marked = rows.join(repeated.join(alone, "__key", "left"), "__key", "left").select(*keep, "__key", "__text", "repeated", "alone")
    out = schema_of(docs.select(*keep), "n_words bigint", "n_removed bigint", "kept_text string")
    return marked.mapInArrow(remove, out)
