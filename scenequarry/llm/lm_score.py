"""Cross-entropy difference (Moore and Lewis, 2010): documents scored by a target and a background language model."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenequarry.llm.common import byte_list
from scenequarry.operators.joins import join_small
from scenequarry.session import cut_lineage

# Words and pairs of words are counted each for itself, known by 72 bits. No table has a size of its own: documents are dealt to blocks,
# a block asks for its distinct n-grams, and the n-grams are dealt to as many parts as the corpus needs.
SMOOTHING = 50.0                 # pseudo-counts of the word model in the pair model
MIX = np.uint64(0x9E3779B97F4A7C15)
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 50_000       # text and rows of a block, about
PART_BYTES = 16 << 20            # text per part of the n-grams
HOT_ROWS = 1000                  # rows of one id beyond which they are dealt to several blocks


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers, byte by byte: all lowest bytes, then the next; as many as the largest number needs."""
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8) if len(numbers) else 1
    return bytes([width]) + np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    columns = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((columns.shape[1], 8), np.uint8)
    out[:, :width] = columns.T
    return out.view("<u8").ravel()


@dataclass
class Grams:
    """n-grams of one kind, each known by 64 and 8 bits; ``at`` numbers the distinct ones in ascending order."""

    keys: np.ndarray
    checks: np.ndarray

    def __post_init__(self):
        order = np.argsort(self.keys, kind="stable")
        same = self.keys[order][1:] == self.keys[order][:-1]
        if (same & (self.checks[order][1:] != self.checks[order][:-1])).any():
            order = np.lexsort((self.checks, self.keys))
            same = (self.keys[order][1:] == self.keys[order][:-1]) & (self.checks[order][1:] == self.checks[order][:-1])
        first = np.r_[np.ones(min(1, len(order)), bool), ~same]
        self.order, self.starts = order, np.flatnonzero(first)
        self.at = np.empty(len(order), np.int64)
        self.at[order] = np.cumsum(first) - 1

    def summed(self, numbers: np.ndarray) -> np.ndarray:
        return np.add.reduceat(numbers[self.order], self.starts) if len(self.starts) else numbers[:0]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        return self.keys[self.order[self.starts]], self.checks[self.order[self.starts]]


class Block:
    """The documents of a block: words per text, the words and the pairs (each word with the one before) at their places."""

    def __init__(self, rows: pa.Table):
        marks = rows["mark"].to_numpy(zero_copy_only=False).astype(bool)
        self.rows = rows.filter(pa.array(~marks))
        ids = self.rows["doc_id"].combine_chunks()
        marked = rows.filter(pa.array(marks))["doc_id"].combine_chunks()
        self.chosen = pc.is_in(ids, marked, skip_nulls=True).to_numpy(zero_copy_only=False).astype(bool)
        words = [text.lower().split() for text in byte_list(self.rows["text"].combine_chunks())]
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for some in words for w in some), np.uint64).reshape(-1, 2)
        before = np.zeros_like(hashes)
        before[1:] = hashes[:-1]
        self.heads = (np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]       # first words of texts
        before[self.heads] = 0
        pairs = ((before * MIX) ^ hashes) * MIX
        shift = np.uint64(56)
        self.words, self.pairs = (Grams(x[:, 0].copy(), (x[:, 1] >> shift).astype(np.uint8)) for x in (hashes, pairs))
        self.doc = np.repeat(np.arange(len(words)), self.sizes)

    def counts(self, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
        """In the block's targets and in all its texts."""
        return grams.summed(self.chosen[self.doc].astype(np.int64)), grams.summed(np.ones(len(self.doc), np.int64))


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Parts are slices of the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


ASKED = "block bigint, part bigint, n_words bigint, keys binary, checks binary, target binary, background binary"
ANSWERED = "block bigint, part bigint, n_words bigint, n_pairs bigint, shared binary, target binary, background binary, vocabulary bigint, target_words bigint, background_words bigint"


def _table(schema: str, columns: list) -> pa.Table:
    types = {"bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array(values, types[kind]) for (name, kind), values in zip(fields, columns)})


def _asked(parts: int):
    """Per block a row for each part: the block's distinct words and pairs there, as differences, with their counts in its texts."""

    def ask(rows: pa.Table) -> pa.Table:
        block = Block(rows)
        if not len(block.sizes):
            return _table(ASKED, [[]] * 7)
        kinds = []
        for grams in (block.words, block.pairs):
            keys, checks = grams.distinct()
            edges = np.searchsorted(_part_of(keys, parts), np.arange(parts + 1, dtype=np.uint64))
            kinds.append((keys, checks, *block.counts(grams), edges))
        out = []
        for p in range(parts):
            own = [[x[k[4][p] : k[4][p + 1]] for x in k[:4]] for k in kinds]
            steps = np.concatenate([np.diff(o[0], prepend=np.uint64(0)) for o in own])
            out.append((p, len(own[0][0]), packed(steps), np.concatenate([o[1] for o in own]).tobytes(), *(packed(np.concatenate([o[i] for o in own])) for i in (2, 3))))
        number = rows["block"][0].as_py()
        return _table(ASKED, [[number] * parts, *zip(*out)])

    return ask


def _answered(asked: pa.Table) -> pa.Table:
    """Per row of a part's requests how often its n-grams are in other blocks (one bit where in none), and the part's totals of words."""
    rows = asked.to_pylist()
    n_words = [r["n_words"] for r in rows]
    steps, checks = [unpacked(r["keys"]) for r in rows], [np.frombuffer(r["checks"], np.uint8) for r in rows]
    own = [[unpacked(r[name]).astype(np.int64) for r in rows] for name in ("target", "background")]
    others = [[[], []] for _ in rows]
    totals = []
    for kind in (0, 1):
        cut = [slice(0, n) if kind == 0 else slice(n, None) for n in n_words]
        keys = [np.cumsum(x[c], dtype=np.uint64) for x, c in zip(steps, cut)]
        ends = np.cumsum([len(k) for k in keys])[:-1]
        grams = Grams(np.concatenate(keys), np.concatenate([x[c] for x, c in zip(checks, cut)]))
        for i in (0, 1):
            counts = np.concatenate([x[c] for x, c in zip(own[i], cut)])
            summed = grams.summed(counts)
            if kind == 0:
                totals.append(int(summed.sum()))
            for mine, left in zip(others, np.split(summed[grams.at] - counts, ends)):
                mine[i].append(left)
        if kind == 0:
            totals.append(len(grams.starts))
    out = []
    for r, (target, background) in zip(rows, others):
        target, background = np.concatenate(target), np.concatenate(background)
        shared = background > 0                     # the targets are among all documents
        out.append((r["block"], r["part"], r["n_words"], len(shared) - r["n_words"], np.packbits(shared).tobytes(), packed(target[shared]), packed(background[shared]), totals[2], totals[0], totals[1]))
    return _table(ANSWERED, list(zip(*out)))


def _rated(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """The losses of a block's documents by the counts that came back."""
    block = Block(rows)
    answers = answers.sort_by("part").to_pylist()
    sizes, n, doc, heads = block.sizes, len(block.doc), block.doc, block.heads
    others = [[[], []], [[], []]]               # kind, model
    for a in answers:
        bits = np.unpackbits(np.frombuffer(a["shared"], np.uint8), count=a["n_words"] + a["n_pairs"])
        for model, name in enumerate(("target", "background")):
            full = np.zeros(len(bits), np.int64)
            full[np.flatnonzero(bits)] = unpacked(a[name])
            others[0][model].append(full[: a["n_words"]])
            others[1][model].append(full[a["n_words"] :])
    vocabulary, target_words, background_words = (sum(a[c] for a in answers) for c in ("vocabulary", "target_words", "background_words"))
    scale = min(1.0, max(target_words, 1) / max(background_words, 1))
    # how often the document itself has the n-gram
    own = []
    for grams in (block.words, block.pairs):
        _, back, counts = np.unique(doc * max(len(grams.starts), 1) + grams.at, return_inverse=True, return_counts=True)
        own.append(counts[back])
    mine = [block.counts(grams) for grams in (block.words, block.pairs)]
    chosen = block.chosen[doc]
    means = []
    for model, (total, rate, out) in enumerate(((target_words, 1.0, chosen), (background_words, scale, np.ones(n, bool)))):
        c1, c2 = (
            ((mine[k][model] + np.concatenate(others[k][model] or [np.zeros(0, np.int64)]))[grams.at] - own[k] * out) * rate
            for k, grams in enumerate((block.words, block.pairs))
        )
        ch = np.r_[np.zeros(min(1, n)), c1[:-1]]
        ch[heads] = 0.0
        mass = (total - sizes[doc] * out) * rate
        unigram = (c1 + 1.0) / (mass + vocabulary + 1.0)
        # a word's count is of wherever it stands, at the end too: at least the sum of its pairs; the start of a text has none
        losses = -np.log((c2 + SMOOTHING * unigram) / (np.maximum(ch, c2) + SMOOTHING))
        means.append(np.bincount(doc, losses, len(sizes)) / np.maximum(sizes, 1))
    made = [pa.array(sizes), *(pa.array(m, pa.float64()) for m in means)]
    return pa.Table.from_arrays([block.rows["doc_id"], *made], ["doc_id", "n_tokens", "target_loss", "background_loss"])


def cross_entropy_difference(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, target_loss, background_loss, score (background less target, per word; higher: more like the target).

    ``target`` lists the ids (its first column) of the documents that the target model learns from; the background model learns from all.
    The background counts are scaled to the target's number of words, and both models share one vocabulary, the distinct words of all documents
    and one more, so both are smoothed alike. A document's own counts are left out when it is scored.

    Texts are dealt out once, by id, and so are the targets; rows of an id that many have (and of none) go to several blocks. A block's
    n-grams go to the parts that count them, and only counts of n-grams that other blocks have too come back.

    Null counts as empty; texts without words have losses and score 0. A null id is never a target. Repeated ids in ``target`` count once,
    repeated documents are rows of their own. Without targets the target model is uniform. An empty table gives an empty one, and other
    columns do not matter.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    size, rows = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    n_blocks, parts = max(1, -(-size // BLOCK_BYTES), -(-rows // BLOCK_ROWS)), max(1, -(-size // PART_BYTES))

    hot = given.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS)
    hot = cut_lineage(hot.select("doc_id", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("shares")))
    marks = target.select(F.col(target.columns[0]).cast(kind).alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    shares, row = F.coalesce("shares", F.lit(1)), F.monotonically_increasing_id()
    block = lambda *of: F.pmod(F.xxhash64(*of), F.lit(n_blocks))
    dealt = join_small(given, hot, ["doc_id"], "left").select(
        F.when(F.col("doc_id").isNull(), block(row)).otherwise(block("doc_id", F.pmod(row, shares).cast("int"))).alias("block"), "doc_id", "text", F.lit(False).alias("mark")
    )
    marked = join_small(marks, hot, ["doc_id"], "left").select("doc_id", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    marked = marked.select(block("doc_id", "share").alias("block"), "doc_id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("mark"))
    blocks = dealt.unionByName(marked)          # both passes group it alike and read the same shuffle

    asked = blocks.groupBy("block").applyInArrow(_asked(parts), ASKED)
    answers = asked.groupBy("part").applyInArrow(_answered, ANSWERED)
    losses = f"doc_id {kind}, n_tokens bigint, target_loss double, background_loss double"
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_rated, losses)
    return scored.withColumn("score", F.col("background_loss") - F.col("target_loss"))


def good_rows(labels: DataFrame, held_out: Column) -> DataFrame:
    """Ids of the labelled rows of quality 1 that are not held out."""
    return labels.where((F.col("quality") == 1) & ~held_out).select("doc_id")
