"""Ranked lexical search: the best documents of each query item, found by walking a tree of items and a tree of documents together."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenequarry.llm.common import ROW_BITS, bounded, byte_list
from scenequarry.session import cut_lineage

# Terms are the maximal runs of ASCII letters, digits and all characters beyond ASCII; only A-Z are lower-cased.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

BLOCK_ITEMS, BLOCK_TERMS = 2000, 1 << 16     # a block of items ends with the item that passes one of these
CHUNK_DOCS, CHUNK_ENTRIES = 2048, 1 << 19    # documents (and their terms in common with the items) that share a tree
BATCH, FAN = 16, 8                           # documents of a lowest node, children of the others
SALTS = 64
EXACT = 1 << 53                              # doubles add whole numbers exactly below


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def term_scores(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term of weight 1 scores in a document of n terms that holds it tf times; 64-bit integers."""
    m = 10 + (90 * n * n_docs) // max(n_terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@dataclass
class Items:
    """A block of items: per item its row, its id and its distinct terms as numbers of the block's vocabulary."""

    rows: list[int]
    ids: list
    terms: list[np.ndarray]
    size: int               # of the vocabulary


@dataclass
class Node:
    """Items that lie together: the union of their terms, and what is below."""

    items: list[int]
    terms: np.ndarray
    weights: np.ndarray
    children: list[Node]


def item_tree(items: Items, weights: np.ndarray) -> Node:
    """Items in the order of their heaviest terms, so that those that share a rare term lie together, FAN to a node."""
    heaviest = [tuple(t[np.lexsort((t, -weights[t]))][:3].tolist()) for t in items.terms]
    order = sorted(range(len(items.rows)), key=heaviest.__getitem__)
    level = [Node([i], items.terms[i], weights[items.terms[i]], []) for i in order]
    while len(level) > 1:
        groups = [level[k : k + FAN] for k in range(0, len(level), FAN)]
        level = []
        for group in groups:
            terms = np.unique(np.concatenate([g.terms for g in group]))
            level.append(Node([i for g in group for i in g.items], terms, weights[terms], group))
    return level[0]


class Chunk:
    """Documents of a task: their terms' scores by row, and levels of coordinate maxima over BATCH documents, FAN batches, and so on."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, score: np.ndarray, n_docs: int, weights: np.ndarray):
        # documents that share their heaviest term lie together, as items do
        heaviest = np.full(n_docs, len(weights), np.int64)
        by_weight = np.argsort(np.argsort(-weights, kind="stable"))
        np.minimum.at(heaviest, doc, by_weight[term])
        self.order = np.argsort(heaviest, kind="stable")
        place = np.empty(n_docs, np.int64)
        place[self.order] = np.arange(n_docs)
        sort = np.argsort(place[doc], kind="stable")
        self.doc, self.term, self.score = place[doc][sort], term[sort], score[sort]
        self.starts = np.searchsorted(self.doc, np.arange(0, n_docs + BATCH, BATCH))     # entries of each batch
        self.present = np.unique(self.term)                                             # columns of the maxima
        column = np.zeros(len(weights), np.int64)
        column[self.present] = np.arange(len(self.present))
        low = np.zeros(-(-n_docs // BATCH) * len(self.present), np.float64)
        np.maximum.at(low, self.doc // BATCH * len(self.present) + column[self.term], self.score.astype(np.float64))
        self.levels = [low.reshape(-1, len(self.present))] if len(self.present) else [np.zeros((1, 0))]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN), axis=0))

    def bounds(self, level: int, nodes: np.ndarray, node: Node) -> np.ndarray:
        """No document of the nodes scores more for any item of the node."""
        at = np.searchsorted(self.present, node.terms)
        there = at < len(self.present)
        there[there] = self.present[at[there]] == node.terms[there]
        return self.levels[level][np.ix_(nodes, at[there])] @ node.weights[there].astype(np.float64)

    def scores(self, batches: np.ndarray, weight_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the batches and their scores for one item."""
        sizes = self.starts[batches + 1] - self.starts[batches]
        own = np.repeat(self.starts[batches] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        part = self.score[own] * weight_of[self.term[own]]
        first = np.flatnonzero(np.r_[True, self.doc[own][1:] != self.doc[own][:-1]][: len(own)])
        return self.order[self.doc[own][first]], np.add.reduceat(part, first) if len(own) else part


class Best:
    """The best documents of each item of a task so far."""

    def __init__(self, n_items: int, top: int):
        self.top, self.found, self.kth = top, [[] for _ in range(n_items)], np.ones(n_items, np.int64)

    def add(self, item: int, ids: list, scores: np.ndarray) -> None:
        new = [(-int(s), x is None, x if x is not None else 0, x) for s, x in zip(scores, ids)]
        self.found[item] = sorted(self.found[item] + new, key=lambda r: r[:3])[: self.top]
        if len(self.found[item]) == self.top:
            self.kth[item] = -self.found[item][-1][0]


class Walk:
    """Both trees walked from their roots: a pair of nodes whose bound lies below the weakest kth score of its items goes with all below it.

    Items that lack documents first score the batch at the end of their steepest way down, so that there is a kth score to begin with.
    ``looked`` counts the pairs whose bound was taken.
    """

    def __init__(self, tree: Node, chunk: Chunk, ids: list, best: Best, weights: np.ndarray):
        self.tree, self.chunk, self.ids, self.best = tree, chunk, ids, best
        self.safe = float(weights.sum()) * 1e6 < EXACT          # beyond, bounds would be rounded: nothing is pruned
        self.weight_of = np.zeros(len(weights), np.int64)
        self.done: dict[int, int] = {}                          # an item's first batch
        self.looked = 0

    def run(self) -> None:
        if len(self.chunk.term):
            top = len(self.chunk.levels) - 1
            self.begin(self.tree, top)
            self.visit(self.tree, top, np.zeros(1, np.int64))

    def below(self, level: int, nodes: np.ndarray) -> np.ndarray:
        children = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
        return children[children < len(self.chunk.levels[level - 1])]

    def bounds(self, level: int, nodes: np.ndarray, node: Node) -> np.ndarray:
        self.looked += len(nodes)
        return self.chunk.bounds(level, nodes, node)

    def begin(self, node: Node, level: int) -> None:
        for child in node.children:
            self.begin(child, level)
        if node.children or len(self.best.found[node.items[0]]) == self.best.top:
            return
        at = np.zeros(1, np.int64)
        while level:
            children = self.below(level, at)
            level -= 1
            at = children[[self.bounds(level, children, node).argmax()]]
        self.done[node.items[0]] = int(at[0])
        self.score(node, at)

    def score(self, node: Node, batches: np.ndarray) -> None:
        item, best = node.items[0], self.best
        self.weight_of[node.terms] = node.weights
        docs, scores = self.chunk.scores(batches, self.weight_of)
        self.weight_of[node.terms] = 0
        good = np.flatnonzero(scores >= best.kth[item])
        if len(good) > best.top:                                # all that tie with the weakest stay, ids decide among them
            good = good[scores[good] >= np.partition(scores[good], -best.top)[-best.top]]
        if len(good):
            best.add(item, [self.ids[d] for d in docs[good]], scores[good])

    def visit(self, node: Node, level: int, nodes: np.ndarray) -> None:
        while True:
            bounds = self.bounds(level, nodes, node)
            if self.safe:
                able = bounds >= self.best.kth[node.items].min()
                nodes, bounds = nodes[able], bounds[able]
            if not len(nodes):
                return
            if not node.children and not level:
                break
            if level:
                nodes, level = self.below(level, nodes), level - 1
            if node.children:
                for child in node.children:
                    self.visit(child, level, nodes)
                return
        item = node.items[0]
        order = np.argsort(-bounds, kind="stable")              # the most promising batches first
        for at in range(0, len(order), FAN):
            some = order[at : at + FAN]
            some = some[(bounds[some] >= self.best.kth[item]) | (not self.safe)]
            if not len(some):
                return
            self.score(node, nodes[some][nodes[some] != self.done.get(item, -1)])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with their block and distinct terms."""
    block, n_items, n_terms, row = TaskContext.get().partitionId() << ROW_BITS, 0, 0, TaskContext.get().partitionId() << ROW_BITS
    for batch in bounded(batches, 1):
        blocks, rows, terms = [], [], []
        for text in byte_list(batch.column(1)):
            own = sorted(set(terms_of(text)))
            blocks.append(block)
            rows.append(row)
            terms.append([t.decode("utf-8", "replace") for t in own])
            row, n_items, n_terms = row + 1, n_items + 1, n_terms + len(own)
            if n_items >= BLOCK_ITEMS or n_terms >= BLOCK_TERMS:
                block, n_items, n_terms = block + 1, 0, 0
        made = [pa.array(blocks, pa.int64()), pa.array(rows, pa.int64()), pa.array(terms, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["item_id", "block", "item", "terms"])


def _entries(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Per document with terms: id, number of terms, and those of the vocabulary with their counts."""
    size = max(len(vocabulary), 1)
    for batch in bounded(batches, 1):
        n, known = [], []
        for text in byte_list(batch.column(1)):
            terms = terms_of(text)
            n.append(len(terms))
            known.append([vocabulary[t] for t in terms if t in vocabulary])
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        keys = np.repeat(np.arange(len(known)), sizes) * size + np.fromiter((t for own in known for t in own), np.int64, int(sizes.sum()))
        keys, counts = np.unique(keys, return_counts=True)
        edges = np.searchsorted(keys // size, np.arange(len(known) + 1))
        terms, counts = (keys % size).astype("<i4"), counts.astype("<i4")
        cut = [slice(a, b) for a, b in zip(edges, edges[1:])]
        made = [pa.array(n, pa.int64()), *(pa.array([x[c].tobytes() for c in cut], pa.binary()) for x in (terms, counts))]
        out = pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "n", "terms", "counts"])
        yield out.filter(pa.array(np.array(n) > 0, pa.bool_()))


def _document_counts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(term, documents of the task that hold it)."""
    total = np.zeros(size, np.int64)
    for batch in batches:
        found = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4")
        total += np.bincount(found, minlength=size)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["term", "df"])


def _searched(batches: Iterator[pa.RecordBatch], items: Items, weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> Iterator[pa.RecordBatch]:
    """(item, doc_id, score) of the task's best documents."""
    tree, best = item_tree(items, weights), Best(len(items.rows), top)
    parts: list[tuple] = []
    ids: list = []
    entries = 0

    def search():
        nonlocal parts, ids, entries
        if ids:
            chunk = Chunk(*(np.concatenate(x) for x in zip(*parts)), len(ids), weights)
            Walk(tree, chunk, ids, best, weights).run()
        parts, ids, entries = [], [], 0

    kind = pa.null()
    for batch in batches:
        kind = batch.schema.field(0).type
        for at in range(0, batch.num_rows, BATCH * FAN):
            own = batch.slice(at, BATCH * FAN)
            raw = own.column(2).to_pylist()
            sizes = np.fromiter((len(x) // 4 for x in raw), np.int64, len(raw))
            doc, term = np.repeat(np.arange(len(raw)), sizes), np.frombuffer(b"".join(raw), "<i4").astype(np.int64)
            tf = np.frombuffer(b"".join(own.column(3).to_pylist()), "<i4").astype(np.int64)
            n = own.column(1).to_numpy(zero_copy_only=False)
            parts.append((doc + len(ids), term, term_scores(tf, n[doc], n_docs, n_terms)))
            ids.extend(own.column(0).to_pylist())
            entries += len(term)
            if len(ids) >= CHUNK_DOCS or entries >= CHUNK_ENTRIES:
                search()
    search()
    rows = [(items.rows[i], r[3], -r[0]) for i, found in enumerate(best.found) for r in found]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), kind, pa.int64()))], ["item", "doc_id", "score"])


def _block(rows: list, id_name: str = "item_id") -> tuple[Items, dict[bytes, int]]:
    vocabulary = {t: k for k, t in enumerate(sorted({t for r in rows for t in r["terms"]}))}
    terms = [np.array(sorted(vocabulary[t] for t in r["terms"]), np.int64) for r in rows]
    return Items([r["item"] for r in rows], [r[id_name] for r in rows], terms, len(vocabulary)), {t.encode(): k for t, k in vocabulary.items()}


def search(
    docs: DataFrame, items: DataFrame, top: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents of a score above 0, best first, equal scores by ascending doc_id.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))); a document of n terms scores weight x ((10^9 tf) div (1000 tf + 8 m)) for each distinct
    term of the item, with m = 10 + (90 n N) div L over the N documents with terms and their L terms.

    Items are worked on in blocks of bounded items and terms, each against all documents: the texts are read once per block, and what they share with the
    block's vocabulary is written as numbers, which count the documents of each term and are then searched. A task builds trees over bounded
    chunks of its documents, keeps the best of each item, and skips pairs of nodes that cannot reach an item's weakest place; the bound is exact.

    Null texts have no terms. Rows are documents and items of their own, so repeated ones come repeatedly; a null doc_id comes last among
    equals. Items without terms and empty tables give no rows; other columns do not matter.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    id_type, item_type = given.schema["doc_id"].dataType.simpleString(), asked.schema["item_id"].dataType.simpleString()
    few = max(1, asked.count() // BLOCK_ITEMS)
    known = cut_lineage(asked.coalesce(few).mapInArrow(_item_terms, f"item_id {item_type}, block bigint, item bigint, terms array<string>"))
    found, stats = None, None
    for (block,) in known.select("block").distinct().orderBy("block").collect():         # one row per BLOCK_ITEMS items
        own, vocabulary = _block(known.where(F.col("block") == block).collect())
        words = spark.sparkContext.broadcast(vocabulary)
        schema = f"doc_id {id_type}, n bigint, terms binary, counts binary"
        entries = cut_lineage(given.mapInArrow(lambda batches, w=words: _entries(batches, w.value), schema))
        if stats is None:
            stats = tuple(entries.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first())
        size = own.size
        counted = entries.select("terms").mapInArrow(lambda batches, s=size: _document_counts(batches, s), "term bigint, df bigint")
        df = dict(map(tuple, counted.groupBy("term").agg(F.sum("df")).collect()))        # at most the block's terms
        weights = np.array([weight(stats[0], df.get(t, 0)) for t in range(size)], np.int64)
        sent = spark.sparkContext.broadcast((own, weights))
        searched = entries.mapInArrow(lambda batches, s=sent: _searched(batches, *s.value, *stats, top), f"item bigint, doc_id {id_type}, score bigint")
        found = searched if found is None else found.unionByName(searched)
    if found is None:
        return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type}, score bigint")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    near = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(*order)        # first the best of each part
    far = Window.partitionBy("item").orderBy(*order)
    best = found.withColumn("__near", F.row_number().over(near)).where(F.col("__near") <= top).drop("__near")
    ranked = best.withColumn("rank", F.row_number().over(far)).where(F.col("rank") <= top)
    return ranked.join(known.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
