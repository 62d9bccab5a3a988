"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017) over words and word beginnings."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenequarry.llm.common import byte_list, schema_of, sliced

POSITIVE_ROWS, UNLABELLED_ROWS = 3000, 9000    # bound of the sample of labelled rows that the fit reads
MIN_ROWS, MIN_SHARE = 4, 0.02                  # a word takes part if in so many and such a share of the positive rows,
MIN_Z, MIN_PURITY = 4.0, 0.4                   # its share there stands out, and such a part of all its rows must be positive
TEXTS_PER_ID = 16                              # texts of one sampled id in the fit, those of smallest hash; repeated rows count once
ROUNDS, BATCH, RATE, DECAY = 200, 1000, 0.05, 1e-4
THRESHOLD = 0.3
# A-Z as a-z; every other ASCII character but letters, digits and the apostrophe as a space.
PLAIN = bytes(c if c >= 128 or chr(c).isalnum() or c == 39 else 32 for c in range(256)).lower()


STEMS = (4, 5)                                 # bytes of the word beginnings that are features beside the words


def words_of(text: bytes) -> set[bytes]:
    """The text's words and the beginnings of longer ones, the latter with a star."""
    words = set(text.translate(PLAIN).split())
    return words.union(*({w[:n] + b"*" for w in words if len(w) > n} for n in STEMS))


@dataclass
class Model:
    weights: dict[bytes, float]
    bias: float

    def score(self, text: bytes) -> float:
        """Logistic score of the set of words; a text without known words has the score of the bias."""
        get = self.weights.get
        z = self.bias + sum(get(w, 0.0) for w in words_of(text))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never read: crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _matrix(positive: list[bytes], unlabelled: list[bytes], prior: float) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Words that tell the samples apart, and all texts as rows of word numbers: (words, row starts, numbers).

    A word is kept if MIN_SHARE of the positive rows have it, a share MIN_Z standard errors or more above that of the unlabelled,
    and if by the class prior MIN_PURITY of the unlabelled rows with it are positive.
    """
    n_p, n_u = len(positive), max(1, len(unlabelled))
    least = max(MIN_ROWS, MIN_SHARE * n_p)
    in_p = {w: p for w, p in Counter(w for t in positive for w in words_of(t)).items() if p >= least}
    in_u = Counter(w for t in unlabelled for w in words_of(t) & in_p.keys())
    words = []
    for w, p in in_p.items():
        rate = (in_u[w] + 1) / (n_u + 2)
        if p / n_p - rate >= MIN_Z * (rate * (1 - rate) / n_p) ** 0.5 and prior * p / n_p >= MIN_PURITY * rate:
            words.append(w)
    index = {w: i for i, w in enumerate(sorted(words))}
    numbers = [np.array(sorted(index[w] for w in words_of(t) & index.keys()), np.int32) for t in (*positive, *unlabelled)]
    return index, np.r_[0, np.cumsum([len(x) for x in numbers])], np.concatenate([*numbers, np.empty(0, np.int32)])


def non_negative_fit(positive: list[bytes], unlabelled: list[bytes], prior: float, seed: int = 7) -> Model:
    """A linear classifier that minimises the non-negative risk of positive and unlabelled texts.

    The risk is prior * R(positive as positive) + max(0, R(unlabelled as negative) - prior * R(positive as negative)), with the
    logistic loss. Where the bracket is negative the step goes up its gradient instead, so it cannot be driven below 0. In the end
    the bias is moved so that THRESHOLD parts about the prior's share of the unlabelled texts from the rest.
    """
    words, starts, numbers = _matrix(positive, unlabelled, prior)
    n_p, n_u, size = len(positive), len(unlabelled), len(words)
    random = np.random.default_rng(seed)
    weights, bias = np.zeros(size), 0.0
    means, squares, step = np.zeros(size + 1), np.zeros(size + 1), 0
    batches = max(1, n_u // BATCH)
    rounds = max(ROUNDS, 2 * ROUNDS * BATCH // max(1, n_u))
    for _ in range(rounds):
        for own_p, own_u in zip(np.array_split(random.permutation(n_p), batches), np.array_split(n_p + random.permutation(n_u), batches)):
            if not len(own_p) or not len(own_u):
                continue
            rows = np.r_[own_p, own_u]
            lengths = starts[rows + 1] - starts[rows]
            of = np.repeat(np.arange(len(rows)), lengths)
            at = numbers[np.repeat(starts[rows] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())]
            z = np.clip(bias + np.bincount(of, weights[at], len(rows)), -40, 40)
            s, p = 1 / (1 + np.exp(-z)), len(own_p)
            loss = np.log1p(np.exp(z))                          # as negative; as positive it is loss - z
            bracket = loss[p:].mean() - prior * loss[:p].mean()
            pull = np.r_[prior / p * (s[:p] - 1), np.zeros(len(own_u))]
            push = np.r_[-prior / p * s[:p], s[p:] / len(own_u)]
            toward = pull + push if bracket >= 0 else -push
            gradient = np.r_[np.bincount(at, toward[of], size) + DECAY * weights, toward.sum()]
            step += 1
            means = 0.9 * means + 0.1 * gradient
            squares = 0.999 * squares + 0.001 * gradient**2
            move = RATE * (means / (1 - 0.9**step)) / (np.sqrt(squares / (1 - 0.999**step)) + 1e-8)
            weights = np.maximum(weights - move[:-1], 0)        # a kept word speaks for the positive class or not at all
            bias -= move[-1]
    sums = np.add.reduceat(np.r_[weights[numbers], 0.0], starts[:-1]) * (np.diff(starts) > 0)
    return Model({w: float(weights[i]) for w, i in words.items()}, float(bias + _shift(bias + sums[n_p:], prior)))


def _shift(z: np.ndarray, prior: float) -> float:
    """What moves the widest gap among the unlabelled logits, where about the prior's share lies above it, to THRESHOLD."""
    values, counts = np.unique(z, return_counts=True)
    above = 1 - np.cumsum(counts)[:-1] / max(1, len(z))
    gaps = np.where((above >= 0.4 * prior) & (above <= 1.2 * prior), np.diff(values), 0)
    if not len(gaps) or not gaps.max():
        return 0.0
    at = int(gaps.argmax())
    return float(np.log(THRESHOLD / (1 - THRESHOLD)) - (values[at] + values[at + 1]) / 2)


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", texts_per_id: int = TEXTS_PER_ID,
) -> Model:
    """A model from the labelled rows that are not held out.

    The class prior is the share of toxic rows among all of them. The texts come from a bounded sample, the rows of
    smallest hash: POSITIVE_ROWS toxic ones, and UNLABELLED_ROWS of any kind whose labels are not looked at. Of an id with several
    texts the sample holds at most ``texts_per_id``, so what comes to the driver is bounded whatever an id's number of rows. Several labels
    of a document count as their largest; null labels and ids are left out. Without a toxic row every score is near 0.
    """
    known = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).alias("__id")).agg(F.max(F.col(toxic).cast("int")).alias("__toxic"))
    total, share = known.agg(F.count(F.lit(1)), F.avg("__toxic")).first()
    if not total or not share:
        return Model({}, -8.0)
    by_hash = F.xxhash64("__id", F.lit("sample"))
    toxic_rows = known.where("__toxic = 1").orderBy(by_hash, "__id").limit(POSITIVE_ROWS).select("__id", F.lit(True).alias("positive"))
    any_rows = known.orderBy(F.xxhash64("__id", F.lit("rest")), "__id").limit(UNLABELLED_ROWS).select("__id", F.lit(False).alias("positive"))
    sample = F.broadcast(toxic_rows.unionByName(any_rows))                     # at most POSITIVE_ROWS + UNLABELLED_ROWS rows
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(sample, "__id")

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):                                          # whole texts, reduced to their words
            sets = [b" ".join(sorted(set(t.translate(PLAIN).split()))) for t in byte_list(batch.columns[1])]
            yield pa.RecordBatch.from_arrays([batch.columns[0], batch.columns[2], pa.array(sets, pa.binary())], ["id", "positive", "words"])

    found = texts.mapInArrow(distinct_words, "id bigint, positive boolean, words binary").distinct()
    by_text = Window.partitionBy("id", "positive").orderBy(F.xxhash64("words"), "words")
    rows = found.withColumn("place", F.row_number().over(by_text)).where(F.col("place") <= texts_per_id).drop("place").toPandas()
    rows = rows.assign(words=rows["words"].map(bytes)).sort_values(["positive", "id", "words"])
    chosen = rows["positive"].astype(bool)
    if not chosen.any():
        return Model({}, -8.0)
    prior = min(max(float(share), 1e-3), 0.9)
    return non_negative_fit(rows.loc[chosen, "words"].tolist(), rows.loc[~chosen, "words"].tolist(), prior)


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with ``to``, 0 to 1, of the whole text; null counts as empty. A column of that name is replaced."""
    given = docs.select(*(c for c in docs.columns if c != to), F.col(text).alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)                     # words of the bounded sample

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            scores = [sent.value.score(t) for t in byte_list(batch.columns[-1])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*batch.schema.names[:-1], to])

    return given.mapInArrow(rate, schema_of(given.drop("__text"), f"`{to}` double"))


def verdicts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from THRESHOLD on).

    Empty and null texts have the score of the bias alone. Repeated rows score alike, a null id is not held out, an empty
    table gives an empty one; only the text decides the score.
    """
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rated = score(ids, fit(docs, labels, doc_id, text)).drop("text")
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows scored THRESHOLD or more; same columns."""
    return score(docs, fit(docs, labels, doc_id, text), text, "__score").where(F.col("__score") < THRESHOLD).select(*docs.columns)
