"""Quality rules: words, symbols and repeats of a text, and how well public vocabularies fit it (fertility), judged by bands per language."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenequarry.llm.byte_bpe import ranks_of
from scenequarry.llm.common import bounded, byte_list, schema_of
from scenequarry.operators.joins import join_small
from scenequarry.session import cut_lineage

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 5                   # words
MIN_WORDS, REPEAT_PERCENT = 10, 20

CACHED = 1 << 17                    # words whose pieces a task remembers
CONTINUATION = bytes(range(0x80, 0xC0))     # bytes of UTF-8 that begin no character

# Measures: bins per unit for the quartiles, and whether too low and too high are rejected. Values are bounded by the vocabulary.
MEASURES = {"chars_per_token": (64, True, True), "byte_chars_per_token": (64, True, True), "byte_share": (256, False, True), "token_entropy": (64, True, True)}
FENCE = 3.0                         # quartile distances beyond the quartiles
MIN_GROUP = 200                     # documents a band is taken from

# First code points of the scripts told apart, in ascending order.
SCRIPTS = [
    (0x0000, "other"), (0x0041, "latin"), (0x005B, "other"), (0x0061, "latin"), (0x007B, "other"), (0x00C0, "latin"), (0x0250, "other"), (0x0370, "greek"),
    (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"),
]
NAMES = sorted({name for _, name in SCRIPTS})
EDGES, CODES = np.array([first for first, _ in SCRIPTS]), np.array([NAMES.index(name) for _, name in SCRIPTS])


class Vocabularies:
    """The vocabularies of a worker, and the tokens of words it met before."""

    def __init__(self, pieces: str, ranks: str, pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.ranks = tiktoken.Encoding("fertility", pat_str=pattern, mergeable_ranks=ranks_of(ranks), special_tokens={})
        self.fallback = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())])
        self.known: dict[bytes, tuple[bytes, int]] = {}

    def tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words: piece ids one after the other, their number per word, and the number of byte-level tokens per word."""
        if len(self.known) > CACHED:
            self.known = {}
        new = [w for w in words if w not in self.known]
        texts = [w.decode("utf-8", "replace") for w in new]
        for word, text, ids in zip(new, texts, self.pieces.encode(texts, num_threads=1)):
            self.known[word] = np.array(ids, "<i4").tobytes(), len(self.ranks.encode_ordinary(" " + text))
        found = [self.known[w] for w in words]
        sizes = np.fromiter((len(ids) // 4 for ids, _ in found), np.int64, len(found))
        return np.frombuffer(b"".join(ids for ids, _ in found), "<i4"), sizes, np.fromiter((n for _, n in found), np.int64, len(found))


@lru_cache(maxsize=2)
def vocabularies(pieces: str, ranks: str, pattern: str) -> Vocabularies:
    """One per worker process."""
    return Vocabularies(pieces, ranks, pattern)


def repeated_words(words: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Per text the words covered by windows whose words, as numbers, stand in the text twice or more."""
    n = len(words) - REPEAT_WINDOW + 1
    if n < 1:
        return np.zeros(n_docs, np.int64)
    same = doc[:n] == doc[REPEAT_WINDOW - 1 :]
    key = words[:n].astype(np.int64)
    for k in range(1, REPEAT_WINDOW):           # exact: equal keys are numbered anew after each word
        key = np.unique(key * (int(words.max()) + 1) + words[k : k + n], return_inverse=True)[1]
    at = np.flatnonzero(same)                   # windows over two texts are none
    _, back, counts = np.unique(key[at] * n_docs + doc[at], return_inverse=True, return_counts=True)
    starts = at[counts[back] > 1]
    change = np.zeros(len(words) + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + REPEAT_WINDOW, -1)
    return np.bincount(doc, np.cumsum(change)[:-1] > 0, n_docs).astype(np.int64)


def script_of(text: bytes) -> str:
    """The script of most characters; other where no letter decides. Ties go to the first name."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    counts = np.bincount(CODES[np.searchsorted(EDGES, points, "right") - 1], minlength=len(NAMES))
    counts[NAMES.index("other")] = 0
    return NAMES[int(counts.argmax())] if counts.any() else "other"


def measured(texts: list[bytes], scripts: list[str | None], known: Vocabularies) -> list[pa.Array]:
    """The columns of MADE for the texts; where a script or language is given it is kept."""
    split = [t.split() for t in texts]
    n_words = np.fromiter(map(len, split), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts)), n_words)
    coded = pa.array([w for some in split for w in some], pa.binary()).dictionary_encode()
    words, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    chars = np.fromiter((len(w.translate(None, CONTINUATION)) for w in distinct), np.int64, len(distinct))
    word_chars = np.bincount(doc, chars[words], len(texts)).astype(np.int64)
    symbols = [len(t) - len(t.translate(None, SYMBOLS)) for t in texts]
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]

    ids, sizes, byte_sizes = known.tokens(distinct)
    each = sizes[words]                                     # pieces of every word, in the order of the texts
    starts = (np.cumsum(sizes) - sizes)[words]
    total = int(each.sum())
    pieces = ids[np.repeat(starts - (np.cumsum(each) - each), each) + np.arange(total)]
    owner = np.repeat(doc, each)
    n_tokens, n_byte_tokens = (np.bincount(doc, x, len(texts)) for x in (each, byte_sizes[words]))
    fallback = np.bincount(owner, known.fallback[pieces], len(texts))
    pairs, counts = np.unique(owner * len(known.fallback) + pieces, return_counts=True)
    own = pairs // len(known.fallback)
    entropy = np.bincount(own, -counts / n_tokens[own] * np.log2(counts / n_tokens[own]), len(texts))
    some = np.maximum(n_tokens, 1)
    made = [n_words, word_chars, symbols, [len(x) - len(set(x)) for x in lines], repeated_words(words, doc, len(texts)), n_tokens.astype(np.int64)]
    rates = [word_chars / some, word_chars / np.maximum(n_byte_tokens, 1), fallback / some, np.abs(entropy)]
    groups = [s if s is not None else script_of(t) for s, t in zip(scripts, texts)]
    return [*(pa.array(x, pa.int64()) for x in made), *(pa.array(x, pa.float64()) for x in rates), pa.array(groups, pa.string())]


MADE = [
    *(f"{n} bigint" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")),
    *(f"{n} double" for n in MEASURES), "language string",
]


def measure(docs: DataFrame, pieces: str, ranks: str, pattern: str, text: str = "text", lang: str | None = "lang", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_tokens, the MEASURES and language.

    ``pieces`` is a sentencepiece model with byte fallback, ``ranks`` a file of byte-level ranks with ``pattern``. Words are tokenised one by one, each
    distinct word of a task once. ``language`` is the column ``lang``, or the script of most letters where it is null (or no such column is named).
    Null counts as empty; a text without words has no tokens and measures of 0. Repeated rows and null ids are rows of their own, an empty table
    gives an empty one, and kept columns that are named like a made one are replaced (by ``judge`` too).
    """
    made = [m.split()[0] for m in MADE]
    keep = [c for c in keep if c not in made]
    group = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    given = docs.select(*keep, F.col(text).alias("__text"), group.alias("__group"))
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabularies(pieces, ranks, pattern)
        for batch in bounded(batches, at):
            new = measured(byte_list(batch.column(at)), batch.column(at + 1).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *new], [*keep, *made])

    return given.mapInArrow(run, schema_of(docs.select(*keep), *MADE))


def size_class() -> Column:
    """Texts of like length, by the power of two up to the number of words (what a vocabulary does not change): short texts stray more."""
    return F.length(F.bin(F.greatest(F.col("n_words"), F.lit(1))))


def bands(rows: DataFrame, fence: float = FENCE, min_group: int = MIN_GROUP) -> DataFrame:
    """(language, size_class, <measure>_low, <measure>_high) of measured rows that pass the base rules.

    Quartiles are exact over counts in bins of fixed width, so no group's values are gathered. A band reaches ``fence`` quartile distances
    (a bin more, for measures that hardly vary) beyond the quartiles. Groups of fewer than ``min_group`` rows get no band.
    """
    binned = rows.where(~failed()).select("language", size_class().alias("size_class"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.floor(F.col(m) * scale).alias("bin")) for m, (scale, *_) in MEASURES.items()
    ])).alias("__m")).select("language", "size_class", "__m.*")
    counts = binned.groupBy("language", "size_class", "measure", "bin").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("language", "size_class", "measure")      # as many rows as bins
    running = counts.withColumn("total", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(group.orderBy("bin")))

    def quartile(k: int) -> Column:
        return F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("bin")))

    found = running.groupBy("language", "size_class", "measure").agg(F.max("total").alias("total"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    reach = (F.col("q3") - F.col("q1") + 1) * F.lit(fence)
    sides = []
    for m, (scale, low, high) in MEASURES.items():
        own = F.col("measure") == m
        sides += [F.max(F.when(own & F.lit(low), (F.col("q1") - reach) / scale)).alias(f"{m}_low"), F.max(F.when(own & F.lit(high), (F.col("q3") + 1 + reach) / scale)).alias(f"{m}_high")]
    return found.where(F.col("total") >= min_group).groupBy("language", "size_class").agg(*sides)


def failed() -> Column:
    """The base rules: too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def judge(
    docs: DataFrame, pieces: str, ranks: str, pattern: str, text: str = "text", lang: str | None = "lang", keep: Sequence[str] = ("doc_id",), given: DataFrame | None = None,
) -> DataFrame:
    """``measure`` with base_failed and kept: false where the base rules fail or a measure lies outside the band of the text's language and length.

    Bands come from all documents (or ``given``, a table like that of ``bands``); a group without band rejects nothing.
    Texts and tokens are read once; the measures are written and read again for the bands.
    """
    rows = cut_lineage(measure(docs, pieces, ranks, pattern, text, lang, [c for c in keep if c not in ("base_failed", "kept")]))
    limits = given if given is not None else bands(rows)
    sides = [c for c in limits.columns if c not in ("language", "size_class")]
    limits = limits.select("language", F.col("size_class").alias("__class"), F.struct(*sides).alias("__band"))
    joined = join_small(rows.withColumn("__class", size_class()), limits, ["language", "__class"], "left")
    inside = F.lit(True)
    for m in MEASURES:
        low, high = (F.coalesce(F.col("__band")[f"{m}_{side}"], F.col(m)) for side in ("low", "high"))
        inside = inside & F.col(m).between(low, high)
    return joined.select(*rows.columns, failed().alias("base_failed"), (~failed() & inside).alias("kept"))
