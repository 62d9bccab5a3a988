"""Phrase collocation mining: contiguous phrases counted by top-order marginalisation and scored at their weakest cut."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenequarry.llm.common import bounded, byte_list
from scenequarry.operators.joins import join_small
from scenequarry.session import cut_lineage

# What ends a piece; a space and a tab separate words.
ENDS = b".,;:!?\x0A\x0B\x0C\x0D"
FOLD = bytes.maketrans(bytes(range(65, 91)) + ENDS + b"\t", bytes(range(97, 123)) + b"." * len(ENDS) + b" ")
END = b"."                        # stands between pieces, as no word holds it

NO_LANG = "und"
BUCKET = 1 << 15                  # bits of a row of Spark's bitmaps
MOST_BITS = 1 << 27               # 16 MiB: the filter's bound; beyond it lets more through, with the same result
BITS_PER_KEY = 64
MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(text: bytes) -> list[bytes]:
    """The words of a text in lower case, with END between pieces."""
    return text.translate(FOLD).replace(END, b" . ").split()


@dataclass
class Words:
    """The texts of one language in a slice: END stands after each text and piece."""

    lang: str
    coded: pa.DictionaryArray

    def hashes(self) -> np.ndarray:
        """Of the distinct words, with the language."""
        seed = xxhash.xxh64_intdigest(self.lang.encode())
        found = (xxhash.xxh64_intdigest(w, seed) for w in self.coded.dictionary.to_pylist())
        return np.fromiter(found, np.uint64, len(self.coded.dictionary))

    def at(self) -> np.ndarray:
        """The number of the distinct word at each place."""
        return self.coded.indices.to_numpy()

    def ends(self) -> np.ndarray:
        """Which of the distinct words is END."""
        return pc.equal(self.coded.dictionary, END).to_numpy(zero_copy_only=False)


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in bounded(batches, 1):
        words = defaultdict(list)
        for lang, text in zip(batch.column(0).to_pylist(), byte_list(batch.column(1))):
            words[lang].extend(tokens_of(text))
            words[lang].append(END)
        for lang, own in words.items():
            yield Words(lang, pa.array(own, pa.binary()).dictionary_encode())


def _pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left * MIX) ^ right) * MIX


def _passing(hashes: np.ndarray, packed: np.ndarray) -> np.ndarray:
    spot = hashes & np.uint64(8 * len(packed) - 1)
    return (packed[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, lang, n): per slice its words by hash, and all words of a language under no key."""
    for words in _by_lang(batches):
        some = ~words.ends()
        counts = np.bincount(words.at(), minlength=len(some))[some]
        keys = pa.concat_arrays([pa.array(words.hashes()[some].view(np.int64)), pa.nulls(1, pa.int64())])
        langs = pa.concat_arrays([pa.nulls(len(counts), pa.string()), pa.array([words.lang])])
        yield pa.RecordBatch.from_arrays([keys, langs, pa.array(np.r_[counts, counts.sum()].astype(np.int64))], ["key", "lang", "n"])


def _paired(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, n): per slice the pairs of neighbours that may both be frequent, by hash."""
    for words in _by_lang(batches):
        hashes = words.hashes()
        good = (_passing(hashes, frequent) & ~words.ends())[words.at()]
        left = np.flatnonzero(good[:-1] & good[1:])
        at = hashes[words.at()]
        keys, counts = np.unique(_pair_hashes(at[left], at[left + 1]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["key", "n"])


def _filter_of(counts: DataFrame) -> np.ndarray:
    """Bits of a filter that every key of the table passes; bounded, whatever their number."""
    bits = BUCKET
    while bits < min(MOST_BITS, BITS_PER_KEY * counts.count()):
        bits *= 2
    spot = F.col("key").bitwiseAND(bits - 1) + 1                         # Spark's bitmaps count from 1
    rows = counts.select(F.bitmap_bucket_number(spot).alias("b"), F.bitmap_bit_position(spot).alias("p"))
    found = np.zeros(bits // 8, np.uint8)
    for b, bitmap in rows.groupBy("b").agg(F.bitmap_construct_agg("p")).collect():       # rows are BUCKET bits: MOST_BITS in all
        found[(b - 1) * (BUCKET // 8) : b * (BUCKET // 8)] = np.frombuffer(bitmap, np.uint8)
    return np.unpackbits(found, bitorder="little").astype(bool)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Eight bits to a byte, as a filter is sent to the tasks."""
    return np.packbits(bits, bitorder="little")


def _windows(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, pairs: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """(lang, w1, .., n): the window of ``width`` words from every frequent word, padded from the piece's end or the first rare word or pair on.

    No phrase with a rare word or pair is frequent, so what is padded away counts for none. Equal windows of a slice are one row.
    """
    names = ["lang", *(f"w{k}" for k in range(1, width + 1)), "n"]
    for words in _by_lang(batches):
        hashes = words.hashes()
        good = _passing(hashes, frequent) & ~words.ends()
        if not good.any():
            continue
        places = words.at()
        number = np.where(good, np.cumsum(good), 0)                      # 0 pads
        own = pa.concat_arrays([pa.array([b""], pa.binary()), words.coded.dictionary.filter(pa.array(good))]).cast(pa.string())
        joined = np.r_[_passing(_pair_hashes(hashes[places[:-1]], hashes[places[1:]]), pairs), np.zeros(width, bool)]
        ids = np.r_[number[places], np.zeros(width, np.int64)]
        at = np.flatnonzero(ids)
        columns = [ids[at]]
        for k in range(1, width):
            columns.append(np.where((columns[-1] > 0) & joined[at + k - 1], ids[at + k], 0))
        key = columns[0]
        for column in columns[1:]:                                       # exact: equal beginnings are numbered anew after each word
            key = np.unique(key * len(own) + column, return_inverse=True)[1]
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        made = [own.take(pa.array(column[first])) for column in columns]
        yield pa.RecordBatch.from_arrays([pa.array([words.lang] * len(first), pa.string()), *made, pa.array(counts.astype(np.int64))], names)


def phrase_counts(docs: DataFrame, min_count: int, max_words: int, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of up to ``max_words`` words found ``min_count`` times or more, and (lang, n).

    Only the longest windows are counted; ROLLUP sums the shorter phrases from them, as every occurrence of a phrase begins one window.
    """
    context = docs.sparkSession.sparkContext
    given = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text).alias("text"))
    counted = given.mapInArrow(_counted, "key bigint, lang string, n bigint").groupBy("key", "lang").agg(F.sum("n").alias("n"))
    words = cut_lineage(counted.where(F.col("key").isNull() | (F.col("n") >= min_count)))
    frequent = context.broadcast(_packed(_filter_of(words.where("key IS NOT NULL"))))
    paired = given.mapInArrow(lambda batches: _paired(batches, frequent.value), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    pairs = context.broadcast(_packed(_filter_of(cut_lineage(paired.where(F.col("n") >= min_count)))))
    leads = [f"w{k}" for k in range(1, max_words + 1)]
    schema = f"lang string, {', '.join(f'{w} string' for w in leads)}, n bigint"
    windows = given.mapInArrow(lambda batches: _windows(batches, frequent.value, pairs.value, max_words), schema)
    summed = windows.rollup("lang", *leads).agg(F.sum("n").alias("f"))
    last = F.coalesce(*reversed(leads))                                  # of the columns a row is grouped by; a pad is no phrase
    size = sum(F.col(w).isNotNull().cast("int") for w in leads)
    phrases = summed.where((F.col("f") >= min_count) & (last != "")).select("lang", F.concat_ws(" ", *leads).alias("phrase"), size.alias("size"), "f")
    return cut_lineage(phrases), words.where("key IS NULL").select("lang", "n")


def _part(words: Column, start: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(docs: DataFrame, min_count: int = 100, top: int = 2000, max_words: int = 5, scale: int = 1000, text: str = "text", lang: str = "lang") -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``max_words`` words: lang, rank, phrase, a, l, r, n, score.

    a counts the phrase, n all words of the language, l and r the two parts at the cut of the lowest score floor(scale * a * n / (l * r)), the first
    such cut at ties. Products are decimals of 38 digits, so exact. A phrase that lies in a longer candidate found as often is dropped.
    Ranks go by score, a (both descending) and phrase in byte order.

    Null texts are empty, a null language is ``und`` (together with rows so marked); repeated rows count again, ids and other columns do not
    matter, and a table without phrases gives none. Windows end at words and pairs of words that are rare, by two filters over hashes of a bounded size:
    they let some rare ones through, never keep a frequent one out, and so change no result.
    """
    phrases, totals = phrase_counts(docs, min_count, max_words, text, lang)
    words = F.split("phrase", " ")
    longer = phrases.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"))

    cuts = longer.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("left", _part(words, 1, F.col("cut"))).withColumn("right", _part(words, F.col("cut") + 1, F.col("size") - F.col("cut")))
    parts = phrases.where(F.col("size") < max_words).select("lang", "phrase", "f")
    rated = join_small(cuts, parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    rated = join_small(rated, parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    rated = join_small(rated, totals, ["lang"])
    exact = [f"CAST({c} AS DECIMAL(19, 0))" for c in ("a", "n", "l", "r")]
    score = F.expr(f"CAST({scale} AS DECIMAL(4, 0)) * CAST({exact[0]} * {exact[1]} AS DECIMAL(34, 0)) div CAST({exact[2]} * {exact[3]} AS DECIMAL(38, 0))")
    weakest = rated.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "n", "a", "size")).alias("__w"))
    weakest = weakest.select("lang", "phrase", "__w.*")

    spans = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda s: F.transform(F.sequence(F.lit(1), F.col("size") - s + 1), lambda i: _part(words, i, s)))))
    inner = longer.where("size > 2").select("lang", spans.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    # a merge: both are dealt out by these columns, and Spark sizes the spans too low
    alone = weakest.join(inner.hint("merge"), ["lang", "phrase"], "left").where("held IS NULL OR 100 * held < 100 * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = alone.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
