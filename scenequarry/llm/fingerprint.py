"""Document fingerprints: homomorphic multiset hashes of paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenequarry.llm.common import ordered, whole
from scenequarry.session import cut_lineage

SIGNS = 64             # lanes of +1 and -1: their sums tell how much two multisets share
SUMS = 4               # lanes of uniform 32-bit numbers: their sums tell multisets apart
LANE_BITS = 32         # all lanes are kept modulo 2^32

# A paragraph ends with its line or sentence, or after a word of eight letters or more, so that texts of a single line have several.
PARAGRAPH_END = r"(?<=[.!?;:,\n])\s*|(?<=\p{L}{8})\s+|\n+"


def _wrapped(lane: Column) -> Column:
    """The lane modulo 2^LANE_BITS, as a signed int."""
    half = 1 << (LANE_BITS - 1)
    return ((lane + half).bitwiseAND((1 << LANE_BITS) - 1) - half).cast("int")


def lanes(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """``key`` and ``lanes``: per key the vectors of the texts' paragraphs summed up, an array of SIGNS + SUMS ints.

    Order does not matter, and the vectors of inserted or deleted paragraphs may be added or subtracted (``combine``). Each
    paragraph gives 64 signs from one hash, two to a sum of longs (32 bits apart), and SUMS numbers from two more. A text without
    paragraphs has all lanes 0.
    """
    each = texts.select(*key, F.explode(F.split(F.col(text), PARAGRAPH_END)).alias("__p")).withColumn("__p", F.trim("__p"))
    each = each.select(
        *key, (F.col("__p") != "").alias("__is"), F.xxhash64("__p").alias("__h"), F.xxhash64(F.lit(1), "__p").alias("__a"), F.xxhash64(F.lit(2), "__p").alias("__b"),
    )
    low, pair, half = (1 << 32) - 1, (1 << 32) + 1, SIGNS // 2

    def total(value: Column, name: str) -> Column:
        return F.sum(F.when(F.col("__is"), value).otherwise(0)).alias(name)

    sums = each.groupBy(*key).agg(
        F.count_if("__is").alias("__n"),
        *(total(F.shiftrightunsigned("__h", j).bitwiseAND(pair), f"__s{j}") for j in range(half)),
        total(F.col("__a").bitwiseAND(low), "__u0"), total(F.shiftrightunsigned("__a", 32), "__u1"),
        total(F.col("__b").bitwiseAND(low), "__u2"), total(F.shiftrightunsigned("__b", 32), "__u3"),
    )
    ones = [F.col(f"__s{j}").bitwiseAND(low) for j in range(half)] + [F.shiftrightunsigned(f"__s{j}", 32) for j in range(half)]
    signs = [_wrapped(2 * c - F.col("__n")) for c in ones]
    return sums.select(*key, F.array(*signs, *(_wrapped(F.col(f"__u{j}")) for j in range(SUMS))).alias("lanes"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of two multisets together, or with ``sign`` -1 of the first without the second."""
    both = F.zip_with(a, b, lambda x, y: x.cast("long") + sign * y.cast("long"))
    return F.transform(both, _wrapped)


def as_text(vector: Column) -> Column:
    """The fingerprint: all lanes in lowercase hex digits, as many as their bits need."""
    digits = F.transform(vector, lambda x: F.lower(F.hex(x.cast("long").bitwiseAND((1 << LANE_BITS) - 1))))
    return F.array_join(F.transform(digits, lambda x: F.lpad(x, LANE_BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the cosine of the sign lanes, which estimates that of the paragraph counts; 1 exactly for equal fingerprints."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(F.slice(x, 1, SIGNS), F.slice(y, 1, SIGNS), lambda s, t: s.cast("double") * t.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(a == b, 1.0).when(size == 0, 0.0).otherwise(F.least(F.greatest(dot(a, b) / size, F.lit(0.0)), F.lit(1.0)))


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n / 2) characters replaced by the first as many of the next document's, in ascending
    doc_id; after the last comes the first. Null counts as empty. Null ids come first. Rows of one id are ordered by a hash of
    their text. Fully repeated rows are one document in this order, and each of them gets its row. A single document is
    its own next. Other columns do not matter; an empty table gives an empty one.
    """
    # (known, id, tie) is a row's key, without nulls
    key, prev = ["known", "id", "tie"], ["prev_known", "prev_id", "prev_tie"]
    given = docs.select(F.col(doc_id).alias("id"), whole(text).alias("text"))
    keyed = given.select(
        F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0).cast(given.schema["id"].dataType)).alias("id"),
        F.xxhash64("text").alias("tie"), "text",
    )
    heads = keyed.groupBy(*key).agg(F.max(F.length("text")).cast("long").alias("n"), F.count(F.lit(1)).alias("rows"))
    placed = cut_lineage(ordered(heads, *key, at="place"))
    last = placed.agg(F.max("place")).first()[0] or 0
    before = placed.select(*(F.col(k).alias(f"prev_{k}") for k in key), F.col("n").alias("prev_n"), F.when(F.col("place") < last, F.col("place") + 1).otherwise(0).alias("place"))
    chain = cut_lineage(placed.select("place", *key).join(before, "place").drop("place"))     # each document and the one before it

    first = F.lag(F.lit(1)).over(Window.partitionBy(*key).orderBy(*key)).isNull()
    texts = keyed.repartition(*key).withColumn("first", first).where("first").drop("first")
    head = F.substring("text", F.lit(1), F.floor(F.col("prev_n") / 2).cast("int"))
    heads = texts.join(chain, key).select(*(F.col(p).alias(k) for p, k in zip(prev, key)), head.alias("head"))
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.col("head"))
    both = texts.join(heads, key).select(*key, "text", edited.alias("edited"))
    both = both.select(*key, F.sha2("edited", 256).alias("sha"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("e"))
    found = cut_lineage(lanes(both.select(*key, "sha", "e.kind", "e.t"), [*key, "sha", "kind"], "t"))

    own = found.where("kind = 0").select(*key, "sha", F.col("lanes").alias("own"))
    new = found.where("kind = 1").select(*key, F.col("lanes").alias("new"))
    after = own.join(chain, key).select(*(F.col(p).alias(k) for p, k in zip(prev, key)), F.col("own").alias("next"))
    joined = own.join(new, key).join(after, key).join(placed.select(*key, "n", "rows"), key)
    rows = joined.withColumn("row", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))))
    return rows.select(
        F.when(F.col("known"), F.col("id")).alias("doc_id"), F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
