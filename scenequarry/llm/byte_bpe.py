"""Byte-level BPE encoding of texts cut into overlapping chunks, and decoding."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenequarry.llm.common import schema_of, sliced, whole

CHUNK, OVERLAP = 16384, 512    # characters
MARGIN = 4                     # a cut this near the end of a chunk may depend on what follows it
CACHED = 1 << 17               # pieces whose ids a task remembers


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """The ranks of a vocabulary file, and the ids of pieces that were merged before."""

    def __init__(self, path: str, pattern: str):
        self.pattern = regex.compile(pattern)
        # merges the bytes of one pre-token; the texts are cut by this module
        self.merger = tiktoken.Encoding("pieces", pat_str="(?s:.+)", mergeable_ranks=ranks_of(path), special_tokens={})
        self.known: dict[str, bytes] = {}

    def encode(self, pieces: list[str]) -> bytes:
        """Ids of the pieces in order, as little-endian unsigned 32-bit integers."""
        if len(self.known) > CACHED:
            self.known = {}
        known = self.known
        for piece in set(pieces).difference(known):
            known[piece] = np.array(self.merger.encode_ordinary(piece), "<u4").tobytes()
        return b"".join(map(known.__getitem__, pieces))


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One per worker process."""
    return Vocabulary(path, pattern)


@lru_cache(maxsize=2)
def tokens_of(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in ranks_of(path).items()}


def chunks_of(text: str) -> Iterator[str]:
    """Chunks of CHUNK characters, each with the OVERLAP characters that follow it."""
    for at in range(0, max(len(text), 1), CHUNK):
        yield text[at : at + CHUNK + OVERLAP]


def cuts_of(pattern: regex.Pattern, chunk: str, last: bool) -> np.ndarray:
    """Ends of the chunk's pre-tokens that nothing behind the chunk can change."""
    ends = np.fromiter((m.end() for m in pattern.finditer(chunk)), np.int32)
    return ends if last else ends[ends <= len(chunk) - MARGIN]


def stitched(pattern: regex.Pattern, text: str, cuts: list[np.ndarray]) -> list[str]:
    """The pre-tokens of the whole text from the cuts of its chunks.

    A match depends only on what follows it, so two chunks that share a cut agree from there on. The cuts of a chunk hold until
    the first one in the overlap that the next chunk has too; where there is none, matching goes on over the text from the
    last cut that holds until it is in step with a later chunk.
    """
    ends, at = [0], 0
    starts = [np.r_[0, own].astype(np.int64) + k * CHUNK for k, own in enumerate(cuts)]
    for k, own in enumerate(starts):
        last = k + 1 == len(starts)
        stop = len(text) if last else (k + 1) * CHUNK
        while at < stop:
            i = np.searchsorted(own, at)
            run = own[i + 1 :] if i < len(own) and own[i] == at else own[:0]
            if len(run) and not last:
                shared = run[(run >= stop) & np.isin(run, starts[k + 1])]
                run = run[: np.searchsorted(run, shared[0]) + 1] if len(shared) else run
            if not len(run):
                run = np.array([pattern.match(text, at).end()])
            ends.extend(run.tolist())
            at = ends[-1]
    return [text[a:b] for a, b in zip(ends, ends[1:])]


def joined_tokens(path: str, ids: list[bytes | None]) -> pa.Array:
    token = tokens_of(path).__getitem__
    return pa.array([b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())) for x in ids], pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """The columns of ``docs`` but the text, and ``ids``: its token ids as little-endian unsigned 32-bit integers.

    With ``decoded`` the ids are decoded again by the same worker, into a column of that name.

    Texts of up to CHUNK characters are encoded where they lie. Longer ones are cut into overlapping chunks, the
    chunks are dealt out and pre-tokenised in parallel, and the chunks of a text meet again to be stitched and encoded: no
    more than one text is in a group. A null text is empty and has no ids; special tokens are plain text. Repeated
    rows and null keys are rows of their own. A column named like ``ids`` is replaced.
    """
    keep = [c for c in docs.columns if c not in (text, ids, decoded)]
    made = [ids, *([decoded] if decoded else [])]
    given = docs.select(*keep, whole(text).alias("__text"))
    out = schema_of(given.drop("__text"), *(f"`{c}` binary" for c in made))

    def with_ids(batch: pa.RecordBatch, coded: list[bytes]) -> pa.RecordBatch:
        more = [joined_tokens(path, coded)] if decoded else []
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(coded, pa.binary()), *more], [*keep, *made])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in sliced(batches):
            yield with_ids(batch, [words.encode(words.pattern.findall(t)) for t in batch.columns[-1].to_pylist()])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.columns[-1].to_pylist()):
                pieces = list(chunks_of(text))
                n = len(pieces)
                same = batch.slice(row, 1).take(pa.array([0] * n)).columns[:-1]
                made = [pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32()), pa.array(pieces, pa.string())]
                yield pa.RecordBatch.from_arrays([*same, *made], [*keep, "__key", "__k", "__n", "__chunk"])

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = regex.compile(pattern)
        for batch in sliced(batches):
            *same, k, n, chunk = batch.columns
            texts = chunk.to_pylist()
            cuts = [cuts_of(rule, t, i + 1 == m).tobytes() for t, i, m in zip(texts, k.to_pylist(), n.to_pylist())]
            made = [k, pa.array([t[:CHUNK] for t in texts], pa.string()), pa.array(cuts, pa.binary())]
            yield pa.RecordBatch.from_arrays([*same, *made], [*keep, "__key", "__k", "__chunk", "__cuts"])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in sliced(batches):
            coded = []
            for parts in batch.columns[-1].to_pylist():
                cuts = [np.frombuffer(p["cuts"], np.int32) for p in parts]
                coded.append(words.encode(stitched(words.pattern, "".join(p["chunk"] for p in parts), cuts)))
            yield with_ids(batch, coded)

    long_text = F.length("__text") > CHUNK
    near = given.where(~long_text).mapInArrow(short, out)
    far = given.where(long_text).withColumn("__key", F.monotonically_increasing_id()).select(*keep, "__key", "__text")
    base = schema_of(far.drop("__text"))
    chunks = far.mapInArrow(cut, f"{base}, __k int, __n int, __chunk string")
    dealt = chunks.repartition("__key", "__k").mapInArrow(pretokenise, f"{base}, __k int, __chunk string, __cuts binary")
    parts = F.array_sort(F.collect_list(F.struct(F.col("__k").alias("k"), F.col("__chunk").alias("chunk"), F.col("__cuts").alias("cuts"))))
    again = dealt.groupBy("__key").agg(F.min_by(F.struct("__k", *keep), "__k").alias("__row"), parts.alias("__parts"))
    joined = again.select(*(F.col("__row")[c].alias(c) for c in keep), "__parts")
    return near.unionByName(joined.mapInArrow(stitch, out))


def decode(coded: DataFrame, path: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """``coded`` with ``to``: the bytes of its ids in order, joined raw; ids that cut a character are fine. Null ids are none."""
    names = [c for c in coded.columns if c != to]
    at = names.index(ids)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, joined_tokens(path, batch.column(at).to_pylist())], [*names, to])

    given = coded.select(*names)
    return given.mapInArrow(join, schema_of(given, f"`{to}` binary"))


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """The columns of ``docs`` but the text, with n_tokens, ids_sha256 and decoded_sha256 (lowercase hex), from ids and decoded bytes.

    With ``keep_ids`` the ids themselves are a column token_ids before them.
    """
    made = ("n_tokens", "ids_sha256", "decoded_sha256")
    coded = encode(docs.select(*(c for c in docs.columns if c not in made)), path, pattern, text, decoded="decoded")
    return coded.select(
        *(c for c in coded.columns if c not in ("token_ids", "decoded")), *(["token_ids"] if keep_ids else []),
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
