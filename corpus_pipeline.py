"""The corpus pipeline: clean documents, without copies and near copies, mixed to target weights and encoded."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scenequarry.llm import byte_bpe, exact_dedup, mixing, simhash, toxicity
from scenequarry.llm.common import table
from scenequarry.llm.queries import BPE_FILE
from scenequarry.session import checkpoint_folder

# The toxicity classifier and SimHash have no SQL form; tests compare run() with a brute-force version instead.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; empty and null texts are clean."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts equal but for white space: the longest, then the smallest doc_id."""
    return exact_dedup.drop_copies(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by near fingerprints: the smallest doc_id."""
    return simhash.drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; documents taken twice are two rows."""
    return mixing.emitted(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns without the text, with token_ids, their number and the digests of ids and decoded bytes."""
    return byte_bpe.digests(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [("toxicity", clean), ("exact dedup", distinct), ("near dedup", unlike), ("mixing", mixture), ("byte-level BPE", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = f"{checkpoint_folder(spark)}/stage-{uuid.uuid4()}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
