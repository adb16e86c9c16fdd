"""From raw documents to packed training windows: language, exact copies, near copies, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landsieve.llm.exact_dedup import ExactDedup
from landsieve.llm.language_id import LanguageId
from landsieve.llm.packing import Packing
from landsieve.llm.simhash import SimHashDedup
from landsieve.llm.store import Store


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without a letter, or without a likely language, go."""
    return LanguageId().keep(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for blanks stays."""
    return ExactDedup().deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash links stays."""
    return SimHashDedup().deduplicate(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in windows of 2048 tokens."""
    operator = Packing(public_tokenizers.path("word_bpe_49k.json"))
    pieces = operator.pieces(docs, ids=False)
    return operator.pack(pieces).select(F.col("row_id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language), ("exact_dedup", exact), ("simhash_dedup", near), ("packing", packed),
]

#: Language models, fingerprints and tokenizers have no SQL; tests compare the rows with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.write(stage(spark, docs, sf_dir), name)
    return docs
