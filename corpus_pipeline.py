"""Corpus pipeline: language ID, exact dedup, near-dedup, mixing and packing of the documents table.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns the columns of documents; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callscope.llm import exact_dedup, language_id, mixing, near_dedup, packing
from callscope.runtime import remove, spill_to


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go."""
    return language_id.reject_unknown(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.dedup(docs)


#: Near copies have a Jaccard index of at least 0.8 (near_dedup.LIKE) of their shingles of so many words.
NEAR_WORDS = 5


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the row with the smallest doc_id stays."""
    return near_dedup.keep_one(docs, NEAR_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.mixed_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: The stages can't be said in SQL (trained filters, fingerprints, a tokenizer); tests/llm/test_pipeline.py holds them against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written, so that a lost executor repeats one stage at most."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, path = spill_to(stage(spark, docs, sf_dir))
        if before:  # what the stage has read is written anew
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
