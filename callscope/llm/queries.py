"""Registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL.

Modules are imported when a query runs, so that one operator's needs do not weigh on another's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callscope.llm import mixing


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callscope.llm.mixing import mix_documents

    return mix_documents(_documents(spark, sf_dir))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callscope.llm.secrets import scan_documents

    return scan_documents(_documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from callscope.llm.token_counts import count_tokens

    return count_tokens(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callscope.llm.lm_scoring import score_documents

    return score_documents(_documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callscope.llm.simhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callscope.llm.pii import scan

    return scan(_documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callscope.llm.language_id import predict_documents

    return predict_documents(_documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callscope.llm.exact_dedup import annotate

    return annotate(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from callscope.llm.packing import pack_documents

    return pack_documents(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callscope.llm.merkle import fingerprint_and_compare

    return fingerprint_and_compare(_documents(spark, sf_dir))


def pack_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three-limit packer of op9 on whole conversations."""
    import public_tokenizers

    from callscope.llm.packing import INSTRUCTION_LIMITS, conversation_examples, pack_examples

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return pack_examples(conversation_examples(turns, public_tokenizers.path("byte_bpe_50k.json")), INSTRUCTION_LIMITS)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_secrets": op2_secrets,
    "op3_token_counts": op3_token_counts,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_simhash": op5_simhash,
    "op6_pii": op6_pii,
    "op7_language_id": op7_language_id,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_packing": op9_packing,
    "op10_merkle": op10_merkle,
    "pack_instructions": pack_instructions,
}

ORACLE_SQL = {
    "op1_mixing": mixing.ORACLE,
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
