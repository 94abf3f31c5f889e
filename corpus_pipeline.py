"""A training-data pipeline over ``documents``: every stage's result is the next one's input.

Every stage but the last returns rows of ``documents`` with all their columns. A null
text counts as empty in all of them; a row without id is scored, compared by its exact
text and mixed like any other, and is never a near copy.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.bpe import with_digests
from tessera.llm.common import persist_table, read_table
from tessera.llm.exact_dedup import drop_exact_copies
from tessera.llm.minhash import one_of_each
from tessera.llm.mixing import mixed
from tessera.llm.quality import good_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trees do not reject."""
    return good_documents(spark, docs, sf_dir)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row with the largest doc_id stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles of similarity 0.8 or more, the smallest doc_id stays."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least; small sources are repeated, none more than twice."""
    return mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes per remaining row."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return with_digests(docs, ranks, public_tokenizers.PATTERN, "text", "doc_id")


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("byte_bpe", byte_bpe),
]

# Trained trees and LSH have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = persist_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
