"""Exact deduplication by progressive refinement.

Rows are grouped by text length, groups of several by a hash of the text's head,
and only rows that still share a group have their whole text hashed. Every level
is an aggregate that combines before the shuffle, so a group with a third of all
rows arrives as one row per task; texts meet the surviving groups in a join whose
skewed partitions Spark may split.

Defined results: a null text counts as empty; an empty text is a text like any
other; texts are equal when identical after lower-casing A-Z only; of equal texts
the largest id stays (a null id only if no other is there); repeated rows with the
same id and text are members of one group, count in ``group_size`` and are all
marked as kept; an empty table gives no rows. Other columns are not looked at, so
their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, persist_table, read_table, text_or_empty

HEAD_CHARS = 256


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept`` and what ``carry`` names."""
    carry = carry or {}
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(ascii_lower(F.substring(text, 1, HEAD_CHARS))).alias("head"),
        text.alias("whole"),
        *[c.alias(name) for name, c in carry.items()],
    )
    by_length = rows.groupBy("n_bytes").agg(F.count("*").alias("n")).where("n > 1").select("n_bytes")
    by_head = persist_table(
        rows.select("n_bytes", "head")
        .join(by_length, "n_bytes", "left_semi")
        .groupBy("n_bytes", "head")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select("n_bytes", "head"),
        "exact-heads",
    )
    level = ["n_bytes", "head"]
    shared = persist_table(
        rows.join(by_head, level, "left_semi").select(
            "id", F.sha2(ascii_lower(F.col("whole")), 256).alias("full"), *carry
        ),
        "exact-shared",
    )
    classes = shared.groupBy("full").agg(
        F.max("id").alias("keep_id"), F.count("*").alias("group_size")
    )
    alone = rows.join(by_head, level, "left_anti").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), *carry
    )
    together = shared.join(classes, "full").select("id", "keep_id", "group_size", *carry)
    return alone.unionByName(together).withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; repeated rows are kept once."""
    held = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("key"), F.col(text_col).alias("body"))
    rows = exact_groups(held, "key", "body", {"doc": F.col("doc")}).where("kept")
    several = rows.where("group_size > 1")
    once = several.groupBy("id", F.sha2(ascii_lower(text_or_empty(f"doc.{text_col}")), 256)).agg(
        F.first("doc").alias("doc")
    )
    return rows.where("group_size = 1").select("doc").unionByName(once.select("doc")).select("doc.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    digest = F.sha2(ascii_lower(text_or_empty()), 256)
    return exact_groups(docs, carry={"text_sha256": digest}).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


OP6_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY s) AS keep_id,
       count(*) OVER (PARTITION BY s) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY s) AS kept,
       sha256(s) AS text_sha256
FROM t
"""
