"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import persist_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

__all__ = [
    "ascii_lower",
    "crc_of_id",
    "fit_sample",
    "persist_table",
    "read_table",
    "slices_of",
    "spread_rows",
    "text_or_empty",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def crc_of_id(name: str = "doc_id") -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(F.encode(F.col(name).cast("string"), "UTF-8"))


def spread_rows(df: DataFrame) -> DataFrame:
    """Deal a frame out evenly where its files give fewer splits than there are cores.

    The split count comes from the plan's files, not from the rows; a large table
    has more splits than cores and passes through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


def slices_of(lengths, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive slices of a batch holding ``limit`` characters or one longer text."""
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def fit_sample(
    docs: DataFrame, labels: DataFrame, label: str, train: Column, max_rows: int, max_chars: int
) -> DataFrame:
    """``(id, text, y)`` of a bounded, reproducible sample of the labelled training rows.

    At most ``max_rows`` rows are taken in the order of a hash of their id, fewer
    if their texts exceed ``max_chars`` characters in total. ``train`` selects the
    training fold. Rows without id or label are left out; of repeated label rows
    the largest label counts, of repeated documents one.
    """
    wanted = (
        labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
        .where("id IS NOT NULL AND y IS NOT NULL")
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )
    sized = (
        docs.where(train & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("id"), F.length(text_or_empty()).alias("n"))
        .groupBy("id")
        .agg(F.max("n").alias("n"))
    )
    top = (
        sized.join(wanted, "id")
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_rows)
        .collect()  # ids and lengths of at most max_rows rows
    )
    chosen, total = [], 0
    for row in top:
        total += row["n"]
        if chosen and total > max_chars:
            break
        chosen.append((row["id"], row["y"]))
    spark = docs.sparkSession
    picked = spark.createDataFrame(chosen, "id long, y int")
    return (
        docs.where(train)
        .select(F.col("doc_id").alias("id"), text_or_empty().alias("text"))
        .join(F.broadcast(picked), "id")  # max_rows rows of 12 bytes
        .dropDuplicates(["id"])
    )
