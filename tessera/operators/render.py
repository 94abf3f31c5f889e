"""Result rendering as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import truncate_bytes
from tessera.schema import PREVIEW_BYTES

# What readers of rendered results see.
NO_RESULTS = "No results found."
RESULT_FIELDS = (
    "file_path",
    "project_path",
    "language",
    "chunk_type",
    "content",
    "start_line",
    "end_line",
    "score",
)


def with_rendering(results: DataFrame, preview: int = PREVIEW_BYTES) -> DataFrame:
    """Add ``header`` and ``snippet`` to ranked results.

    The preview is cut at ``preview`` bytes on a character boundary, and every
    line of it is indented by four spaces.
    """
    header = F.format_string(
        "[%d] %s:%d-%d (%s) score: %.2f", "rank", "file_path", "start_line", "end_line", "chunk_type", "score"
    )
    cut = F.when(
        F.octet_length("content") > preview,
        F.concat(truncate_bytes(F.col("content"), preview), F.lit("...")),
    ).otherwise(F.col("content"))
    snippet = F.concat(F.lit("    "), F.replace(cut, F.lit("\n"), F.lit("\n    ")), F.lit("\n"))
    return results.withColumn("header", header).withColumn("snippet", snippet)


def results_text(results: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, text)``: all of a query's results, or that there are none.

    A group is one query's top results, so its size is the search limit.
    """
    parts = with_rendering(results).select(
        "query_id",
        "rank",
        F.concat(F.col("header"), F.lit("\n"), F.col("snippet"), F.lit("\n")).alias("text"),
    )
    joined = parts.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda r: r.text), ""
        ).alias("text")
    )
    return queries.select("query_id").join(joined, "query_id", "left").select(
        "query_id", F.coalesce("text", F.lit(NO_RESULTS)).alias("text")
    )


def results_json(results: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, json)``: results in rank order, ``[]`` if there are none."""
    rows = results.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.struct(*RESULT_FIELDS).alias("r")))).alias("rows")
    )
    return queries.select("query_id").join(rows, "query_id", "left").select(
        "query_id",
        F.coalesce(F.to_json(F.transform("rows", lambda r: r.r)), F.lit("[]")).alias("json"),
    )
