"""Documents to chunks."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.chunking import chunks_for_route, pieces
from tessera.functions.paths import extension
from tessera.functions.text import is_blank
from tessera.schema import CHUNK_LIMIT_BYTES

# Fallback from extension to chunker when no language is known.
ROUTE_BY_EXTENSION = {
    ".go": "go",
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".java": "java",
    ".md": "markdown",
    ".markdown": "markdown",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".json": "json",
    ".toml": "toml",
}


def literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def drop_blank(docs: DataFrame) -> DataFrame:
    """Keep documents with at least one character that is not white space."""
    return docs.filter(~is_blank(F.col("content")))


def with_chunk_route(docs: DataFrame) -> DataFrame:
    """Add ``route``: the given language, else the one the extension implies."""
    by_extension = F.coalesce(
        F.try_element_at(literal_map(ROUTE_BY_EXTENSION), extension(F.col("path"))), F.lit("text")
    )
    if "language" not in docs.columns:
        return docs.withColumn("route", by_extension)
    given = F.lower(F.coalesce(F.col("language"), F.lit("")))
    return docs.withColumn(
        "route", F.when(given.isin("", "unknown"), by_extension).otherwise(given)
    )


def explode_chunks(docs: DataFrame, chunks: Column) -> DataFrame:
    """One row per chunk; keeps every column of ``docs`` but the text."""
    kept = [c for c in docs.columns if c != "content"]
    return docs.select(*kept, F.explode(chunks).alias("_chunk")).select(*kept, "_chunk.*")


def split_large(chunks: DataFrame, limit: int = CHUNK_LIMIT_BYTES) -> DataFrame:
    """Cut divisible chunks over ``limit`` bytes at line ends."""
    kept = [
        c
        for c in chunks.columns
        if c not in ("content", "start_line", "end_line", "divisible")
    ]
    small = F.array(F.struct("content", "start_line", "end_line"))
    fits = ~F.col("divisible") | (F.octet_length("content") <= limit)
    parts = F.when(fits, small).otherwise(
        pieces(F.col("content"), F.col("start_line"), F.col("end_line"), limit)
    )
    return chunks.select(*kept, F.explode(parts).alias("_piece")).select(*kept, "_piece.*")


@lru_cache(maxsize=2)
def _route_expression(_application: str) -> Column:
    """The dispatching expression, built once per application: it is large."""
    return chunks_for_route(F.col("content"), F.col("route"))


def chunk_documents(docs: DataFrame, limit: int = CHUNK_LIMIT_BYTES, keep_blank: bool = False) -> DataFrame:
    """``(path, content[, language], ...)`` to one row per chunk.

    Blank texts are dropped, unless ``keep_blank`` says that none is left.

    Everything is row-local: filter, projection, two explodes. The plan has no
    exchange, so it runs inside the scan's stage whatever the corpus size.
    """
    routed = with_chunk_route(docs if keep_blank else drop_blank(docs))
    expression = _route_expression(docs.sparkSession.sparkContext.applicationId)
    chunks = explode_chunks(routed, expression)
    return split_large(chunks, limit).drop("route").withColumnRenamed("path", "file_path")
