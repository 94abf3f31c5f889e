"""Index records and index maintenance as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.schema import INDEX


def chunk_id(file_path: Column, start_line: Column) -> Column:
    return F.sha2(F.concat_ws(":", file_path, start_line.cast("string")), 256)


def build_index_rows(
    chunks: DataFrame,
    files: DataFrame | None = None,
    embeddings: DataFrame | None = None,
    now: int = 0,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """Chunks to index records, with ``extra`` columns of the chunks.

    ``files`` brings ``project_path``, ``project_type`` and ``language`` by
    ``file_path`` and ``embeddings`` brings vectors by ``id``; either can be left
    out when the chunks already carry those columns.
    """
    rows = chunks.withColumn("id", chunk_id(F.col("file_path"), F.col("start_line")))
    if files is not None:
        brought = ["project_path", "project_type", "language"]
        rows = rows.drop(*brought).join(files.select("file_path", *brought), "file_path", "left")
    if embeddings is not None:
        rows = rows.drop("embedding").join(embeddings.select("id", "embedding"), "id", "left")
    rows = rows.withColumn("last_indexed", F.lit(now).cast("bigint"))
    for name in ("project_path", "project_type", "language"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit("unknown" if name != "project_path" else ""))
    if "embedding" not in rows.columns:
        rows = rows.withColumn("embedding", F.lit(None))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in INDEX.fields], *extra)


def latest(rows: DataFrame, key: str, seq_col: str | None = None) -> DataFrame:
    """The row with the highest ``seq_col`` per key, without that column.

    Without one the later row of the input counts. ``max_by`` is combined before
    the shuffle, so a key that makes up much of the input still reaches its
    reducer as one row per task.
    """
    if seq_col is None:
        seq_col, rows = "_seq", rows.withColumn("_seq", F.monotonically_increasing_id())
    kept = [c for c in rows.columns if c != seq_col]
    return rows.groupBy(key).agg(F.max_by(F.struct(*kept), seq_col).alias("_row")).select("_row.*")


def upsert(index: DataFrame, updates: DataFrame, seq_col: str | None = None) -> DataFrame:
    """Updated index: rows of ``updates`` replace rows with the same id.

    With ``seq_col`` several updates of one id are allowed and the last wins.
    """
    fresh = latest(updates, "id", seq_col) if seq_col else updates
    kept = index.join(fresh.select("id"), "id", "left_anti")
    return kept.select(*index.columns).unionByName(fresh.select(*index.columns))


def delete_paths(index: DataFrame, paths: DataFrame | str) -> DataFrame:
    """Index without the chunks of the given file path or table of ``file_path``."""
    if isinstance(paths, str):
        if not paths:
            raise ValueError("a file path is required")
        return index.filter(F.col("file_path") != paths)
    return index.join(paths.select("file_path"), "file_path", "left_anti").select(*index.columns)
