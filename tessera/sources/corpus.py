"""Document tables as corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPREAD_BYTES = 256 << 20


def spread(df: DataFrame, limit: int = SPREAD_BYTES) -> DataFrame:
    """Deal a small table out over all cores.

    A small file often has a single row group and so a single task. Only inputs
    whose planned size is at most ``limit`` are exchanged; a larger table has
    enough splits of its own and is returned as it is.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > limit:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with ``path``, ``content`` and optionally ``language``."""
    df = spark.read.parquet(path)
    wanted = [c for c in ("path", "content", "language") if c in df.columns]
    if "path" not in wanted or "content" not in wanted:
        raise ValueError("a corpus needs the columns path and content")
    return df.select(*wanted)
