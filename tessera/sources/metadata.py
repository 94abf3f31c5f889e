"""Per-root metadata and file-listing snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.paths import base_name, parent
from tessera.schema import FILES, METADATA, METADATA_FILE_NAME
from tessera.sources.versioned import new_version, read_pointer, write_pointer


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    pointer = read_pointer(spark, path)
    if pointer is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{pointer['version']}")


def _write(df: DataFrame, path: str, schema: T.StructType) -> None:
    version = new_version()
    df.select(*schema.names).write.json(f"{path}/{version}")
    write_pointer(df.sparkSession, path, {"version": version})


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Stored metadata; no table yet reads as no rows, corrupt rows are an error."""
    return _read(spark, path, METADATA)


def write_metadata(df: DataFrame, path: str) -> None:
    """Replace the metadata table in one atomic step."""
    _write(df, path, METADATA)


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, FILES)


def write_listing(df: DataFrame, path: str) -> None:
    _write(df, path, FILES)


def metadata_from_files(files: DataFrame, name: str = METADATA_FILE_NAME) -> DataFrame:
    """Metadata from per-root JSON files of a listing with content."""
    schema = T.StructType([f for f in METADATA.fields if f.name != "root"])
    return (
        files.filter(base_name(F.col("path")) == name)
        .select(
            parent(F.col("path")).alias("root"),
            F.from_json(F.col("content").cast("string"), schema, {"mode": "FAILFAST"}).alias("m"),
        )
        .select("root", "m.*")
    )


def merge_metadata(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows of other roots plus the fresh rows."""
    return stored.join(fresh.select("root"), "root", "left_anti").select(*METADATA.names).unionByName(
        fresh.select(*METADATA.names)
    )
