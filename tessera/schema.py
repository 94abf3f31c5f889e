"""Table schemas and default parameters shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# Limits and defaults that results depend on.
CHUNK_LIMIT_BYTES = 4000
BINARY_PROBE_BYTES = 8192
PREVIEW_BYTES = 200
SEARCH_LIMIT = 10
UPSERT_BATCH_ROWS = 100
VECTOR_SIZE = 768
SKIP_GLOBS = (".env", ".setenv", "*.pem", "*.key", "credentials.*")
METADATA_FILE_NAME = ".tessera-metadata.json"
REDACTION = "[REDACTED]"

FILES = T.StructType(
    [
        T.StructField("root", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("rel_path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mod_time_ns", T.LongType()),
        T.StructField("is_dir", T.BooleanType()),
    ]
)

INDEX = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("project_path", T.StringType()),
        T.StructField("project_type", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("chunk_type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("last_indexed", T.LongType()),
    ]
)

FACET_FIELDS = ("file_path", "project_path", "project_type", "language", "chunk_type")

METADATA = T.StructType(
    [
        T.StructField("root", T.StringType()),
        T.StructField("last_indexed", T.LongType()),
        T.StructField("file_count", T.IntegerType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("project_type", T.StringType()),
        T.StructField("languages", T.ArrayType(T.StringType())),
        T.StructField("dependencies", T.MapType(T.StringType(), T.StringType())),
    ]
)
