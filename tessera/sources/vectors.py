"""Vectors stored by the digest of the text they belong to."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.sources.versioned import list_names, new_version, read_pointer, write_pointer

VECTORS = T.StructType(
    [T.StructField("digest", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]
)


class VectorCache:
    """``(digest, embedding)`` of one embedder's texts, for a single writer.

    Every addition is a folder of its own that a pointer file makes visible at once,
    so an interrupted addition leaves nothing behind that a reader could see.
    """

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/{quote(name, safe='')}"

    def _parts(self) -> list[str]:
        return (read_pointer(self.spark, self.path) or {}).get("parts", [])

    def read(self) -> DataFrame:
        parts = [f"{self.path}/{p}" for p in self._parts()]
        return self.spark.read.schema(VECTORS).parquet(*parts) if parts else self.spark.createDataFrame([], VECTORS)

    def add(self, vectors: DataFrame) -> None:
        """Add vectors of digests that are not stored yet."""
        part = new_version()
        vectors.select(*VECTORS.names).write.parquet(f"{self.path}/{part}")
        if any(n.startswith("part-") and ".parquet" in n for n in list_names(self.spark, f"{self.path}/{part}")):
            write_pointer(self.spark, self.path, {"parts": [*self._parts(), part]})
