"""Batch embedding with a pluggable embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import tokens_of
from tessera.schema import UPSERT_BATCH_ROWS, VECTOR_SIZE
from tessera.session import persist_table
from tessera.sources.vectors import VectorCache

EMPTY_TEXT = "cannot embed an empty text"

Embedder = Callable[[list], Sequence[Sequence[float]]]


class HashingEmbedder:
    """Signed feature hashing of tokens, scaled to unit length.

    A token's hash is the number in the first 15 digits of its MD5, so any engine
    can compute the same vectors: slot by remainder, sign by bit 58.

    Tokens are cut by built-in functions. Each distinct token of a batch is hashed
    once, and a batch is summed into vectors at once.
    """

    def __init__(self, size: int = VECTOR_SIZE):
        self.size = size

    @property
    def name(self) -> str:
        """Vectors of embedders with one name can stand in for each other."""
        return f"hashing-{self.size}"

    def features(self, text: Column) -> Column:
        return tokens_of(text)

    def __call__(self, batch: list) -> np.ndarray:
        return self.from_tokens(pa.array(batch, pa.list_(pa.string())))

    def from_tokens(self, tokens: pa.Array) -> np.ndarray:
        n = len(tokens)
        lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        coded = tokens.flatten().dictionary_encode()
        distinct = [int(hashlib.md5(t.encode()).hexdigest()[:15], 16) for t in coded.dictionary.to_pylist()]
        hashes = np.array(distinct, dtype=np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        row = np.repeat(np.arange(n, dtype=np.int64), lengths)
        slot = np.mod(hashes, self.size)
        sign = 1.0 - 2.0 * ((hashes >> 58) & 1)
        sums = np.bincount(row * self.size + slot, weights=sign, minlength=n * self.size)
        vectors = sums.reshape(n, self.size)
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        return (vectors / np.where(norms == 0, 1.0, norms)).astype(np.float32)


def embed(
    df: DataFrame,
    text_col: str,
    embedder: Embedder,
    batch_size: int = UPSERT_BATCH_ROWS,
    out_col: str = "embedding",
    error_col: str | None = None,
) -> DataFrame:
    """Add one vector per row, calling the embedder in batches.

    Only the text, or what the embedder makes of it, goes to Python; all other
    columns stay where they are. Empty texts are an error, as is an embedder
    that raises or returns a different number of vectors than it was given texts.

    An error ends the query, unless ``error_col`` names a column for it: a batch
    that fails is then tried text by text, rows that still fail carry the reason
    and no vector, and all others theirs. Calls are marked as not repeatable, so that
    no filter that Spark derives from the result makes it ask the embedder twice.
    """
    features = getattr(embedder, "features", None)
    from_tokens = getattr(embedder, "from_tokens", None)
    source = features(F.col(text_col)) if features else F.col(text_col)
    empty = F.coalesce(F.octet_length(text_col), F.lit(0)) == 0

    def vectors(column: pa.Array) -> np.ndarray:
        made = from_tokens(column) if from_tokens else embedder(column.to_pylist())
        matrix = np.asarray(made, dtype=np.float32)
        if matrix.ndim != 2 or len(matrix) != len(column):
            raise ValueError("embedder returned a wrong number of vectors")
        return matrix

    def lists(matrix: np.ndarray) -> pa.Array:
        offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(matrix.ravel(), pa.float32()))

    nothing = pa.list_(pa.float32())

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            starts = range(0, len(column), batch_size)
            parts = [lists(vectors(column.slice(k, batch_size))) for k in starts]
            yield pa.concat_arrays(parts) if parts else pa.array([], nothing)

    def tried(column: pa.Array) -> tuple[pa.Array, list]:
        """Vectors and errors of a batch; null texts are passed over."""
        given = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        errors: list = [None] * len(column)
        if not len(given):
            return pa.nulls(len(column), nothing), errors
        try:
            made = lists(vectors(column.take(pa.array(given))))
            at = np.full(len(column), -1)
            at[given] = np.arange(len(given))
            return made.take(pa.array(at, mask=at < 0)), errors
        except Exception as problem:  # whatever an embedder raises is a row's error
            if len(column) == 1:
                return pa.nulls(1, nothing), [f"{type(problem).__name__}: {problem}"]
        parts = [tried(column.slice(k, 1)) for k in range(len(column))]
        return pa.concat_arrays([v for v, _ in parts]), [e for _, es in parts for e in es]

    def run_tried(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = [tried(column.slice(k, batch_size)) for k in range(0, len(column), batch_size)]
            found = pa.concat_arrays([v for v, _ in parts]) if parts else pa.array([], nothing)
            errors = pa.array([e for _, es in parts for e in es], pa.string())
            yield pa.StructArray.from_arrays([found, errors], names=["vector", "error"])

    kind = T.ArrayType(T.FloatType())
    if error_col is None:
        checked = F.when(empty, F.raise_error(F.lit(EMPTY_TEXT))).otherwise(source)
        return df.withColumn(out_col, F.arrow_udf(run, kind).asNondeterministic()(checked))
    pair = T.StructType([T.StructField("vector", kind), T.StructField("error", T.StringType())])
    kept = [c for c in df.columns if c not in (out_col, error_col)]
    asked = F.arrow_udf(run_tried, pair).asNondeterministic()
    found = df.withColumn("_found", asked(F.when(~empty, source)))
    return found.select(
        *kept,
        F.col("_found.vector").alias(out_col),
        F.when(empty, F.lit(EMPTY_TEXT)).otherwise(F.col("_found.error")).alias(error_col),
    )


def embed_unseen(
    df: DataFrame, text_col: str, embedder: Embedder, cache: VectorCache, batch_size: int = UPSERT_BATCH_ROWS
) -> DataFrame:
    """Add ``embedding`` and ``error``; only texts whose vector is not stored reach the embedder.

    Vectors are known by the digest of their text, so equal texts, moved files and
    repeated runs cost no call. What fails is not stored and is tried again next time.
    The result is a join of written tables: reading it again asks for nothing again.
    """
    digest = F.unhex(F.sha2(F.coalesce(text_col, F.lit("")), 256))
    keyed = df.drop("embedding", "error").withColumn("_digest", digest)
    keyed = persist_table(keyed.withColumn("_row", F.monotonically_increasing_id()), "texts")
    # digests and row numbers find the texts to embed; a text itself is exchanged for that
    # only if it is one of a table too large to be broadcast
    known = cache.read().select(F.unhex("digest").alias("_digest"))
    firsts = keyed.groupBy("_digest").agg(F.min("_row").alias("_row"))
    fresh = persist_table(firsts.join(known, "_digest", "left_anti").select("_row"), "fresh")
    asked = keyed.join(fresh, "_row", "left_semi").select("_digest", F.col(text_col).alias("text"))
    made = persist_table(embed(asked, "text", embedder, batch_size, error_col="error").drop("text"), "vectors")
    good = F.col("error").isNull()
    cache.add(made.filter(good).select(F.lower(F.hex("_digest")).alias("digest"), "embedding"))
    failed = made.filter(~good).select("_digest", "error")
    vectors = cache.read().select(F.unhex("digest").alias("_digest"), "embedding")
    rows = keyed.drop("_row").join(failed, "_digest", "left").join(vectors, "_digest", "left")
    return rows.drop("_digest")


def embed_queries(
    queries: DataFrame, embedder: Embedder, batch_size: int = UPSERT_BATCH_ROWS
) -> DataFrame:
    """``(query_id, query)`` plus ``embedding`` and ``error``.

    An empty query, or one that the embedder fails on, has no vector and says so in
    ``error`` instead of failing the other queries of the table.
    """
    return embed(queries, "query", embedder, batch_size, error_col="error")
