"""Texts as term vectors, and their inversion into postings.

A term vector is ``(id, terms, tfs, length)``: the distinct tokens of a text, how often
each occurs and how many there are. Postings hold the same as one row per term.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import tokens_of
from tessera.session import persist_table

# texts whose tokens are counted at once; a batch that Spark brings has many more
_SLICE_ROWS = 500

POSTINGS = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("tf", T.IntegerType()),
        T.StructField("length", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Postings:
    """Postings as they are stored: the term vectors of all chunks, those without a term too."""

    vectors: DataFrame

    @property
    def postings(self) -> DataFrame:
        """``(term, id, tf, length)``."""
        return postings_of(self.vectors)

    @property
    def sizes(self) -> DataFrame:
        """``(id, length)`` of all chunks."""
        return self.vectors.select("id", "length")


def count_terms(tokens: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """``(terms, tfs, length)`` of a list column of tokens, terms in order of a batch's first sight."""
    if isinstance(tokens, pa.ChunkedArray):
        tokens = tokens.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    width = max(1, len(coded.dictionary))
    row = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    cells, tf = np.unique(row * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    offsets = pa.array(np.searchsorted(cells // width, np.arange(len(lengths) + 1)).astype(np.int32))
    terms = coded.dictionary.take(pa.array(cells % width))
    return (
        pa.ListArray.from_arrays(offsets, terms),
        pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32))),
        pa.array(lengths),
    )


def text_vectors(index: DataFrame, *extra: str) -> DataFrame:
    """``(id, terms, tfs, length)`` and ``extra`` columns of ``index(id, content)``; null texts have no term."""

    @F.arrow_udf("terms array<string>, tfs array<int>, length long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for tokens in batches:
            names = ["terms", "tfs", "length"]
            starts = range(0, max(1, len(tokens)), _SLICE_ROWS)
            yield pa.concat_arrays(
                [pa.StructArray.from_arrays(count_terms(tokens.slice(k, _SLICE_ROWS)), names=names) for k in starts]
            )

    tokens = F.coalesce(tokens_of(F.col("content")), F.array().cast("array<string>"))
    # else a filter derived from an explode of the terms would count them twice
    found = index.select("id", *extra, counted.asNondeterministic()(tokens).alias("_v"))
    return found.select("id", *extra, "_v.terms", "_v.tfs", "_v.length")


def postings_of(vectors: DataFrame, *extra: str) -> DataFrame:
    """``(term, id, tf, length)`` and ``extra`` columns, one row per distinct term of a text."""
    cells = F.explode(F.arrays_zip("terms", "tfs")).alias("_c")
    return vectors.select(cells, "id", "length", *extra).select(
        F.col("_c.terms").alias("term"), "id", F.col("_c.tfs").alias("tf"), "length", *extra
    )


def make_postings(index: DataFrame) -> Postings:
    """Postings of an index that has none stored."""
    return Postings(text_vectors(index))


def vectors_of(postings: Postings, vocabulary: DataFrame) -> DataFrame:
    """One term vector per id, with at least the terms of ``vocabulary(term)``.

    Vectors are stored whole, so they are taken as they are and neither taken apart nor
    grouped. Only rows whose id occurs again are put together, of these the ones with a term
    of the vocabulary; hashes of the ids, which are all that is exchanged, tell whether there are any.
    """
    vectors = postings.vectors.select("id", "terms", "tfs", "length")
    key = F.xxhash64("id").alias("_key")
    repeated = vectors.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("_key")
    repeated = persist_table(repeated, "repeated")
    if repeated.isEmpty():
        return vectors
    keyed = vectors.withColumn("_key", key)
    single = keyed.join(repeated, "_key", "left_anti").drop("_key")
    again = postings_of(keyed.join(repeated, "_key", "left_semi"))
    found = again.join(vocabulary.select("term").distinct(), "term", "left_semi")
    joint = (
        found.groupBy("id")
        .agg(F.collect_list(F.struct("term", "tf")).alias("_c"), F.first("length").alias("length"))
        .select("id", F.col("_c.term").alias("terms"), F.col("_c.tf").alias("tfs"), "length")
    )
    return single.unionByName(joint)
