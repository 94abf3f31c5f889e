"""Change detection: per-root hashes and per-file differences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import base_name, parent
from tessera.operators.filters import drop_metadata_file
from tessera.schema import METADATA_FILE_NAME
from tessera.session import persist_table

_BLOCK_BYTES = 1 << 20
_BATCH_ROWS = 10_000
_BATCH_BYTES = 4 << 20


def _entry() -> Column:
    return F.concat(F.col("rel_path"), F.lit(":"), F.col("mod_time_ns").cast("string"))


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of about ``_BATCH_ROWS`` or ``_BATCH_BYTES`` to a batch; their last column is measured."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    for row in rows:
        held.append(row)
        size += len(row[-1])
        if len(held) >= _BATCH_ROWS or size >= _BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


_BLOCKS = pa.schema([("root", pa.string()), ("first", pa.string()), ("last", pa.string()), ("block", pa.binary())])
_HASHES = pa.schema([("root", pa.string()), ("content_hash", pa.string())])


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive entries of a root, in order, as binary blocks of about 1 MB."""

    def rows() -> Iterator[tuple]:
        root, first, last, parts, size = None, None, None, [], 0
        for batch in batches:
            for r, e in zip(batch.column("root").to_pylist(), batch.column("entry").to_pylist()):
                if parts and (r != root or size >= _BLOCK_BYTES):
                    yield root, first, last, b"".join(parts)
                    parts, size = [], 0
                if not parts:
                    root, first = r, e
                last = e
                raw = e.encode()
                parts.append(raw)
                size += len(raw)
        if parts:
            yield root, first, last, b"".join(parts)

    yield from _in_batches(rows(), _BLOCKS)


def _digest_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each root's ordered blocks, holding one hash state at a time."""

    def rows() -> Iterator[tuple]:
        root, state = None, None
        for batch in batches:
            for r, b in zip(batch.column("root").to_pylist(), batch.column("block").to_pylist()):
                if state is None or r != root:
                    if state is not None:
                        yield root, state.hexdigest()
                    root, state = r, hashlib.sha256()
                state.update(b)
        if state is not None:
            yield root, state.hexdigest()

    yield from _in_batches(rows(), _HASHES)


def _hash_streamed(entries: DataFrame) -> DataFrame:
    """Roots of any size.

    Sorting, formatting and joining of one root's entries is spread over range
    partitions. What is left for a single task is the digest itself, which has
    no parallel form; it reads 1 MB blocks and keeps only the hash state.
    """
    blocks = (
        entries.repartitionByRange("root", "entry")
        .sortWithinPartitions("root", "entry")
        .mapInArrow(_join_blocks, "root string, first string, last string, block binary")
    )
    return (
        blocks.repartition("root")
        .sortWithinPartitions("root", "first", "last")
        .mapInArrow(_digest_blocks, "root string, content_hash string")
    )


def directory_hash(
    files: DataFrame, roots: DataFrame | None = None, metadata_file: str = METADATA_FILE_NAME
) -> DataFrame:
    """``(root, content_hash)``: SHA-256 of the sorted ``path:mtime`` entries.

    One digest per root is sequential by nature: the task of a large root reads its
    ordered 1 MB blocks one by one, at the speed of SHA-256 on one core. ``roots``
    adds roots without files, whose hash is that of empty input.
    """
    entries = drop_metadata_file(files.filter(~F.col("is_dir")), metadata_file).select(
        "root", _entry().alias("entry")
    )
    hashes = _hash_streamed(entries)
    if roots is None:
        return hashes
    return roots.select("root").join(hashes, "root", "left").select(
        "root", F.coalesce("content_hash", F.sha2(F.lit(""), 256)).alias("content_hash")
    )


def folder_digests(files: DataFrame, metadata_file: str = METADATA_FILE_NAME) -> DataFrame:
    """``(root, folder, depth, digest)``: a digest of every folder and all that is below it.

    A folder's digest is the SHA-256 of its sorted entries, ``name:mtime`` for a file and
    ``name/:digest`` for a folder, so it stays the same exactly if nothing below changed
    and an unchanged subtree is known by one row. Folders are digested from the deepest
    level up, each level as one job over all folders of that depth; a folder of any size
    goes through the same ordered blocks as a root does. Empty folders have no digest.
    """
    known = drop_metadata_file(files.filter(~F.col("is_dir")), metadata_file).select(
        "root",
        parent(F.col("rel_path")).alias("folder"),
        F.concat(base_name(F.col("rel_path")), F.lit(":"), F.col("mod_time_ns").cast("string")).alias("entry"),
    )
    depth = F.when(F.col("folder") == "", F.lit(0)).otherwise(F.size(F.split("folder", "/", -1)))
    entries = persist_table(known.withColumn("depth", depth), "digest-entries")
    deepest = entries.agg(F.max("depth")).first()[0]
    found, below = None, None
    for level in range(-1 if deepest is None else deepest, -1, -1):
        here = entries.filter(F.col("depth") == level).select("root", "folder", "entry")
        if below is not None:
            name = F.concat(base_name(F.col("folder")), F.lit("/:"), F.col("digest"))
            here = here.unionByName(
                below.select("root", parent(F.col("folder")).alias("folder"), name.alias("entry"))
            )
        # a folder is told apart by root and path; neither holds a NUL
        keyed = here.select(F.concat_ws("\0", "root", "folder").alias("root"), "entry")
        split = F.split("root", "\0")
        digests = _hash_streamed(keyed).select(
            split[0].alias("root"),
            split[1].alias("folder"),
            F.lit(level).alias("depth"),
            F.col("content_hash").alias("digest"),
        )
        below = persist_table(digests, "digests")
        found = below if found is None else found.unionByName(below)
    if found is None:
        return entries.select("root", "folder", "depth", F.lit("").alias("digest")).limit(0)
    return found


def changed_folders(digests: DataFrame, stored: DataFrame) -> DataFrame:
    """``(root, folder, change)`` of folders that were added, changed somewhere below, or are gone."""
    before = stored.select("root", "folder", F.col("digest").alias("_old"))
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("digest").isNull(), "deleted").otherwise("changed")
    )
    return (
        digests.select("root", "folder", "digest")
        .join(before, ["root", "folder"], "full_outer")
        .filter(~F.col("digest").eqNullSafe(F.col("_old")))
        .select("root", "folder", change.alias("change"))
    )


def in_changed_folders(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Files directly inside folders that changed; those of unchanged subtrees need no second look."""
    placed = files.withColumn("folder", parent(F.col("rel_path")))
    return placed.join(changed.select("root", "folder"), ["root", "folder"], "left_semi").select(*files.columns)


def with_change_flag(hashes: DataFrame, metadata: DataFrame) -> DataFrame:
    """Add ``has_changed``; a root without stored metadata counts as changed."""
    stored = metadata.select("root", F.col("content_hash").alias("stored_hash"))
    return hashes.join(stored, "root", "left").select(
        "root",
        "content_hash",
        (F.coalesce("stored_hash", F.lit("")) != F.col("content_hash")).alias("has_changed"),
    )


def changed_roots(hashes: DataFrame, metadata: DataFrame) -> DataFrame:
    """Roots whose hash differs from the stored one."""
    return with_change_flag(hashes, metadata).filter("has_changed").select("root", "content_hash")


def diff_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, change)`` for added, modified and deleted files."""
    before = old.select("path", F.col("mod_time_ns").alias("_old"), F.lit(True).alias("_was"))
    after = new.select("path", F.col("mod_time_ns").alias("_new"), F.lit(True).alias("_is"))
    change = (
        F.when(F.col("_was").isNull(), "added")
        .when(F.col("_is").isNull(), "deleted")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    )
    return before.join(after, "path", "full_outer").select("path", change.alias("change")).filter(
        F.col("change").isNotNull()
    )
