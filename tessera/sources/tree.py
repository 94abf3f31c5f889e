"""Directory trees on shared storage as tables.

Spark's own file index leaves out names that begin with a dot or underscore and
empty files, all of which belong to a corpus; hence a lister of its own.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.schema import BINARY_PROBE_BYTES, FILES
from tessera.session import persist_table

FOLDER_ENTRIES = 10_000
TASK_FOLDERS = 4
CORE_TASKS = 3
_ROWS = 2_000
_BATCH_BYTES = 16 << 20
_LARGEST = (1 << 31) - (1 << 20)


def _is_url(path: str) -> bool:
    return "://" in path and not path.startswith("file://")


def _local(path: str) -> str:
    return path[len("file://") :] if path.startswith("file://") else path


def _children(folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """``(path, is_dir, size, mtime_ns)`` of a folder's entries, as they are read; links are leaves.

    Raises ``OSError`` if the folder or one of its entries can't be looked at.
    """
    if _is_url(folder):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(folder)
        prefix = folder[: len(folder) - len(inner)] if folder.endswith(inner) else ""
        for info in system.get_file_info(fs.FileSelector(inner)):
            yield prefix + info.path, info.type == fs.FileType.Directory, info.size or 0, info.mtime_ns or 0
        return
    with os.scandir(folder) as entries:
        for entry in entries:
            try:
                stat = entry.stat(follow_symlinks=False)
            except FileNotFoundError:  # removed since the folder was read
                continue
            is_dir = entry.is_dir(follow_symlinks=False)
            yield entry.path, is_dir, 0 if is_dir else stat.st_size, stat.st_mtime_ns


def _check_root(root: str) -> bool:
    """Whether the root is a folder; a root that does not exist is an error, whatever its scheme."""
    if _is_url(root):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(root)
        kind = system.get_file_info(inner).type
        if kind == fs.FileType.NotFound:
            raise FileNotFoundError(root)
        return kind == fs.FileType.Directory
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    return os.path.isdir(root)


def _read_bytes(path: str, probe: int = 0) -> bytes:
    """A file's bytes; only the first ``probe`` of them if there is a NUL among these."""

    def read(stream) -> bytes:
        head = stream.read(probe) if probe else b""
        return head if b"\0" in head else head + stream.read()

    if _is_url(path):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        with system.open_input_stream(inner) as stream:
            return read(stream)
    with open(path, "rb") as stream:
        return read(stream)


def _entered(path: str, hidden: bool) -> bool:
    return hidden or not os.path.basename(path).startswith(".")


def _walk(root: str, folder: str, hidden: bool, errors: bool, entries: int) -> Iterator[tuple]:
    """Rows of ``_LISTED`` for what is below a folder, in batches of entries read as they come.

    After about ``entries`` of them folders not yet opened are given as such, for others to list.
    """
    stack, skip, seen = [folder], len(root) + 1, 0
    while stack:
        at = stack.pop()
        if seen >= entries:
            yield root, at, at[skip:], 0, 0, True, None, True
            continue
        try:
            for path, is_dir, size, mtime in _children(at):
                seen += 1
                yield root, path, path[skip:], size, mtime, is_dir, None, False
                if is_dir and _entered(path, hidden):
                    stack.append(path)
        except OSError as problem:
            if not errors:
                raise
            yield root, at, at[skip:], 0, 0, True, str(problem), False


_LISTED = T.StructType(
    [*FILES.fields, T.StructField("error", T.StringType()), T.StructField("unopened", T.BooleanType())]
)


def _list_folders(folders: DataFrame, hidden: bool, errors: bool, entries: int) -> DataFrame:
    schema = to_arrow_schema(_LISTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * len(schema)
            arrays = [pa.array(c, t) for c, t in zip(columns, schema.types)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        seen = 0
        for given in batches:
            for root, folder in zip(given.column("root").to_pylist(), given.column("path").to_pylist()):
                if seen >= TASK_FOLDERS * entries:
                    rows.append((root, folder, folder[len(root) + 1 :], 0, 0, True, None, True))
                else:
                    for row in _walk(root, folder, hidden, errors, entries):
                        seen += 1
                        rows.append(row)
                        if len(rows) >= _ROWS:
                            yield batch()
                if len(rows) >= _ROWS:
                    yield batch()
        yield batch()

    return folders.select("root", "path").mapInArrow(run, _LISTED)


def list_tree(
    spark: SparkSession,
    roots: str | list[str],
    hidden: bool = False,
    errors: bool = False,
    entries: int = FOLDER_ENTRIES,
) -> DataFrame:
    """Every entry below the roots, folders included.

    The tree is listed round by round. A round is a table of folders, dealt out over a
    few tasks a core; a task walks each of its folders until it has seen about ``entries``
    entries, ``TASK_FOLDERS`` times as many in all, and the folders it left unopened are
    the next round's table. So a small or deep tree takes one round, a wide one is spread
    anew in each, and no folder name passes the driver.

    Hidden folders are reported but entered only with ``hidden``. Rows carry the
    root and the path relative to it. A missing root is an error. So is a folder
    that can't be listed, unless ``errors`` asks for a column of that name: the
    folder then has a further row with the reason.
    """
    given = [r.rstrip("/") for r in ([roots] if isinstance(roots, str) else roots)]
    given = [r if _is_url(r) else os.path.abspath(_local(r)) for r in given]
    starts = [(r, r) for r in given if _check_root(r)]
    folders = spark.createDataFrame(starts, "root string, path string").repartition(max(1, len(starts)))
    found = None
    while True:
        listed = persist_table(_list_folders(folders, hidden, errors, entries), "listing")
        found = listed if found is None else found.unionByName(listed)
        folders = listed.filter("unopened")
        left = folders.count()
        if not left:
            break
        tasks = min(math.ceil(left / TASK_FOLDERS), CORE_TASKS * spark.sparkContext.defaultParallelism)
        folders = folders.repartition(tasks, F.xxhash64("path"))
    names = [*FILES.names, "error"] if errors else FILES.names
    return found.filter(~F.col("unopened")).select(*names)


def list_files(spark: SparkSession, roots: str | list[str]) -> DataFrame:
    """Files below the roots that are not inside a hidden folder."""
    return list_tree(spark, roots, hidden=False).filter(~F.col("is_dir"))


def _write_bytes(folder: str, name: str, content: bytes) -> None:
    """A file in a folder, which is made where it is missing."""
    if _is_url(folder):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(folder)
        system.create_dir(inner)
        with system.open_output_stream(f"{inner}/{name}") as stream:
            stream.write(content)
        return
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "wb") as stream:
        stream.write(content)


def write_lines(lines: DataFrame, base: str) -> int:
    """Write ``lines(folder, text)`` below a base folder, which the tasks reach as ``list_tree`` does.

    A task's lines of one folder are one file, ``part-`` and the task's number, each ended by a
    newline; a null text is an empty line. A task that runs again writes the same files.
    Gives the number of files. Spark's own writer takes a commit and, on local disks, several
    processes per file, which a tree of many small files does not bear.
    """
    base = _local(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, at, held, n = f"part-{TaskContext.get().partitionId():05}.txt", None, [], 0
        for batch in batches:
            for folder, text in zip(batch.column("folder").to_pylist(), batch.column("text").to_pylist()):
                if held and folder != at:
                    _write_bytes(f"{base}/{at}", name, b"".join(held))
                    held, n = [], n + 1
                at = folder
                held.append((text or "").encode() + b"\n")
        if held:
            _write_bytes(f"{base}/{at}", name, b"".join(held))
            n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    sorted_lines = lines.select("folder", "text").sortWithinPartitions("folder")
    return sorted_lines.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def load_content(files: DataFrame, tasks: int | None = None, skip_binary: bool = False) -> DataFrame:
    """Add ``content`` and ``error`` by reading each file once, in the tasks.

    A file that cannot be read keeps its row with ``error`` set, so that one bad
    file does not fail the job; so does one too large for a binary value. A link to
    a folder has neither content nor error. ``tasks`` deals the files out by hash first.
    With ``skip_binary`` a file that the binary rule leaves out is read no further than
    that rule looks, and its content is that part.
    """
    probe = BINARY_PROBE_BYTES if skip_binary else 0
    kept = files.columns
    out = T.StructType(
        files.schema.fields
        + [T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def output(batch: pa.RecordBatch, first: int, contents: list, errors: list) -> pa.RecordBatch:
            columns = [c.slice(first, len(contents)) for c in batch.columns]
            columns += [pa.array(contents, pa.binary()), pa.array(errors, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=kept + ["content", "error"])

        for batch in batches:
            first, size, contents, errors = 0, 0, [], []
            for i, path in enumerate(batch.column("path").to_pylist()):
                try:
                    content, error = _read_bytes(path, probe), None
                    if len(content) > _LARGEST:
                        content, error = None, f"{len(content)} bytes are more than a value can hold"
                except IsADirectoryError:
                    content, error = None, None
                except (OSError, MemoryError) as problem:
                    content, error = None, str(problem)
                contents.append(content)
                errors.append(error)
                size += len(content or b"")
                if size >= _BATCH_BYTES:
                    yield output(batch, first, contents, errors)
                    first, size, contents, errors = i + 1, 0, [], []
            if contents:
                yield output(batch, first, contents, errors)

    if tasks:
        files = files.repartition(tasks, F.xxhash64("path"))
    return files.mapInArrow(run, out)
