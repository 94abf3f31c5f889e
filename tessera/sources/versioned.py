"""Atomically published versions of a table on any Hadoop file system.

A table is a folder of immutable version folders plus one small pointer file.
Writers fill a new folder with an ordinary Spark write and then replace the
pointer; readers that hold an older pointer keep reading the older files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

_POINTER = "_pointer.json"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def read_pointer(spark: SparkSession, table: str) -> dict | None:
    fs, at = _fs(spark, table), _path(spark, f"{table}/{_POINTER}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)


def write_pointer(spark: SparkSession, table: str, value: dict) -> None:
    """Write beside the pointer, then rename over it."""
    jvm = spark._jvm
    fs = _fs(spark, table)
    fs.mkdirs(_path(spark, table))
    temporary = _path(spark, f"{table}/{_POINTER}.{uuid.uuid4().hex}")
    stream = fs.create(temporary, True)
    try:
        stream.write(bytearray(json.dumps(value).encode()))
    finally:
        stream.close()
    target = fs.makeQualified(_path(spark, f"{table}/{_POINTER}"))
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        target.toUri(), spark._jsc.hadoopConfiguration()
    )
    context.rename(fs.makeQualified(temporary), target, options)


def list_names(spark: SparkSession, folder: str) -> list[str]:
    return [s.getPath().getName() for s in _fs(spark, folder).listStatus(_path(spark, folder))]


def new_version() -> str:
    return uuid.uuid4().hex
