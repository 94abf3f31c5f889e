"""Whole-job queries: batch, incremental and streaming indexing, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.change import diff_files, directory_hash
from tessera.operators.embed import HashingEmbedder
from tessera.plans.catalog.changes import HASH_SQL, order_files
from tessera.plans.catalog.chunking import chunk_ctes
from tessera.plans.catalog.filters import redact_sql
from tessera.plans.catalog.index import ID_SQL, chunk_index, root_metadata
from tessera.plans.catalog.shapes import documents_as, documents_as_sql, table
from tessera.plans.jobs import Workspace, index_documents, run_index, status
from tessera.session import fresh_path
from tessera.sources.store import IndexStore
from tessera.sources.tree import write_lines
from tessera.sources.vectors import VectorCache
from tessera.streaming.arrivals import stream_index

_FIELDS = ["id", "file_path", "language", "chunk_type", "start_line", "end_line", "content", "last_indexed"]


def _read(store: IndexStore) -> DataFrame:
    return store.read().select(*_FIELDS, F.size("embedding").alias("dims"))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = IndexStore(spark, fresh_path(spark, "store"), buckets=8)
    index_documents(documents_as(spark, sf_dir, "markdown"), store, HashingEmbedder(32), now=3)
    return _read(store)


def _indexed_sql(fmt: str, docs: str, language: str, now: str, dims: int) -> str:
    return f"""{chunk_ctes(fmt, docs)}
SELECT {ID_SQL} AS id, file_path, '{language}' AS language, chunk_type, start_line, end_line, content,
       {now} AS last_indexed, {dims}::INTEGER AS dims FROM chunks"""


def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index everything, then apply a later state: texts changed and removed."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    path = F.concat("source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".txt"))
    first = docs.select(path.alias("path"), F.col("text").alias("content"), F.lit(0).alias("mod_time_ns"))
    poor = F.coalesce(F.col("quality") == 0, F.lit(False))
    second = docs.filter(~F.coalesce(F.col("toxic") == 1, F.lit(False))).select(
        path.alias("path"),
        F.when(poor, F.concat("text", F.lit("\n\nrevised"))).otherwise(F.col("text")).alias("content"),
        F.when(poor, 1).otherwise(0).alias("mod_time_ns"),
    )
    store = IndexStore(spark, fresh_path(spark, "store"), buckets=8)
    index_documents(first.select("path", "content"), store, now=1)
    changes = diff_files(first, second)
    fresh = second.join(changes.filter(F.col("change") != "deleted"), "path", "left_semi")
    index_documents(fresh.select("path", "content"), store, now=2)
    store.delete(changes.filter(F.col("change") == "deleted").select(F.col("path").alias("file_path")))
    return _read(store)


_LATER_DOCS = f"""
SELECT source || '/d' || doc_id::VARCHAR || '.txt' AS path,
       {redact_sql("CASE WHEN quality = 0 THEN text || chr(10) || chr(10) || 'revised' ELSE text END")} AS content
FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS DISTINCT FROM 1"""
_REVISED = """CASE WHEN file_path IN (SELECT source || '/d' || doc_id::VARCHAR || '.txt' FROM documents JOIN labels USING (doc_id)
                     WHERE quality = 0) THEN 2 ELSE 1 END::BIGINT"""


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive as a stream; later ones replace earlier ones of a path."""
    schema = table(spark, sf_dir, "documents").schema
    arrivals = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents*.parquet").select(
        F.concat("source", F.lit("/"), "lang", F.lit("/latest.txt")).alias("path"),
        F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("content"),
        F.col("doc_id").alias("arrival"),
    )
    folder = fresh_path(spark, "stream")
    store = IndexStore(spark, f"{folder}/index", buckets=8)
    query = stream_index(
        arrivals, store, f"{folder}/checkpoint", HashingEmbedder(16), "arrival", clock=lambda: 5, availableNow=True
    )
    query.awaitTermination()
    return _read(store)


_STREAM_DOCS = f"""
SELECT source || '/' || lang || '/latest.txt' AS path,
       {redact_sql("replace(arg_max(text, doc_id), chr(10), chr(10) || chr(10))")} AS content
FROM documents GROUP BY source, lang"""


def _partition_folder(name: str) -> Column:
    """The folder of a column's value, named as Spark names a partition."""
    value = F.col(name).cast("string")
    for mark in "%\"#'*/:=?\\{[]^\x7f" + "".join(map(chr, range(1, 32))):  # the percent sign first
        value = F.replace(value, F.lit(mark), F.lit(f"%{ord(mark):02X}"))
    absent = F.coalesce(value, F.lit("")) == ""
    return F.concat(F.lit(f"{name}="), F.when(absent, "__HIVE_DEFAULT_PARTITION__").otherwise(value))


def _tree_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a tree of files, one folder each, indexed by the whole job in two runs.

    The second run finds the documents that came after the first, the labelled ones,
    and an ignore file that hides one language from then on.
    """
    docs = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled")).distinct(), "doc_id", "left"
    )
    base = fresh_path(spark, "tree-job")
    local = base[len("file:") :] if base.startswith("file:/") and "://" not in base else base
    space = Workspace(spark, f"{base}-space", buckets=8)

    def arrive(part: DataFrame) -> None:
        folder = F.concat_ws("/", _partition_folder("lang"), _partition_folder("doc_id"))
        write_lines(part.select(folder.alias("folder"), "text").repartition("folder"), local)

    arrive(docs.filter(F.col("labelled").isNull()))
    run_index(spark, [local], space, now=1)
    arrive(docs.filter("labelled"))
    rules = spark.createDataFrame([("# generated\nlang=de/",)], "value string")
    rules.coalesce(1).write.text(f"{base}-rules")
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(f"{base}-rules")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(hadoop.Path(base))
    (written,) = [s.getPath() for s in system.globStatus(hadoop.Path(f"{base}-rules/part-*"))]
    system.rename(written, hadoop.Path(f"{base}/.gitignore"))
    run_index(spark, [local], space, now=2)
    path = F.col("file_path")
    return (
        space.store.read()
        .filter(path.like("%/part-%"))
        .select(
            F.regexp_extract(path, "lang=([^/]*)/doc_id=", 1).alias("lang"),
            F.regexp_extract(path, "/doc_id=([0-9]+)/", 1).cast("bigint").alias("doc_id"),
            "start_line", "end_line", "chunk_type", "content", "last_indexed",
        )
        .filter("lang <> ''")
    )


_TREE_JOB_DOCS = f"""
SELECT lang || '/' || doc_id::VARCHAR AS path, {redact_sql('text')} || chr(10) AS content FROM documents WHERE lang <> 'de'"""
_TREE_JOB_SQL = f"""{chunk_ctes('text', _TREE_JOB_DOCS)}
SELECT split_part(file_path, '/', 1) AS lang, split_part(file_path, '/', 2)::BIGINT AS doc_id, start_line, end_line, chunk_type, content,
       CASE WHEN split_part(file_path, '/', 2)::BIGINT IN (SELECT doc_id FROM labels) THEN 2 ELSE 1 END::BIGINT AS last_indexed
FROM chunks"""


class _Lengths:
    """Texts as their lengths."""

    name = "lengths"

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(t))] for t in texts]


class _Unreachable(_Lengths):
    def __call__(self, texts: list[str]) -> list[list[float]]:
        raise ConnectionError("no embedder here")


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents move while the embedder is out of reach: their vectors are stored."""
    docs = documents_as(spark, sf_dir, "text")
    base = fresh_path(spark, "moved")
    store, cache = IndexStore(spark, f"{base}/index", buckets=8), VectorCache(spark, f"{base}/vectors", _Lengths.name)
    index_documents(docs, store, _Lengths(), now=1, cache=cache)
    later = docs.withColumn("path", F.concat(F.lit("moved/"), "path"))
    index_documents(later, store, _Unreachable(), now=2, cache=cache)
    store.delete(docs.select(F.col("path").alias("file_path")))
    return store.read().select(
        "id", "file_path", "start_line", "last_indexed", F.col("embedding")[0].cast("double").alias("chars")
    )


_MOVED_DOCS = f"""SELECT 'moved/' || path AS path, {redact_sql('content')} AS content FROM ({documents_as_sql('text')})"""
_MOVED_SQL = f"""{chunk_ctes('text', _MOVED_DOCS)}
SELECT {ID_SQL} AS id, file_path, start_line, 2::BIGINT AS last_indexed, length(content)::DOUBLE AS chars FROM chunks"""


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("/c"), F.col("c_custkey").cast("string")).alias("root")
    )
    hashes = directory_hash(order_files(spark, sf_dir), roots)
    return status(roots, root_metadata(spark, sf_dir), hashes, chunk_index(spark, sf_dir))


_STATUS_SQL = f"""{chunk_ctes('text', documents_as_sql('text'))},
h AS ({HASH_SQL.format(where='TRUE')}),
s AS ({HASH_SQL.format(where="o_orderstatus <> 'P'")}),
c AS (SELECT '/c' || o_custkey::VARCHAR AS root, count(*)::INTEGER AS file_count,
             string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS languages
      FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey)
SELECT r.root, CASE WHEN s.root IS NULL THEN 'unknown' ELSE 'go' END AS project_type, coalesce(c.file_count, 0) AS file_count, c.languages,
       CASE WHEN s.root IS NOT NULL THEN 1700000000::BIGINT END AS last_indexed,
       CASE WHEN s.root IS NULL THEN 'no metadata' WHEN s.content_hash <> coalesce(h.content_hash, sha256('')) THEN 'changes detected'
            ELSE 'up to date' END AS state,
       (SELECT count(*) FROM chunks) AS documents
FROM (SELECT '/c' || c_custkey::VARCHAR AS root FROM customer) r
LEFT JOIN s USING (root) LEFT JOIN h USING (root) LEFT JOIN c USING (root)"""

QUERIES = {
    "b01_index_job": _index,
    "b02_incremental_index": _incremental,
    "b04_status": _status,
    "b05_streaming_index": _stream,
    "b06_tree_index": _tree_job,
    "e04_vector_reuse": _moved,
}

SQL = {
    "b01_index_job": _indexed_sql(
        "markdown", f"SELECT path, {redact_sql('content')} AS content FROM ({documents_as_sql('markdown')})", "markdown", "3::BIGINT", 32
    ),
    "b02_incremental_index": _indexed_sql("text", _LATER_DOCS, "unknown", _REVISED, -1).replace("-1::INTEGER", "NULL::INTEGER"),
    "b04_status": _STATUS_SQL,
    "b06_tree_index": _TREE_JOB_SQL,
    "e04_vector_reuse": _MOVED_SQL,
    "b05_streaming_index": _indexed_sql("text", _STREAM_DOCS, "unknown", "5::BIGINT", 16),
}
