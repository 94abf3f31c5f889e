"""Index maintenance, source and embedding queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.chunk import chunk_documents
from tessera.operators.embed import HashingEmbedder, embed, embed_queries
from tessera.operators.index import build_index_rows, chunk_id, delete_paths, upsert
from tessera.operators.search import facet_counts
from tessera.plans.catalog.changes import HASH_SQL, order_files, stored_metadata
from tessera.plans.catalog.chunking import chunk_ctes, raw_chunk_ctes, split_ctes
from tessera.plans.catalog.shapes import documents_as, documents_as_sql, table
from tessera.schema import FACET_FIELDS
from tessera.session import fresh_path
from tessera.sources.corpus import spread
from tessera.sources.metadata import read_metadata, write_metadata
from tessera.sources.store import IndexStore
from tessera.sources.tree import list_files, load_content

ID_SQL = "sha256(file_path || ':' || start_line::VARCHAR)"


def documents_with_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as prose with their natural language and source project."""
    return documents_as(spark, sf_dir, "text").withColumn(
        "language", F.element_at(F.split("path", "/"), 2)
    )


def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk_documents(documents_with_language(spark, sf_dir))
    project = F.element_at(F.split("file_path", "/"), 1)
    return build_index_rows(
        chunks.withColumn("project_path", project).withColumn(
            "project_type", F.when(F.col("language") == "en", "go").otherwise("unknown")
        ),
        now=7,
    )


CHUNK_INDEX_CTES = (
    chunk_ctes("text", documents_as_sql("text"))
    + f""",
idx AS (
  SELECT {ID_SQL} AS id, file_path, string_split(file_path, '/')[1] AS project_path,
         CASE WHEN string_split(file_path, '/')[2] = 'en' THEN 'go' ELSE 'unknown' END AS project_type,
         string_split(file_path, '/')[2] AS language, chunk_type, content, start_line, end_line, 7::BIGINT AS last_indexed
  FROM chunks)"""
)


def _numbered_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_index(spark, sf_dir).drop("embedding")


def _labelled_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rival versions of each labelled document's chunks, told apart by seq."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".txt"))

    def version(note, seq) -> DataFrame:
        return docs.select(
            chunk_id(path, F.lit(1)).alias("id"),
            path.alias("file_path"),
            F.concat(F.lit("v"), note.cast("string")).alias("content"),
            F.lit(1).alias("start_line"),
            seq.alias("seq"),
        )

    return version(F.col("quality"), F.col("quality") * 10).unionByName(
        version(F.col("toxic") + 5, F.col("toxic") + 5)
    )


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = chunk_index(spark, sf_dir).select("id", "file_path", "content", "start_line")
    return upsert(index, _labelled_updates(spark, sf_dir), "seq")


_UPSERT_SQL = (
    CHUNK_INDEX_CTES
    + """,
versions AS (
  SELECT source || '/' || lang || '/d' || doc_id::VARCHAR || '.txt' AS file_path, 'v' || quality::VARCHAR AS content, quality * 10 AS seq
  FROM documents JOIN labels USING (doc_id)
  UNION ALL
  SELECT source || '/' || lang || '/d' || doc_id::VARCHAR || '.txt', 'v' || (toxic + 5)::VARCHAR, toxic + 5
  FROM documents JOIN labels USING (doc_id)),
latest AS (SELECT sha256(file_path || ':1') AS id, file_path, arg_max(content, seq) AS content, 1::INTEGER AS start_line FROM versions GROUP BY file_path)
SELECT id, file_path, content, start_line FROM idx WHERE id NOT IN (SELECT id FROM latest)
UNION ALL SELECT id, file_path, content, start_line FROM latest"""
)


def _delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = table(spark, sf_dir, "labels").filter(F.col("toxic") == 1)
    paths = table(spark, sf_dir, "documents").join(toxic, "doc_id").select(
        F.concat("source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path")
    )
    return delete_paths(chunk_index(spark, sf_dir), paths).select("id", "file_path", "start_line")


_DELETE_SQL = (
    CHUNK_INDEX_CTES
    + """
SELECT id, file_path, start_line FROM idx WHERE file_path NOT IN (
  SELECT source || '/' || lang || '/d' || doc_id::VARCHAR || '.txt' FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)"""
)


def _index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks joined with their file's project and with vectors by chunk id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = docs.select(
        path.alias("file_path"),
        F.concat(F.lit("/"), "source").alias("project_path"),
        F.lit("go").alias("project_type"),
        F.col("lang").alias("language"),
    )
    vectors = (
        table(spark, sf_dir, "embeddings")
        .join(docs, F.col("vec_id") == F.col("doc_id"))
        .select(chunk_id(path, F.lit(1)).alias("id"), "embedding")
    )
    rows = build_index_rows(chunk_documents(documents_as(spark, sf_dir, "text")), files, vectors, now=9)
    return rows.withColumn("first", F.round(F.get("embedding", F.lit(0)).cast("double"), 6)).drop("embedding")


_INDEX_ROWS_SQL = (
    CHUNK_INDEX_CTES
    + f""",
files AS (SELECT *, source || '/' || lang || '/d' || doc_id::VARCHAR || '.txt' AS file_path FROM documents)
SELECT i.id, i.file_path, '/' || f.source AS project_path, 'go' AS project_type, f.lang AS language, i.chunk_type, i.content,
       i.start_line, i.end_line, 9::BIGINT AS last_indexed,
       CASE WHEN i.start_line = 1 THEN round(e.embedding[1]::DOUBLE, 6) END AS first
FROM idx i JOIN files f USING (file_path) LEFT JOIN embeddings e ON e.vec_id = f.doc_id"""
)


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create, fill, delete from and read an index on storage."""
    store = IndexStore(spark, fresh_path(spark, "store"), buckets=8)
    created, again = store.ensure(), store.ensure()
    store.upsert(chunk_index(spark, sf_dir))
    toxic = table(spark, sf_dir, "labels").filter(F.col("toxic") == 1)
    store.delete(
        table(spark, sf_dir, "documents").join(toxic, "doc_id").select(
            F.concat("source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path")
        )
    )
    return (
        store.read()
        .groupBy("project_path", "language")
        .agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.octet_length("content")).alias("bytes"))
        .withColumn("created_once", F.lit(created and not again))
    )


_STORE_SQL = (
    CHUNK_INDEX_CTES
    + """
SELECT project_path, language, count(*) AS chunks, sum(strlen(content))::BIGINT AS bytes, TRUE AS created_once FROM idx
WHERE file_path NOT IN (
  SELECT source || '/' || lang || '/d' || doc_id::VARCHAR || '.txt' FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
GROUP BY ALL"""
)


def _facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facet_counts(chunk_index(spark, sf_dir), FACET_FIELDS)


_FACETS_SQL = CHUNK_INDEX_CTES + " " + " UNION ALL ".join(
    f"SELECT '{f}' AS field, {f} AS value, count(*) AS n FROM idx GROUP BY {f}" for f in FACET_FIELDS
)


def root_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored metadata of the roots that had deliveries."""
    counts = (
        order_files(spark, sf_dir)
        .filter(F.col("state") != "P")
        .groupBy("root")
        .agg(F.count(F.lit(1)).cast("int").alias("file_count"), F.sort_array(F.collect_set("priority")).alias("languages"))
    )
    return stored_metadata(spark, sf_dir).join(counts, "root").select(
        "root",
        F.lit(1_700_000_000).cast("bigint").alias("last_indexed"),
        "file_count",
        "content_hash",
        F.lit("go").alias("project_type"),
        "languages",
        F.create_map(F.lit("dep"), F.concat(F.lit("v"), F.col("file_count").cast("string"))).alias("dependencies"),
    )


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata written twice and read back: the later version counts."""
    path = fresh_path(spark, "metadata")
    absent = read_metadata(spark, path).count()
    rows = root_metadata(spark, sf_dir)
    write_metadata(rows.withColumn("file_count", F.lit(0)), path)
    write_metadata(rows, path)
    return read_metadata(spark, path).select(
        "root", "last_indexed", "file_count", "content_hash", "project_type",
        F.array_join("languages", ",").alias("languages"),
        F.element_at("dependencies", "dep").alias("dep"),
        F.lit(absent).cast("bigint").alias("absent"),
    )


_METADATA_SQL = f"""
WITH h AS ({HASH_SQL.format(where="o_orderstatus <> 'P'")}),
c AS (SELECT '/c' || o_custkey::VARCHAR AS root, count(*)::INTEGER AS file_count,
             string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS languages
      FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey)
SELECT root, 1700000000::BIGINT AS last_indexed, file_count, content_hash, 'go' AS project_type, languages,
       'v' || file_count::VARCHAR AS dep, 0::BIGINT AS absent FROM h JOIN c USING (root)"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written out as text files, then listed and loaded again."""
    path = fresh_path(spark, "tree")
    spread(table(spark, sf_dir, "documents").select("source", "lang", "text")).write.option(
        "lineSep", "\n"
    ).partitionBy("source", "lang").text(path)
    local = path[len("file:"):] if path.startswith("file:/") and "://" not in path else path
    files = list_files(spark, local)
    part = F.col("rel_path").like("%/part-%")
    loaded = load_content(files.filter(part))
    folder = F.split("rel_path", "/")
    return (
        loaded.groupBy(
            F.substr(folder[0], F.lit(len("source=") + 1)).alias("source"),
            F.substr(folder[1], F.lit(len("lang=") + 1)).alias("lang"),
        )
        .agg(
            F.sum("size").alias("listed_bytes"),
            F.sum(F.octet_length("content").cast("bigint")).alias("loaded_bytes"),
            F.count("error").alias("errors"),
        )
    )


_TREE_SQL = """
SELECT source, lang, sum(strlen(text) + 1)::BIGINT AS listed_bytes, sum(strlen(text) + 1)::BIGINT AS loaded_bytes, 0::BIGINT AS errors
FROM documents GROUP BY source, lang"""


def _length_embedder(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count(" ")), float(t.count("\n"))] for t in texts]


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors = embed(spread(docs), "text", _length_embedder)
    return vectors.select("doc_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(["chars", "spaces", "newlines"])])


def _embedded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.when(F.length("text") % 3 == 0, F.lit("")).otherwise(F.col("text")).alias("query"),
    )
    return embed_queries(queries, _length_embedder).select(
        "query_id", F.col("embedding")[0].cast("double").alias("chars"), "error"
    )


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors = embed(spread(docs), "text", HashingEmbedder(64))
    return vectors.select("doc_id", F.posexplode("embedding").alias("slot", "value")).withColumn(
        "value", F.col("value").cast("double")
    )


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document table read as a corpus and measured per language."""
    docs = documents_with_language(spark, sf_dir)
    return docs.groupBy("language").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("content")).alias("bytes")
    )


QUERIES = {
    "s01_tree_listing": _tree,
    "s03_metadata_round_trip": _metadata,
    "s04_document_table": _corpus,
    "k01_index_store": _store,
    "k02_upsert": _upsert,
    "k03_delete_paths": _delete,
    "k05_index_rows": _index_rows,
    "q10_facet_counts": _facets,
    "e01_batch_embedding": _embedded,
    "e02_query_embedding": _embedded_queries,
    "e03_hashing_embedder": _hashed,
}

SQL = {
    "s01_tree_listing": _TREE_SQL,
    "s03_metadata_round_trip": _METADATA_SQL,
    "s04_document_table": f"""
SELECT string_split(path, '/')[2] AS language, count(*) AS files, sum(strlen(content))::BIGINT AS bytes
FROM ({documents_as_sql('text')}) GROUP BY 1""",
    "k01_index_store": _STORE_SQL,
    "k02_upsert": _UPSERT_SQL,
    "k03_delete_paths": _DELETE_SQL,
    "k05_index_rows": _INDEX_ROWS_SQL,
    "q10_facet_counts": _FACETS_SQL,
    "e01_batch_embedding": """
SELECT doc_id, length(text)::DOUBLE AS chars, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS spaces,
       (length(text) - length(replace(text, chr(10), '')))::DOUBLE AS newlines FROM documents""",
    "e03_hashing_embedder": r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_\p{L}\p{N}]+')) AS token FROM documents
), h AS (SELECT doc_id, ('0x' || substr(md5(token), 1, 15))::BIGINT AS h FROM t),
c AS (SELECT doc_id, h % 64 AS slot, sum(1 - 2 * ((h >> 58) & 1)) AS n FROM h GROUP BY 1, 2),
s AS (SELECT doc_id, sqrt(sum(n * n)::DOUBLE) AS size FROM c GROUP BY 1)
SELECT d.doc_id, k.slot::INTEGER AS slot,
       CASE WHEN coalesce(s.size, 0) = 0 THEN 0 ELSE coalesce(c.n, 0)::DOUBLE / s.size END::FLOAT::DOUBLE AS value
FROM documents d CROSS JOIN (SELECT unnest(range(64)) AS slot) k
LEFT JOIN c ON c.doc_id = d.doc_id AND c.slot = k.slot LEFT JOIN s ON s.doc_id = d.doc_id""",
    "e02_query_embedding": """
SELECT item_id AS query_id, CASE WHEN length(text) % 3 <> 0 THEN length(text)::DOUBLE END AS chars,
       CASE WHEN length(text) % 3 = 0 THEN 'cannot embed an empty text' END AS error FROM benchmark""",
}
