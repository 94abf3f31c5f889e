"""The index, search and status jobs."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.paths import base_name, prefixes
from tessera.operators.change import changed_roots, diff_files, directory_hash, with_change_flag
from tessera.operators.chunk import chunk_documents, drop_blank
from tessera.operators.detect import (
    UNKNOWN,
    dependencies,
    detect_projects,
    root_rollup,
    with_language,
    with_project,
)
from tessera.operators.embed import Embedder, embed, embed_queries, embed_unseen
from tessera.operators.filters import (
    drop_binary,
    drop_hidden,
    drop_ignored,
    flag_skipped,
    ignore_rulesets,
)
from tessera.operators.index import build_index_rows, latest
from tessera.operators.render import with_rendering
from tessera.operators.search import hybrid_search, text_search, to_results
from tessera.operators.secrets import redact
from tessera.schema import FILES, METADATA, SEARCH_LIMIT, SKIP_GLOBS
from tessera.session import persist_table
from tessera.sources.metadata import (
    merge_metadata,
    read_listing,
    read_metadata,
    write_listing,
    write_metadata,
)
from tessera.sources.store import IndexStore
from tessera.sources.tree import list_tree, load_content
from tessera.sources.vectors import VectorCache

_TASK_BYTES = 128 << 20


@dataclass
class Workspace:
    """Where an index and the state around it live.

    ``compact_after`` says from how many segments on a run folds them into the base;
    a run that finds fewer rewrites nothing that is stored.
    """

    spark: SparkSession
    path: str
    buckets: int = 64
    compact_after: int = 16

    @property
    def store(self) -> IndexStore:
        return IndexStore(self.spark, f"{self.path}/index", self.buckets, postings=True)

    def vectors(self, embedder: Embedder) -> VectorCache | None:
        """Stored vectors of an embedder that has a ``name``; others are called for every text."""
        name = getattr(embedder, "name", None)
        return VectorCache(self.spark, f"{self.path}/vectors", name) if name else None

    @property
    def metadata_path(self) -> str:
        return f"{self.path}/metadata"

    @property
    def listing_path(self) -> str:
        return f"{self.path}/listing"

    @property
    def errors_path(self) -> str:
        return f"{self.path}/errors"


def document_rows(
    docs: DataFrame,
    embedder: Embedder | None,
    now: int,
    projects: DataFrame | None = None,
    cache: VectorCache | None = None,
) -> DataFrame:
    """``(path, content[, language])`` to index records, with ``error`` where an embedder is asked.

    Redaction comes before chunking, so no secret can straddle two pieces. The rows can be
    read several times: what an embedder gave is written out, here or with the stored vectors.
    """
    if "language" not in docs.columns:
        docs = with_language(docs)
    if projects is not None:
        docs = with_project(docs, projects)
    # blank texts go first: a filter after redaction would repeat all of its work
    chunks = chunk_documents(redact(drop_blank(docs)), keep_blank=True)
    if embedder is None:
        return build_index_rows(chunks, now=now)
    if cache is None:
        chunks = persist_table(embed(chunks, "content", embedder, error_col="error"), "embedded")
    else:
        chunks = embed_unseen(chunks, "content", embedder, cache)
    return build_index_rows(chunks, now=now, extra=("error",))


def apply_rows(
    store: IndexStore, rows: DataFrame, deletes: DataFrame, batch: tuple[str, int] | None = None
) -> DataFrame:
    """Put index records in place of what ``deletes.file_path`` had; gives ``(file_path, error)``.

    A file with a chunk that could not be embedded is left as it was: neither its new
    chunks nor the removal of its old ones is applied, and the first of its errors is given.
    Records with an ``error`` are read twice, which ``document_rows`` provides for.
    """
    spark = store.spark
    if "error" not in rows.columns:
        store.apply(updates=rows, deletes=deletes, batch=batch)
        return spark.createDataFrame([], "file_path string, error string")
    failed = persist_table(
        rows.filter(F.col("error").isNotNull()).groupBy("file_path").agg(F.min("error").alias("error")), "failed"
    )
    if not failed.isEmpty():
        rows = rows.join(failed.select("file_path"), "file_path", "left_anti")
        deletes = deletes.join(failed.select("file_path"), "file_path", "left_anti")
    store.apply(updates=rows, deletes=deletes, batch=batch)
    return failed


def index_documents(
    docs: DataFrame,
    store: IndexStore,
    embedder: Embedder | None = None,
    now: int = 0,
    projects: DataFrame | None = None,
    seq_col: str | None = None,
    batch: tuple[str, int] | None = None,
    cache: VectorCache | None = None,
) -> DataFrame:
    """Index a document table, replacing all earlier chunks of its paths.

    Of several documents with one path the last counts, by ``seq_col`` or else
    by input order. A pass over the paths alone finds out whether there are any,
    which spares tables of distinct paths an exchange of their texts. Gives
    ``(file_path, error)`` of the documents that the embedder failed on.
    """
    repeated = docs.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    if not repeated.isEmpty():
        docs = latest(docs, "path", seq_col)
    elif seq_col:
        docs = docs.drop(seq_col)
    rows = document_rows(docs, embedder, now, projects, cache)
    return apply_rows(store, rows, docs.select(F.col("path").alias("file_path")), batch)


def run_index(
    spark: SparkSession,
    roots: Iterable[str],
    workspace: Workspace,
    embedder: Embedder | None = None,
    now: int = 0,
    skip_globs: Iterable[str] = SKIP_GLOBS,
) -> DataFrame:
    """Index directory trees incrementally; gives ``(root, change, files)`` counts.

    Roots whose hash is unchanged are left out before any content is read.
    Inside the others only added and modified files are read, and the chunks of
    modified, deleted and newly ignored files are removed. A file that cannot be
    read or embedded, or a folder that cannot be listed, goes to the errors table and
    its root stays due for the next run; what was indexed below such a folder, or of a
    file that could not be embedded, stays. Texts whose vectors are known from an
    earlier run of an embedder with the same name are not embedded again. A text
    that is not UTF-8 is indexed with replacement characters. Links to folders are
    hashed but not read. The errors of a run are a folder of their own, named by its
    time and roots, so a repeated run writes them once and runs of other roots add theirs.
    """
    roots = [r.rstrip("/") for r in roots]
    root_table = spark.createDataFrame([(r,) for r in roots], "root string")
    listed_tree = list_tree(spark, roots, hidden=True, errors=True)
    unlisted = listed_tree.filter(F.col("error").isNotNull()).select("root", "path", "error")
    tree = listed_tree.filter(F.col("error").isNull()).drop("error")
    stored = read_metadata(spark, workspace.metadata_path)
    hashes = persist_table(changed_roots(directory_hash(tree, root_table), stored), "hashes")
    due = hashes.select("root")

    todo = tree.join(due, "root", "left_semi").select(*FILES.names)
    ignore_files = load_content(
        todo.filter(~F.col("is_dir") & (base_name(F.col("path")) == ".gitignore"))
    )
    visible = drop_ignored(drop_hidden(todo), ignore_rulesets(ignore_files)).filter(~F.col("is_dir"))
    visible = persist_table(
        flag_skipped(visible, skip_globs).filter(~F.col("should_skip")).select(*FILES.names), "visible"
    )
    before = read_listing(spark, workspace.listing_path)
    previous = before.join(due, "root", "left_semi")
    kept = before.join(due, "root", "left_anti").select(*FILES.names)
    # Roots may overlap: a path counts once, and it is not gone while a root
    # that did not change still shows it.
    differences = diff_files(previous.dropDuplicates(["path"]), visible.dropDuplicates(["path"]))
    # What an unlisted folder holds is unknown, hence not gone either.
    elsewhere = kept.select("path", F.lit(True).alias("_elsewhere")).distinct()
    hidden = persist_table(
        previous.withColumn("_above", F.explode(prefixes(F.col("path"), False)))
        .join(unlisted.select(F.col("path").alias("_above")), "_above", "left_semi")
        .select(*FILES.names)
        .distinct(),
        "unlisted",
    )
    unknown = hidden.select("path", F.lit(True).alias("_unknown")).distinct()
    changes = persist_table(
        differences.join(elsewhere, "path", "left")
        .join(unknown, "path", "left")
        .filter((F.col("change") != "deleted") | (F.col("_elsewhere").isNull() & F.col("_unknown").isNull()))
        .select("path", "change"),
        "changes",
    )

    fresh = visible.dropDuplicates(["path"]).join(
        changes.filter(F.col("change") != "deleted"), "path", "left_semi"
    )
    size = fresh.agg(F.sum("size").alias("n")).first().n or 0
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(size / _TASK_BYTES))
    loaded = load_content(fresh, tasks, skip_binary=True)
    projects = persist_table(detect_projects(todo), "projects")
    # Files are read once: what was loaded is written out, then split into
    # text to index and errors to report.
    contents = persist_table(loaded, "contents")
    texts = (
        drop_binary(contents.filter(F.col("content").isNotNull()))
        .select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    )
    cache = workspace.vectors(embedder) if embedder else None
    rows = document_rows(texts, embedder, now, projects, cache)
    gone = changes.filter(F.col("change") != "added").select(F.col("path").alias("file_path"))
    store = workspace.store
    unembedded = apply_rows(store, rows, gone).select(F.col("file_path").alias("path"), "error")
    if store.segments() >= workspace.compact_after:
        store.compact()

    errors = (
        contents.filter(F.col("error").isNotNull())
        .select("root", "path", "error")
        .unionByName(unlisted)
        .unionByName(visible.select("root", "path").join(unembedded, "path"))
    )
    run = hashlib.sha256("\n".join(sorted(roots)).encode()).hexdigest()[:16]
    errors.write.mode("overwrite").json(f"{workspace.errors_path}/at={now}/run={run}")
    failed_roots = errors.select("root").distinct().withColumn("_failed", F.lit(True))

    manifests = load_content(
        todo.filter(~F.col("is_dir")).join(
            projects.filter(F.col("marker").isin("go.mod", "package.json"))
            .join(root_table.withColumnRenamed("root", "project_path"), "project_path", "left_semi")
            .select(
                F.concat_ws("/", "project_path", "marker").alias("path"), "project_path", "marker"
            ),
            "path",
        )
    )
    summary = root_rollup(visible, projects, dependencies(manifests.filter(F.col("error").isNull())))
    fresh_metadata = (
        hashes.join(summary, "root", "left")
        .join(failed_roots, "root", "left")
        .select(
            "root",
            F.lit(now).cast("bigint").alias("last_indexed"),
            F.coalesce("file_count", F.lit(0)).alias("file_count"),
            F.when(F.col("_failed"), F.lit("")).otherwise(F.col("content_hash")).alias("content_hash"),
            F.coalesce("project_type", F.lit(UNKNOWN)).alias("project_type"),
            F.coalesce("languages", F.array().cast("array<string>")).alias("languages"),
            F.coalesce("dependencies", F.create_map().cast("map<string,string>")).alias("dependencies"),
        )
    )
    indexed = visible.join(errors.select("path"), "path", "left_anti").select(*FILES.names)
    # what a file had before the embedder failed on it is still there
    outdated = previous.join(unembedded.select("path"), "path", "left_semi").select(*FILES.names)
    still = hidden.unionByName(outdated).join(indexed.select("path"), "path", "left_anti").select(*FILES.names).distinct()
    write_listing(kept.unionByName(indexed).unionByName(still), workspace.listing_path)
    write_metadata(merge_metadata(stored, fresh_metadata), workspace.metadata_path)

    listed = previous.select("root", "path").unionByName(visible.select("root", "path")).distinct()
    return changes.join(listed, "path").groupBy("root", "change").agg(F.count(F.lit(1)).alias("files"))


def search(
    queries: DataFrame,
    index: DataFrame | IndexStore,
    embedder: Embedder | None = None,
    limit: int = SEARCH_LIMIT,
) -> DataFrame:
    """``(query_id, query)`` to ranked results with their rendering.

    With an embedder the ranking is hybrid, without one it is text only. A query that
    cannot be embedded has no result. Of a store the text leg reads postings where
    there are any, and the results only the buckets that hold hits.
    """
    postings, chunks = None, index
    if isinstance(index, IndexStore):
        postings = index.read_postings() if index.has_postings else None
        index, chunks = index.read(), index.fetch
    if embedder is None:
        hits = text_search(queries, index, limit, postings)
    else:
        embedded = embed_queries(queries.select("query_id", "query"), embedder)
        hits = hybrid_search(embedded.filter(F.col("error").isNull()), index, limit, postings)
    return with_rendering(to_results(hits, chunks))


def status(roots: DataFrame, metadata: DataFrame, hashes: DataFrame, index: DataFrame) -> DataFrame:
    """One row per root: what is known about it and whether it is up to date."""
    flags = with_change_flag(hashes, metadata).select("root", "has_changed")
    documents = index.agg(F.count(F.lit(1)).alias("n")).scalar()
    state = (
        F.when(F.col("last_indexed").isNull(), "no metadata")
        .when(F.coalesce("has_changed", F.lit(True)), "changes detected")
        .otherwise("up to date")
    )
    return (
        roots.select("root")
        .join(metadata.select(*METADATA.names), "root", "left")
        .join(flags, "root", "left")
        .select(
            "root",
            F.coalesce("project_type", F.lit(UNKNOWN)).alias("project_type"),
            F.coalesce("file_count", F.lit(0)).alias("file_count"),
            F.array_join("languages", ", ").alias("languages"),
            "last_indexed",
            state.alias("state"),
            documents.alias("documents"),
        )
    )


def run_status(spark: SparkSession, roots: Iterable[str], workspace: Workspace) -> DataFrame:
    roots = [r.rstrip("/") for r in roots]
    table = spark.createDataFrame([(r,) for r in roots], "root string")
    tree = list_tree(spark, roots, hidden=True)
    return status(
        table,
        read_metadata(spark, workspace.metadata_path),
        directory_hash(tree, table),
        workspace.store.read(),
    )
