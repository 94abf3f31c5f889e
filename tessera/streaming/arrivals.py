"""Continuous indexing of arriving documents."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.embed import Embedder
from tessera.plans.jobs import index_documents
from tessera.session import persist_table
from tessera.sources.store import IndexStore


def stop_on_errors(failed: DataFrame, number: int) -> None:
    first = failed.orderBy("file_path").first()
    if first is not None:
        raise RuntimeError(f"batch {number}: {first.file_path}: {first.error}")


def stream_index(
    docs: DataFrame,
    store: IndexStore,
    checkpoint: str,
    embedder: Embedder | None = None,
    seq_col: str | None = None,
    clock: Callable[[], int] = lambda: int(time.time()),
    on_errors: Callable[[DataFrame, int], None] = stop_on_errors,
    **trigger,
) -> StreamingQuery:
    """Index a stream of ``(path, content[, language])`` documents.

    Each micro-batch replaces the chunks of its paths by one segment, marked with the
    query's id and the batch's number: a batch that is run again after a failure is
    left out if its segment was published, and published if not. ``seq_col`` orders
    several versions of one path inside a batch. ``on_errors`` gets ``(file_path, error)``
    of the documents that the embedder failed on, once per batch; unless told otherwise
    the stream stops there, after the others were indexed.
    """

    def on_batch(batch: DataFrame, number: int) -> None:
        # the id is kept in the checkpoint and so outlives restarts
        source = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        arrived = persist_table(batch, "arrivals")
        failed = index_documents(
            arrived, store, embedder, clock(), seq_col=seq_col, batch=(source, number) if source else None
        )
        on_errors(failed, number)

    writer = docs.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
