"""Substring dedup: removal of long byte strings that stand anywhere else.

1. Anchors: of every ``length``-byte string the smallest hash of its 96-byte grams
   is an anchor, so equal strings meet at equal anchors. An anchor's context is all
   bytes of the strings that may have it as their anchor.
2. Contexts are counted by (anchor hash, context hash); a task combines the copies
   in every slice of its texts before the shuffle. A context seen twice is covered as a whole; an anchor hash seen once holds
   no repeat. What is left are anchor hashes with several different contexts.
3. One copy of each such context is cut from its text. Anchor hashes are dealt to
   buckets of bounded size, and a task orders the suffixes of its bucket by a
   blockwise, difference-cover construction (``suffixes.repeated_strings``);
   neighbours that agree for ``length`` bytes are repeats. An anchor hash with more
   than ``MOST_CONTEXTS`` contexts would outgrow a task: its strings are counted by
   hash instead, an aggregate that combines before the shuffle.
4. Covered spans go back to the texts by id and are merged.

Anchors, contexts and hot strings are told apart by 64-bit hashes.

Defined results: null texts are empty; texts shorter than ``length`` keep all bytes;
matches never cross texts; a text with copies is covered in all of them. Rows are
known by id, and by a hash of the text where ids repeat, so every row has its own
result and equal rows are copies of each other; rows without id are treated like
any other. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import persist_table, read_table, slices_of, spread_rows, text_or_empty
from tessera.llm.suffixes import RangeHash, anchors, repeated_strings

LENGTH, GRAM = 200, 96
BUCKET_CONTEXTS = 2_048
MOST_CONTEXTS = 16_384
SLICE_BYTES = 1 << 20
KEY = ["key", "mark"]
NO_ID = -(1 << 63)


def _anchor_rows(rows: DataFrame, length: int, gram: int, counted: bool) -> DataFrame:
    """All anchors; ``counted`` gives each pair of hashes once per slice of texts, with its number ``n``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, keys, marks = batch["text"], batch["key"].to_numpy(), batch["mark"].to_numpy()
            for a, b in slices_of(texts.str.len(), SLICE_BYTES):
                row, at, key, context = anchors([t.encode("utf-8", "replace") for t in texts[a:b]], length, gram)
                found = pd.DataFrame(
                    {
                        "key": keys[a:b][row],
                        "mark": marks[a:b][row],
                        "at": at.astype(np.int32),
                        "gram": key.astype(np.int64),
                        "context": context.astype(np.int64),
                    }
                )
                if counted:
                    order = np.lexsort((context, key))
                    new = np.ones(len(order), bool)
                    new[1:] = (key[order[1:]] != key[order[:-1]]) | (context[order[1:]] != context[order[:-1]])
                    first = np.nonzero(new)[0]
                    found = found.iloc[order[first]]
                    found["n"] = np.diff(np.append(first, len(order)))
                yield found

    kind = "key long, mark long, at int, gram long, context long"
    return rows.mapInPandas(run, kind + ", n long" * counted)


def _cut_contexts(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """One row per wanted anchor: its context's bytes and how many of them stand before the anchor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, wanted in zip(batch["text"], batch["wanted"]):
                raw = text.encode("utf-8", "replace")
                for w in wanted:
                    first = max(w["at"] - (length - gram), 0)
                    cut = raw[first : w["at"] + length]
                    out.append((w["gram"], w["context"], w["bucket"], w["hot"], w["at"] - first, cut))
            yield pd.DataFrame(out, columns=["gram", "context", "bucket", "hot", "before", "bytes"])

    return rows.mapInPandas(run, "gram long, context long, bucket long, hot boolean, before int, bytes binary")


def _spans(hit: np.ndarray, length: int) -> list[int]:
    """``[from, to, ...]``: union of the repeated strings of a context, in its bytes; ``hit`` marks them in order."""
    starts = np.nonzero(hit)[0]
    if not len(starts):
        return []
    gap = np.nonzero(np.diff(starts) > length)[0]
    low = starts[np.concatenate([[0], gap + 1])]
    high = starts[np.concatenate([gap, [len(starts) - 1]])] + length
    return np.stack([low, high], axis=1).ravel().tolist()


def _suffix_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated spans of the contexts of each bucket, relative to the anchor."""

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        kind = np.unique(bucket["gram"], return_inverse=True)[1]
        hits = repeated_strings(list(bucket["bytes"]), bucket["before"].to_numpy(np.int64), kind, length)
        found = [_spans(hit, length) for hit in hits]
        moved = [[x - before for x in spans] for spans, before in zip(found, bucket["before"])]
        out = pd.DataFrame({"gram": bucket["gram"], "context": bucket["context"], "spans": moved})
        return out[[bool(s) for s in moved]]

    return contexts.groupBy("bucket").applyInPandas(run, "gram long, context long, spans array<int>")


def _hot_spans(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with too many contexts: every string's hash is counted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, context, before, raw in zip(batch["gram"], batch["context"], batch["before"], batch["bytes"]):
                ranges = RangeHash(np.frombuffer(raw, np.uint8))
                first = np.arange(max(0, len(raw) - length + 1))
                hashes = ranges(first, first + length).astype(np.int64)
                yield pd.DataFrame({"gram": key, "context": context, "offset": first - before, "string": hashes})

    strings = contexts.mapInPandas(run, "gram long, context long, offset int, string long")
    twice = strings.groupBy("gram", "offset", "string").agg(F.count("*").alias("n")).where("n > 1")
    return (
        strings.join(twice, ["gram", "offset", "string"], "left_semi")
        .groupBy("gram", "context")
        .agg(F.collect_list("offset").alias("offsets"))  # at most length - gram + 1 of one context
        .select(
            "gram",
            "context",
            F.flatten(F.transform("offsets", lambda o: F.array(o, o + F.lit(length)))).alias("spans"),
        )
    )


def covered_spans(
    rows: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    most_contexts: int = MOST_CONTEXTS,
    bucket_contexts: int = BUCKET_CONTEXTS,
) -> DataFrame:
    """``key, mark, spans``: byte spans ``[from, to)`` of each row (``key, mark, text``) that stand elsewhere too, unmerged."""
    rows_ = rows.where(F.octet_length("text") >= length)
    pair = ["gram", "context"]
    # slices have combined their copies; one exchange by anchor hash serves both counts
    counted = (
        _anchor_rows(rows_, length, gram, counted=True)
        .repartition("gram")
        .groupBy(*pair)
        .agg(F.sum("n").alias("n"), F.min(F.struct("key", "mark", "at")).alias("sample"))
    )
    alike = Window.partitionBy("gram")
    repeated = persist_table(
        counted.select(
            *pair,
            "n",
            "sample",
            F.sum("n").over(alike).alias("total"),
            F.count("*").over(alike).alias("contexts"),
            F.min("n").over(alike).alias("least"),
        ).where("total > 1"),
        "substring-repeated",
    )
    open_rows = repeated.where("contexts > 1 AND least = 1")
    buckets = open_rows.where(F.col("contexts") <= most_contexts).count() // bucket_contexts + 1
    wanted = open_rows.groupBy(F.col("sample.key").alias("key"), F.col("sample.mark").alias("mark")).agg(
        F.collect_list(  # anchors of one text
            F.struct(
                F.col("sample.at").alias("at"),
                *pair,
                F.pmod("gram", F.lit(buckets)).alias("bucket"),
                (F.col("contexts") > most_contexts).alias("hot"),
            )
        ).alias("wanted")
    )
    contexts = _cut_contexts(rows.join(wanted, KEY).select("text", "wanted"), length, gram)
    contexts = persist_table(contexts, "substring-contexts")
    spans = _suffix_spans(contexts.where("NOT hot"), length)
    if repeated.where(F.col("contexts") > most_contexts).limit(1).count():
        spans = spans.unionByName(_hot_spans(contexts.where("hot"), length))
    # a context that stands twice is covered as a whole, whatever its strings share with others
    whole = repeated.where("n > 1").select(*pair, F.lit(None).cast("array<int>").alias("spans"))
    once = repeated.where("n = 1").select(*pair).join(spans, pair)
    decided = persist_table(whole.unionByName(once.select(*pair, "spans")), "substring-decided")
    reach = F.array(F.greatest(F.lit(gram - length), -F.col("at")), F.lit(length))
    return (
        _anchor_rows(rows_, length, gram, counted=False)
        .join(decided, pair)
        .select(*KEY, F.transform(F.coalesce("spans", reach), lambda x: x + F.col("at")).alias("spans"))
        .groupBy(*KEY)
        .agg(F.flatten(F.collect_list("spans")).alias("spans"))  # spans of one text
    )


def _merged(spans: np.ndarray, size: int) -> np.ndarray:
    """Maximal runs ``(from, to)`` of the union, cut at the text's end."""
    spans = np.minimum(spans.reshape(-1, 2), size)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    high = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > high[:-1]])
    first = np.nonzero(new)[0]
    return np.stack([spans[first, 0], high[np.concatenate([first[1:], [len(spans)]]) - 1]], axis=1)


def removed(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``id, n_bytes, n_removed, runs, kept`` per text: maximal removed runs and the bytes that remain."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text, found in zip(batch["key"], batch["text"], batch["spans"]):
                raw = text.encode("utf-8", "replace")
                runs = [] if found is None else _merged(np.asarray(found, np.int64), len(raw)).ravel().tolist()
                edges = [0, *runs, len(raw)]
                kept = b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2])])
                out.append((key, len(raw), len(raw) - len(kept), runs, kept))
            yield pd.DataFrame(out, columns=["key", "n_bytes", "n_removed", "runs", "kept"])

    kind = "key long, n_bytes long, n_removed long, runs array<long>, kept binary"
    done = rows.join(spans, KEY, "left").select("key", "text", "spans").mapInPandas(run, kind)
    return done.select(F.nullif("key", F.lit(NO_ID)).alias("id"), "n_bytes", "n_removed", "runs", "kept")


def keyed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, mark, text``: the id, and what tells rows of one id apart if ids repeat."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    rows = docs.select(key.alias("key"), text_or_empty(text_col).alias("text"))
    unique = not rows.groupBy("key").count().where("count > 1").limit(1).count()
    return spread_rows(rows).select("key", (F.lit(0).cast("long") if unique else F.xxhash64("text")).alias("mark"), "text")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed_rows(read_table(spark, sf_dir, "documents"))
    return removed(rows, covered_spans(rows)).select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        "n_removed",
        (F.size("runs") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
