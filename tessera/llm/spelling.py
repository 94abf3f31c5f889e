"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

A word is the vector of its letter counts. One inserted or deleted letter moves it by a
squared distance of 1, one replaced letter by 2, so words whose vectors are further apart
are never near. Words are blocked by the sums of their counts over ``GROUPS`` fixed groups
of letters, whose total is the length: near words lie in the same block or in blocks whose
sums differ by one letter added, or by one letter moved to another group. Each pair of
such blocks, cut into chunks of ``CHUNK_CELLS`` letters, is one row; NumPy multiplies the
two chunks' count matrices, keeps the pairs at a squared distance of at most two and
verifies the edit on the letters themselves. What leaves a task is a count and the best
near word per word, never all pairs.

Defined results: null and empty texts hold no word; a null id counts as an empty one where
ids are hashed; repeated rows count each; an empty table has no word; other columns are
not looked at; words may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, persist_table, read_table, spread_rows, text_or_empty

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
RUN = r"[A-Za-zÀ-ÿ]+"
SLIP_EVERY = 97
MIN_LETTERS, MIN_COUNT, MIN_RATIO = 5, 3, 2
GROUPS = 5
TASK_PAIRS = 256
CHUNK_CELLS = 1 << 17
CANDIDATES = 1 << 20


def runs_with_slips(docs: DataFrame, every: int = SLIP_EVERY) -> DataFrame:
    """``word``: all lower-cased letter runs of the texts.

    Where ``every`` divides the unsigned crc32 ``h`` of ``<doc_id>:<run>``, the run's code
    point ``h % length`` is missing.
    """
    run = F.explode(F.regexp_extract_all(ascii_lower(text_or_empty()), F.lit(RUN), F.lit(0)))
    tag = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))
    hashed = docs.select(tag.alias("tag"), run.alias("run")).withColumn(
        "h", F.crc32(F.encode(F.concat("tag", "run"), "UTF-8"))
    )
    gone = (F.col("h") % F.length("run")).cast("int")
    slip = F.concat(F.substring("run", F.lit(1), gone), F.substring("run", gone + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % every == 0, slip).otherwise(F.col("run")).alias("word"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)`` of the distinct words that are long and frequent enough."""
    return (
        runs_with_slips(docs)
        .filter(F.length("word") >= MIN_LETTERS)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= MIN_COUNT)
    )


def _group_sums() -> Column:
    """How many letters of each group the word has; the sums add up to its length."""
    parts = [LETTERS[g::GROUPS] for g in range(GROUPS)]
    return F.array(*[F.length("word") - F.length(F.translate("word", p, "")) for p in parts])


def _moves() -> list[list[int]]:
    """Sums of a near word minus those of a word, one of each opposite two but for no change."""
    unit = np.eye(GROUPS, dtype=int)
    grown = [unit[g] for g in range(GROUPS)]
    moved = [unit[a] - unit[b] for a, b in permutations(range(GROUPS), 2) if a < b]
    return [m.tolist() for m in [0 * unit[0], *grown, *moved]]


def word_blocks(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks ``(block, chunk, words, counts)`` and pairs ``(block, chunk, block2, chunk2)`` to compare."""
    keyed = persist_table(
        words.withColumn("sums", _group_sums()).withColumn("block", F.concat_ws(".", "sums")), "spelling-words"
    )
    # chunks of about CHUNK_CELLS letters; a longer word is a chunk by itself
    cells = F.count("*") * F.greatest(F.max(F.length("word")), F.lit(64))
    blocks = keyed.groupBy("block").agg(
        F.first("sums").alias("sums"), F.ceil(cells / CHUNK_CELLS).cast("int").alias("chunks")
    )
    blocks = persist_table(blocks, "spelling-blocks")
    dealt = keyed.join(blocks.select("block", "chunks"), "block").withColumn(
        "chunk", F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int")
    )
    chunks = dealt.groupBy("block", "chunk").agg(
        F.collect_list(F.struct("word", "n")).alias("members")
    ).select("block", "chunk", F.col("members.word").alias("words"), F.col("members.n").alias("counts"))
    moves = F.array(*[F.array(*map(F.lit, m)) for m in _moves()])
    reached = F.transform(moves, lambda m: F.zip_with("sums", m, lambda a, b: a + b))
    there = blocks.select(F.col("block").alias("block2"), F.col("chunks").alias("chunks2"))
    pairs = (
        blocks.select("block", "chunks", F.explode(reached).alias("reached"))
        .filter(F.forall("reached", lambda x: x >= 0))
        .withColumn("block2", F.concat_ws(".", "reached"))
        .join(there, "block2")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("chunk2", F.explode(F.sequence(F.lit(0), F.col("chunks2") - 1)))
        .filter((F.col("block") != F.col("block2")) | (F.col("chunk") <= F.col("chunk2")))
        .select("block", "chunk", "block2", "chunk2")
    )
    return chunks, pairs


def _codes(words: list[str]) -> np.ndarray:
    """Letters of words of one length as a matrix of numbers below 90."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
    return np.where(points < 0xC0, points - 97, points - 0xC0 + 26).astype(np.uint8)


def _letter_counts(codes: np.ndarray) -> np.ndarray:
    cell = np.arange(len(codes))[:, None] * len(LETTERS) + codes
    return np.bincount(cell.ravel(), minlength=len(codes) * len(LETTERS)).reshape(len(codes), -1).astype(np.float32)


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` are one edit from those of ``b``, which are as long or one letter longer."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    prefix = np.minimum.accumulate(a == b[:, :-1], axis=1).sum(1)
    suffix = np.minimum.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return prefix + suffix >= a.shape[1]


def near_pairs(left: list[str], right: list[str], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``(i, j)`` of near words; words of a side are equally long, those of ``right`` up to one longer.

    With ``same`` both sides are one list and each pair is given once.
    """
    a, b = _codes(left), _codes(right)
    x, y = _letter_counts(a), _letter_counts(b)
    # squared distances, less the constant part of each column
    apart = (x * x).sum(1)[:, None] - 2 * (x @ y.T)
    i, j = np.nonzero(apart <= (2 - (y * y).sum(1))[None, :])
    if same:
        i, j = i[i < j], j[i < j]
    found = []
    step = max(1, CANDIDATES // a.shape[1])
    for k in range(0, len(i), step):
        found.append(k + np.nonzero(_one_edit(a[i[k : k + step]], b[j[k : k + step]]))[0])
    kept = np.concatenate(found) if found else np.zeros(0, np.int64)
    return i[kept], j[kept]


_NEAR = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _summary(words: list[str], own: np.ndarray, others: list[str], other: np.ndarray, counts: np.ndarray):
    """Per word that has near words: how many, and the most frequent one, ties by code points."""
    rank = np.empty(len(others), np.int64)
    rank[np.lexsort((np.array(others, dtype=object), -counts))] = np.arange(len(others))
    order = np.lexsort((rank[other], own))
    own, other = own[order], other[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    best = other[first]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([words[k] for k in own[first]], pa.string()),
            pa.array(np.diff(np.append(first, len(own))), pa.int64()),
            pa.array(counts[best], pa.int64()),
            pa.array([others[k] for k in best], pa.string()),
        ],
        schema=_NEAR,
    )


def compare_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            left, right = row["words"], row["words2"]
            i, j = near_pairs(left, right, row["same"])
            if len(i):
                n, n2 = np.array(row["counts"]), np.array(row["counts2"])
                yield _summary(left, i, right, j, n2)
                yield _summary(right, j, left, i, n)


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n_near, best_n, best)`` of the words that have near words."""
    chunks, pairs = word_blocks(words)
    chunks = persist_table(chunks, "spelling-chunks")
    second = chunks.select(*[F.col(c).alias(f"{c}2") for c in chunks.columns])
    pairs = persist_table(pairs, "spelling-pairs")
    # a row is up to some 10 ms of work but few bytes: partitions are made by rows
    tasks = max(1, ceil(pairs.count() / TASK_PAIRS))
    both = pairs.join(chunks, ["block", "chunk"]).repartition(tasks, "block2", "chunk2")
    both = both.join(second, ["block2", "chunk2"])
    same = (F.col("block") == F.col("block2")) & (F.col("chunk") == F.col("chunk2"))
    rows = both.select("words", "counts", "words2", "counts2", same.alias("same"))
    found = rows.mapInArrow(compare_chunks, "word string, near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return (
        found.groupBy("word")
        .agg(F.sum("near").alias("n_near"), first.alias("first"))
        .select("word", "n_near", (-F.col("first.n")).alias("best_n"), F.col("first.word").alias("best"))
    )


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of all words of ``docs(doc_id, text)``."""
    words = persist_table(word_counts(docs), "spelling-counts")
    near = words.join(near_words(words), "word", "left")
    used = F.col("best_n") >= MIN_RATIO * F.col("n")
    formed = persist_table(
        near.select(
            "word",
            F.when(used, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(used, F.col("best_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    # A form occurs at least twice as often as its word: no chain is longer than this,
    # and each round doubles how far a link reaches.
    most = words.agg(F.max("n")).first()[0] or MIN_COUNT
    links = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(1, int(log2(max(2, log2(most / MIN_COUNT) / log2(MIN_RATIO) + 1))) + 1)):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        links = persist_table(
            links.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")),
            "spelling-links",
        )
    return formed.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spread_rows(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


# crc32 by the polynomial's own table; runs hold a-z, A-Z and code points up to 255, ids digits and a sign.
OP11_SQL = r"""
WITH RECURSIVE bits(i, step, c) AS (
  SELECT i::BIGINT, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, step + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8
),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS tag,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents
),
counted AS (SELECT tag, run, count(*) AS k FROM runs GROUP BY tag, run),
hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(tag || run, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))),
    lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1]))) AS h
  FROM counted, crc
),
slipped AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, k
  FROM hashed
),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS MATERIALIZED (
  SELECT word, n, i, left(word, i - 1) AS head, substr(word, i + 1) AS tail, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
),
one AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM words a JOIN cut b ON a.word = b.rest
  UNION
  SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS m FROM one GROUP BY word),
formed AS (
  SELECT w.word, CASE WHEN b.m >= 2 * w.n THEN b.other END AS form, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near,
         CASE WHEN b.m >= 2 * w.n THEN b.m END::BIGINT AS form_n
  FROM words w LEFT JOIN best b USING (word)
),
chain(word, here) AS (
  SELECT word, word FROM formed
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.here WHERE f.form IS NOT NULL
),
ends AS (SELECT c.word, c.here AS root FROM chain c JOIN formed f ON f.word = c.here WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""
