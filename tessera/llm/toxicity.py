"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

An n-gram is 3 to 6 bytes of the lower-cased text, words being separated by one
space. All n-grams of a batch are packed into 64-bit integers with array operations
and hashed to ``2**BITS`` columns per length. A column's ratio compares how often
toxic and other training texts hold it; the columns whose counts depart furthest
from independence are kept, each text is the vector of its present columns' ratios,
and a logistic model is fitted to it.

Defined results: null and empty texts hold no n-gram and get the model's intercept
as their score; repeated rows get equal scores; a null id has a null ``held_out``
and is never learnt from; without labelled rows, or with one class only, every
score is the share of label 1 (0.5 without rows). Other columns are not looked at.
At most ``FIT_ROWS`` labelled rows, ``FIT_CHARS`` characters in total, are learnt from,
near copies within a label once; the model has ``KEPT`` columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc_of_id, fit_sample, persist_table, read_table, slices_of, spread_rows, text_or_empty
from tessera.llm.minhash import near_components

FIT_ROWS, FIT_CHARS = 20_000, 80_000_000
THRESHOLD = 0.7
LENGTHS, BITS = (3, 4, 5, 6), 19
COLUMNS = len(LENGTHS) << BITS
KEPT = 2_048
SLICE_CHARS = 1 << 19

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[:33] = 32


def present_columns(texts, kept: np.ndarray | None = None):
    """Yields ``(row, column)`` index arrays, without repeats, for slices of the texts.

    With ``kept``, a table from column to position or -1, only kept columns are given.
    """
    for a, b in slices_of([len(t) for t in texts], SLICE_CHARS):
        parts = [b" " + t.encode("utf-8", "replace") + b" " for t in texts[a:b]]
        raw = _FOLD[np.frombuffer(b"".join(parts), np.uint8)]
        row = np.repeat(np.arange(a, b, dtype=np.int64), [len(p) for p in parts])
        # one space between words
        single = np.ones(len(raw), bool)
        single[1:] = (raw[1:] != 32) | (raw[:-1] != 32) | (row[1:] != row[:-1])
        raw, row = raw[single], row[single]
        gram, found = raw.astype(np.uint64), []
        for n in range(2, max(LENGTHS) + 1):
            if len(raw) < n:
                break
            gram = gram[:-1] << np.uint64(8) | raw[n - 1 :]
            if n not in LENGTHS:
                continue
            column = (gram * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)
            column += LENGTHS.index(n) << BITS
            within = row[: len(column)] == row[n - 1 :]
            if kept is not None:
                column = kept[column]
                within &= column >= 0
            found.append((row[: len(column)][within] * COLUMNS + column[within]))
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        yield both // COLUMNS, both % COLUMNS


@dataclass(frozen=True)
class LinearModel:
    kept: np.ndarray  # column -> position or -1
    weight: np.ndarray
    intercept: float

    def score(self, texts) -> np.ndarray:
        raw = np.full(len(texts), self.intercept)
        for row, position in present_columns(texts, self.kept):
            raw += np.bincount(row, self.weight[position], len(texts))
        return 1 / (1 + np.exp(-raw))


def class_counts(sample: DataFrame) -> np.ndarray:
    """How many texts of label 0 and 1 hold each column, shape ``(2, COLUMNS)``."""
    pieces, wide = 16, COLUMNS // 16

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((2, COLUMNS), np.int32)
        for batch in batches:
            y = batch["y"].to_numpy()
            for row, column in present_columns(batch["text"].tolist()):
                for label in (0, 1):
                    held[label] += np.bincount(column[y[row] == label], minlength=COLUMNS).astype(np.int32)
        for k in range(pieces):
            yield pd.DataFrame({"piece": [k], "counts": [held[:, k * wide : (k + 1) * wide].tobytes()]})

    def total(piece: pd.DataFrame) -> pd.DataFrame:
        counts = sum(np.frombuffer(c, np.int32) for c in piece["counts"])
        return pd.DataFrame({"piece": piece["piece"][:1], "counts": [counts.astype(np.int32).tobytes()]})

    kind = "piece int, counts binary"
    rows = sample.mapInPandas(count, kind).groupBy("piece").applyInPandas(total, kind).collect()  # 8 bytes a column
    out = np.zeros((2, COLUMNS), np.int64)
    for r in rows:
        out[:, r["piece"] * wide : (r["piece"] + 1) * wide] = np.frombuffer(r["counts"], np.int32).reshape(2, wide)
    return out


def _fit_logistic(row, position, value, y, columns, penalty=3e-4, steps=60, memory=8):
    """Weights and intercept of a penalised logistic loss on sparse rows, by limited-memory BFGS."""
    n = len(y)

    def loss_and_slope(w):
        raw = np.bincount(row, value * w[position], n) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(raw, -500, 500))) - y) / n
        slope = np.append(np.bincount(position, value * error[row], columns), error.sum())
        slope[:-1] += penalty * w[:-1]
        loss = (np.logaddexp(0, raw) - y * raw).mean() + penalty / 2 * (w[:-1] @ w[:-1])
        return loss, slope

    w = np.append(np.zeros(columns), np.log(y.mean() / (1 - y.mean())))
    loss, slope = loss_and_slope(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, undo = -slope, []
        for s, g in reversed(pairs):
            undo.append((a := (s @ way) / (s @ g)))
            way = way - a * g
        if pairs:
            s, g = pairs[-1]
            way = way * ((s @ g) / (g @ g))
        for (s, g), a in zip(pairs, reversed(undo)):
            way = way + s * (a - (g @ way) / (s @ g))
        step = 1.0 if pairs else 1 / (np.abs(slope).sum() + 1e-12)
        while step > 1e-10:
            new_loss, new_slope = loss_and_slope(w + step * way)
            if new_loss <= loss + 1e-4 * step * (slope @ way):
                break
            step /= 2
        moved, turned = step * way, new_slope - slope
        if step <= 1e-10 or loss - new_loss < 1e-9:
            break
        w, loss, slope = w + moved, new_loss, new_slope
        if moved @ turned > 1e-14:
            pairs = [*pairs, (moved, turned)][-memory:]
    return w[:-1], w[-1]


def without_copies(sample: DataFrame) -> DataFrame:
    """One row per label and class of near-duplicate texts, as ``near_components`` finds them.

    Left in, a few copies of one toxic text would make all its n-grams look like marks
    of toxicity. Texts that only share a word or a line all stay.
    """
    alike = near_components(sample, id_col="id").select("id", "component")
    chosen = sample.select("id", "y").join(alike, "id").groupBy("y", "component").agg(F.min("id").alias("id"))
    return sample.join(chosen.select("id"), "id", "left_semi")


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str, train: Column) -> LinearModel:
    drawn = persist_table(fit_sample(docs, labels, label, train, FIT_ROWS, FIT_CHARS), "toxicity-drawn")
    sample = persist_table(spread_rows(without_copies(drawn)), "toxicity-sample")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    kept = np.full(COLUMNS, -1, np.int64)
    no, yes = sizes.get(0, 0), sizes.get(1, 0)
    if not no or not yes:
        share = (yes + 1) / (no + yes + 2) if not no + yes else np.clip(yes / (no + yes), 1e-4, 1 - 1e-4)
        return LinearModel(kept, np.zeros(1), float(np.log(share / (1 - share))))
    counts = class_counts(sample)
    p, q = (counts[1] + 0.5) / (yes + 1), (counts[0] + 0.5) / (no + 1)
    ratio = np.log(p / q)
    # how far the counts are from independence, in standard deviations
    spread = np.sqrt((counts.sum(0) + 1) / (no + yes) * (1 / yes + 1 / no))
    strength = np.abs(counts[1] / yes - counts[0] / no) / spread
    best = np.sort(np.argsort(-strength, kind="stable")[:KEPT])
    kept[best] = np.arange(len(best))
    scale = ratio[best]
    table = sample.sparkSession.sparkContext.broadcast(kept)

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [[] for _ in range(len(batch))]
            for row, position in present_columns(batch["text"].tolist(), table.value):
                cuts = np.searchsorted(row, np.arange(row[0], row[-1] + 2)) if len(row) else []
                for k, i in enumerate(range(row[0], row[-1] + 1) if len(row) else []):
                    held[i] = position[cuts[k] : cuts[k + 1]]
            packed = [np.asarray(h, np.int16).tobytes() for h in held]
            yield pd.DataFrame({"id": batch["id"], "y": batch["y"], "held": packed})

    rows = sample.mapInPandas(sparse, "id long, y int, held binary").collect()  # FIT_ROWS rows of 2*KEPT bytes at most
    rows.sort(key=lambda r: r["id"])
    lists = [np.frombuffer(r["held"], np.int16) for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(h) for h in lists])
    position = np.concatenate(lists).astype(np.int64)
    y = np.array([r["y"] for r in rows], float)
    weight, intercept = _fit_logistic(row, position, scale[position], y, len(best))
    return LinearModel(kept, weight * scale, intercept)


def toxicity_score(spark: SparkSession, text: Column, model: LinearModel) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score(texts.tolist()))

    return run(text)


def held_out() -> Column:
    return crc_of_id() % 3 == 1


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"), "toxic", ~held_out())
    score = toxicity_score(spark, text_or_empty(), model)
    return (
        spread_rows(docs)
        .select("doc_id", held_out().alias("held_out"), score.alias("score"))
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    )
