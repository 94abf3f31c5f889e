"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from the text alone. Trees are grown on binned columns from
histograms of gradients, then flattened into arrays: a batch of rows goes down all
trees level by level with array look-ups, a leaf pointing at itself.

Defined results: null and empty texts have all statistics zero and get a score like
any other text; repeated rows get equal scores; a null id has a null ``held_out`` and
is never learnt from; without labelled rows, or with one class only, every score is
the share of label 1 (0.5 without rows). Other columns are not looked at. At most
``FIT_ROWS`` labelled rows, ``FIT_CHARS`` characters in total, are learnt from.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc_of_id, fit_sample, read_table, spread_rows, text_or_empty

FIT_ROWS, FIT_CHARS = 20_000, 100_000_000
THRESHOLD = 0.3

STATISTICS = (
    "log_chars log_words mean_word distinct_words repeats_before top_word log_lines mean_line distinct_lines "
    "upper digits spaces other_ascii non_ascii word_ends stops shouted odd_ends distinct_trigrams"
).split()

_KINDS = np.full(256, 4, np.uint8)  # 0 upper, 1 lower, 2 digit, 3 white space, 4 other ASCII, 5 beyond
_KINDS[65:91], _KINDS[97:123], _KINDS[48:58], _KINDS[128:] = 0, 1, 2, 5
_KINDS[[9, 10, 11, 12, 13, 32]] = 3
_CAPITALS = re.compile(r"\b[A-Z]{2,}\b")


def document_statistics(text: str) -> list[float]:
    """``STATISTICS`` of one text; shares are of characters, words or lines."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds = np.bincount(_KINDS[raw], minlength=6) / len(raw)
    lines = text.split("\n")
    n = len(words)
    counts = Counter(words)
    again = sum(map(str.__eq__, words, words[1:]))
    ends = Counter([w[-1] for w in words])
    odd = sum(k for c, k in ends.items() if not c.isalnum() and c not in ".,;:?\"')")
    return [
        float(np.log1p(len(text))),
        float(np.log1p(n)),
        len(text) / n,
        len(counts) / n,
        again / n,
        max(counts.values()) / n,
        float(np.log1p(len(lines))),
        float(np.log1p(len(text) / len(lines))),
        len(set(lines)) / len(lines),
        kinds[0],
        kinds[2],
        kinds[3],
        kinds[4],
        kinds[5],
        ends["."] / n,
        (ends[","] + ends[";"]) / n,
        len(_CAPITALS.findall(text)) / n,
        odd / n,
        len(set(zip(words, words[1:], words[2:]))) / n,
    ]


@dataclass(frozen=True)
class Forest:
    """Trees as parallel arrays over all nodes; a leaf's children are itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit_forest(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    bins: int = 64,
    rate: float = 0.15,
    penalty: float = 1.0,
    least_weight: float = 2.0,
) -> Forest:
    """Boost trees on the logistic loss; splits are found in histograms of gradients."""
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    columns = x.shape[1]
    if len(y) == 0 or y.min() == y.max():
        trees = 0
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if trees else np.zeros(0) for j in range(columns)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if trees else None
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots = []

    def leaf(value: float) -> int:
        i = len(nodes["value"])
        for key, v in (("feature", 0), ("threshold", 0.0), ("left", i), ("right", i), ("value", value)):
            nodes[key].append(v)
        return i

    raw = np.full(len(y), base)
    flat = np.arange(columns) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, weight = p - y, p * (1 - p)

        def grow(rows: np.ndarray, level: int) -> int:
            g, h = gradient[rows].sum(), weight[rows].sum()
            value = -rate * g / (h + penalty)
            me = leaf(value)
            if level == depth or len(rows) < 10:
                raw[rows] += value
                return me
            at = (binned[rows] + flat).ravel()
            gl = np.bincount(at, np.repeat(gradient[rows], columns), columns * bins).reshape(columns, bins).cumsum(1)
            hl = np.bincount(at, np.repeat(weight[rows], columns), columns * bins).reshape(columns, bins).cumsum(1)
            gain = gl**2 / (hl + penalty) + (g - gl) ** 2 / (h - hl + penalty) - g**2 / (h + penalty)
            gain[(hl < least_weight) | (h - hl < least_weight)] = -1
            j, b = np.unravel_index(np.argmax(gain), gain.shape)
            if gain[j, b] <= 1e-6 or b >= len(edges[j]):
                raw[rows] += value
                return me
            goes = binned[rows, j] <= b
            nodes["feature"][me], nodes["threshold"][me], nodes["value"][me] = int(j), float(edges[j][b]), 0.0
            nodes["left"][me] = grow(rows[goes], level + 1)
            nodes["right"][me] = grow(rows[~goes], level + 1)
            return me

        roots.append(grow(np.arange(len(y)), 0))
    kinds = {"feature": np.int32, "threshold": float, "left": np.int32, "right": np.int32, "value": float}
    return Forest(base, np.array(roots, np.int32), *(np.array(nodes[k], t) for k, t in kinds.items()), depth)


def statistics_of(text: Column | str) -> Column:
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([document_statistics(t) for t in texts], dtype=object)

    return run(text)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str, train: Column) -> Forest:
    """Trees learnt from a bounded sample of the labelled rows that ``train`` selects."""
    sample = fit_sample(docs, labels, label, train, FIT_ROWS, FIT_CHARS)
    rows = spread_rows(sample).select("id", "y", statistics_of("text").alias("x")).collect()  # FIT_ROWS short rows
    rows.sort(key=lambda r: r["id"])
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(STATISTICS))
    return fit_forest(x, np.array([r["y"] for r in rows], float))


def quality_score(spark: SparkSession, text: Column, forest: Forest) -> Column:
    model = spark.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([document_statistics(t) for t in texts], float).reshape(len(texts), len(STATISTICS))
            yield pd.Series(model.value.score(x))

    return run(text)


def held_out() -> Column:
    return crc_of_id() % 5 == 0


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of ``docs``, all columns, that the classifier does not reject."""
    forest = fit_quality(docs, read_table(spark, sf_dir, "labels"), "quality", ~held_out())
    held = spread_rows(docs.select(F.struct("*").alias("doc")))
    scored = held.withColumn("score", quality_score(spark, text_or_empty("doc.text"), forest))
    return scored.where(F.col("score") >= THRESHOLD).select("doc.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = fit_quality(docs, read_table(spark, sf_dir, "labels"), "quality", ~held_out())
    score = quality_score(spark, text_or_empty(), forest)
    return (
        spread_rows(docs)
        .select("doc_id", held_out().alias("held_out"), score.alias("score"))
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    )
