"""Language identification by error-correcting output codes over hashed n-grams.

Every language has a codeword, and one linear classifier per bit tells the languages
whose codeword has a 1 there from the others. Features are the n-grams of 1 to 4 bytes
of a text, letters folded and words set apart by single spaces, hashed with signs into
``2**BITS`` columns, damped and scaled to unit length, so a score does not depend on the
text's length. Decoding is weighted by loss: a classifier's loss against a codeword's bit
counts as much as the classifier was right about that language on texts kept aside, and
the codeword of least weighted loss wins. ``ambiguous`` marks texts whose two nearest
codewords are closer than ``MARGIN``.

At most ``PER_LANGUAGE`` rows of a language and ``FIT_ROWS`` rows and ``FIT_CHARS``
characters in total are learnt from, drawn by a hash of their id and text: the most
evenly over languages that the bounds allow. Each is learnt whole and as two short pieces.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every
text if there is nothing to learn from; with one learnt language every other text is that
language with score 1; a null id has a null ``held_out`` and is never learnt from; repeated
rows get equal results; other columns are not looked at. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import crc_of_id, read_table, spread_rows, text_or_empty

PER_LANGUAGE, FIT_ROWS, FIT_CHARS = 300, 1_500, 16_000_000
PARTS = (256, 16, 1)
LENGTHS, BITS = (1, 2, 3, 4), 13
COLUMNS = 1 << BITS
SEGMENT = 1 << 19
ROWS_AT_ONCE = 256
PIECES = (40, 160)
MARGIN = 0.1
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[:65] = 32  # control characters, digits and most punctuation set words apart


# --- features --------------------------------------------------------------------


def _segments(texts: list[str]) -> Iterator[tuple[int, bytes, int]]:
    """``(row, bytes, own)``: whole texts, long ones as segments whose first ``own`` bytes begin n-grams."""
    for row, text in enumerate(texts):
        raw = b" " + text.encode("utf-8", "replace") + b" "
        for at in range(0, len(raw), SEGMENT):
            yield row, raw[at : at + SEGMENT + max(LENGTHS) - 1], min(SEGMENT, len(raw) - at)


def _add_counts(counts: np.ndarray, segments: list[tuple[int, bytes, int]]) -> None:
    raw = _FOLD[np.frombuffer(b"".join(s for _, s, _ in segments), np.uint8)]
    sizes = [len(s) for _, s, _ in segments]
    start = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
    place = np.arange(len(raw)) - start
    owned = place < np.repeat([own for _, _, own in segments], sizes)
    left = np.repeat(sizes, sizes) - place
    row = np.repeat([r for r, _, _ in segments], sizes)
    gram, cells, signs = np.zeros(len(raw), np.uint64), [], []
    for n in range(1, max(LENGTHS) + 1):
        gram = gram[: len(raw) - n + 1] << np.uint64(8) | raw[n - 1 :]
        # runs of separators say nothing
        inside = owned[: len(gram)] & (left[: len(gram)] >= n)
        inside &= (raw[: len(gram)] != 32) | (raw[n - 1 :] != 32)
        hashed = (gram[inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        column = (hashed >> np.uint64(64 - BITS)).astype(np.int64)
        cells.append(row[: len(gram)][inside] * COLUMNS + column)
        signs.append(1.0 - 2.0 * (hashed >> np.uint64(63 - BITS) & np.uint64(1)).astype(float))
    counts += np.bincount(np.concatenate(cells), np.concatenate(signs), counts.size).reshape(counts.shape)


def features(texts: list[str]) -> np.ndarray:
    """One row of unit length per text, zero without n-grams."""
    counts = np.zeros((len(texts), COLUMNS))
    batch, size = [], 0
    for segment in _segments(texts):
        batch.append(segment)
        size += len(segment[1])
        if size >= SEGMENT:
            _add_counts(counts, batch)
            batch, size = [], 0
    if batch:
        _add_counts(counts, batch)
    damped = (np.sign(counts) * np.sqrt(np.abs(counts))).astype(np.float32)
    norm = np.sqrt((damped * damped).sum(1, keepdims=True))
    return damped / np.where(norm == 0, 1, norm)


def groups_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Slices of at most ``ROWS_AT_ONCE`` texts and about a segment of characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if i - start + 1 >= ROWS_AT_ONCE or size >= SEGMENT:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


# --- codes and classifiers ---------------------------------------------------------


def codewords(languages: int) -> np.ndarray:
    """A codeword of -1 and 1 per language.

    Up to five languages get the exhaustive code, every way to part them in two; more
    get rows of a Hadamard matrix, any two of which differ in half of their bits.
    """
    if languages <= 5:
        splits = np.arange(1, max(1, 2 ** (languages - 1)))
        return np.array([[1 if row == 0 or not s >> (row - 1) & 1 else -1 for s in splits] for row in range(languages)])
    size = 1
    matrix = np.ones((1, 1), int)
    while size < languages + 1:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
        size *= 2
    return matrix[1 : languages + 1, 1:]


def _fit_bits(x: np.ndarray, target: np.ndarray, penalty: float = 3e-6, steps: int = 150) -> np.ndarray:
    """Logistic weights of all bits at once, the last row being intercepts, by Nesterov's gradient steps."""
    w = np.zeros((x.shape[1] + 1, target.shape[1]), np.float32)
    ahead, momentum = w.copy(), 1.0
    # the largest curvature of the loss, from the rows' largest squared singular value by power steps
    v = np.ones(x.shape[1] + 1, np.float32)
    for _ in range(10):
        v /= np.linalg.norm(v)
        along = x @ v[:-1] + v[-1]
        v = np.append(x.T @ along, along.sum())
    rate = np.float32(4 * len(x) / (1.1 * np.linalg.norm(v)))
    for _ in range(steps):
        wrong = -target / (1 + np.exp(target * (x @ ahead[:-1] + ahead[-1]))) / np.float32(len(x))
        slope = np.vstack([x.T @ wrong + np.float32(penalty) * ahead[:-1], wrong.sum(0)])
        moved = ahead - rate * slope
        faster = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        ahead = moved + np.float32((momentum - 1) / faster) * (moved - w)
        w, momentum = moved, faster
    return w


@dataclass(frozen=True)
class CodeModel:
    languages: list
    code: np.ndarray  # language x bit, -1 or 1
    weight: np.ndarray  # (COLUMNS + 1) x bit
    trust: np.ndarray  # language x bit, rows sum to 1

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted loss of every text against every codeword."""
        raw = x @ self.weight[:-1] + self.weight[-1]
        each = np.logaddexp(0, -raw[:, None, :] * self.code[None])
        return (each * self.trust[None]).sum(2)

    def predict(self, texts: list[str]) -> tuple[list, np.ndarray, np.ndarray]:
        """Language, score and margin to the second language, for each text."""
        best, score, margin = [], np.ones(len(texts)), np.ones(len(texts))
        if len(self.languages) == 1:
            return self.languages * len(texts), score, margin
        for a, b in groups_of(texts):
            losses = self.losses(features(texts[a:b]))
            share = np.exp(-losses * self.code.shape[1])
            share /= share.sum(1, keepdims=True)
            top = np.argsort(-share, axis=1, kind="stable")[:, :2]
            best += [self.languages[k] for k in top[:, 0]]
            at = np.arange(b - a)
            score[a:b] = share[at, top[:, 0]]
            margin[a:b] = share[at, top[:, 0]] - share[at, top[:, 1]]
        return best, score, margin


def fit_code_model(texts: list[str], languages: list) -> CodeModel:
    """Fit on labelled texts; every fourth is kept aside to find how far each bit is to be trusted."""
    names = sorted(set(languages))
    code = codewords(len(names))
    if len(names) == 1:
        return CodeModel(names, code, np.zeros((COLUMNS + 1, 0), np.float32), np.ones((1, 0)))
    y = np.searchsorted(names, languages)
    order = np.argsort(y, kind="stable")
    nth = np.empty(len(y), int)
    nth[order] = np.arange(len(y)) - np.repeat(np.searchsorted(y[order], np.arange(len(names))), np.bincount(y))
    pieces, owner = [], []
    for i, text in enumerate(texts):
        at = (i * 7919) % max(1, len(text))
        for piece in (text, *(text[at : at + n] for n in PIECES)):
            if any(c.isalpha() for c in piece):
                pieces.append(piece)
                owner.append(i)
    owner = np.array(owner, int)
    x = np.concatenate([features(pieces[a:b]) for a, b in groups_of(pieces)])
    target = code[y[owner]].astype(np.float32)
    aside = nth[owner] % 4 == 3
    trial = _fit_bits(x[~aside], target[~aside])
    right = ((x @ trial[:-1] + trial[-1]) * target > 0) & aside[:, None]
    trust = np.array([(right[y[owner] == k].sum(0) + 1) / (aside[y[owner] == k].sum() + 2) for k in range(len(names))])
    return CodeModel(names, code, _fit_bits(x, target), trust / trust.sum(1, keepdims=True))


# --- documents -------------------------------------------------------------------


def held_out() -> Column:
    return crc_of_id() % 3 == 1


def has_letter() -> Column:
    return text_or_empty().rlike(r"\p{L}")


def training_rows(docs: DataFrame) -> list:
    """``(lang, text)`` rows within the bounds; every language's n-th rows come before any language's next."""
    found = docs.where(~held_out() & F.col("lang").isNotNull() & has_letter()).select(
        F.col("lang"), text_or_empty().alias("text")
    )
    # hash and length first: the texts themselves are only moved for rows that are drawn
    key = found.select("lang", F.xxhash64("text").alias("h"), F.length("text").alias("chars")).distinct()
    # first within ever larger parts of a language, so that no task ranks a frequent one alone
    for parts in PARTS:
        part = F.pmod(F.hash("h", "chars"), F.lit(parts))
        nth = F.row_number().over(Window.partitionBy("lang", part).orderBy("h", "chars"))
        key = key.withColumn("nth", nth).where(F.col("nth") <= PER_LANGUAGE)
    few = key.orderBy("nth", "lang").limit(FIT_ROWS).collect()
    drawn, total = [], 0
    for r in few:
        total += r.chars
        if drawn and total > FIT_CHARS:
            break
        drawn.append((r.lang, r.h))
    if not drawn:
        return []
    chosen = docs.sparkSession.createDataFrame(drawn, "lang string, h long")
    rows = found.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "h"])  # FIT_ROWS rows
    return sorted((r.lang, r.text) for r in rows.dropDuplicates(["lang", "h"]).collect())


def identify(docs: DataFrame, model: CodeModel | None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``ambiguous``."""
    if model is None:
        return docs.select(
            "*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous")
        )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, margin double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, score, margin = shared.value.predict(texts.tolist())
            yield pd.DataFrame({"lang": lang, "score": score, "margin": margin})

    known = has_letter()
    return docs.withColumn("_found", run(text_or_empty())).select(
        *docs.columns,
        F.when(known, F.col("_found.lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, F.col("_found.score")).otherwise(0.0).alias("score"),
        (~known | (F.col("_found.margin") < MARGIN)).alias("ambiguous"),
    )


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_rows(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    rows = training_rows(docs)
    model = fit_code_model([t for _, t in rows], [g for g, _ in rows]) if rows else None
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
