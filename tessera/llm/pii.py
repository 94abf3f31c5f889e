"""Personal data: fixed patterns, and a character-level BiLSTM-CRF that adds spans.

Base spans come from four patterns and their checks. The tagger learns from labelled
spans: windows of sampled texts with their base spans, and the same windows with
written-in variants the patterns miss (grouped or unchecked card numbers, phone
numbers without a plus, addresses with a port or brackets). A text is read in
overlapping windows; only windows with a digit or an at sign are decoded, since no
span is without one. Spans of all windows are reconciled over the whole text: those
cut by a window's edge give way to the next window, base spans stay, and of
overlapping rest the set of greatest total score is taken.

Defined results: null texts are empty and have no spans; overlapping kinds of base
spans all stay; repeated rows give equal rows; an empty table gives no rows. Without
rows to learn from the tagger learns from the written-in variants alone. Other
columns are not looked at. At most ``FIT_ROWS`` texts, with ``FIT_WINDOWS`` windows,
are learnt from.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read_table, spread_rows, text_or_empty
from tessera.llm.tagger import Tagger, class_ids

KINDS = ("email", "ip", "card", "phone")
FIT_ROWS, FIT_WINDOWS = 2_000, 3_000
WIDTH, STRIDE = 96, 48
HIDDEN, EPOCHS, BATCH, RATE = 12, 14, 128, 0.02
DECODE_WINDOWS = 1_024

# Fixed patterns of the base spans. The look-behind only saves repeated scans of a
# run of digits: a match never begins inside one.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SEED = re.compile(r"[0-9@]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the fixed patterns, by start, then kind as listed."""
    found = []
    at, low = text.find("@"), 0
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            found.append(("email", start, match.end()))
            low = match.end()
        at = text.find("@", max(at + 1, low))
    if _SEED.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = _digits(m.group())
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an at sign; together they cover each with room on both sides."""
    last = max(len(text) - WIDTH, 0)
    held = set()
    for m in _SEED.finditer(text):
        k = m.start() // STRIDE
        held.update(min(STRIDE * j, -(-last // STRIDE) * STRIDE) for j in (k - 1, k) if j >= 0)
    return sorted(held)


def _window_ids(text: str, starts: list[int]) -> np.ndarray:
    out = np.zeros((len(starts), WIDTH), np.uint8)
    for row, a in zip(out, starts):
        ids = class_ids(text[a : a + WIDTH])
        row[: len(ids)] = ids
    return out


def _best_set(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Disjoint spans of greatest total score."""
    spans = sorted(set(spans), key=lambda s: (s[1], s[0], s[2], s[3]))
    ends = [s[1] for s in spans]
    best, taken = [0.0], []
    for k, s in enumerate(spans):
        free = bisect.bisect_right(ends, s[0], 0, k)
        take = best[free] + s[3] > best[-1]
        taken.append((take, free))
        best.append(max(best[-1], best[free] + s[3]))
    out, k = [], len(spans)
    while k:
        take, free = taken[k - 1]
        if take:
            out.append(spans[k - 1])
        k = free if take else k - 1
    return out[::-1]


def _tagged(path: np.ndarray, scores: np.ndarray, start: int, size: int) -> list[tuple[int, int, str, float]]:
    """Spans of one decoded window as text positions, without those an inner edge may cut."""
    out, a = [], None
    n = min(WIDTH, size - start)
    for t in range(n + 1):
        tag = int(path[t]) if t < n else 0
        if a is not None and (tag == 0 or tag % 2 == 1 or (tag - 1) // 2 != kind):
            if (a > 0 or start == 0) and (t < n or start + n == size):
                gain = float((scores[range(a, t), path[a:t]] - scores[a:t, 0]).sum())
                out.append((start + a, start + t, KINDS[kind], gain))
            a = None
        if tag and a is None:
            a, kind = t, (tag - 1) // 2
    return out


def add_spans(texts: list[str], bases: list[list[tuple[str, int, int]]], tagger: Tagger) -> list[list[tuple[str, int, int]]]:
    """Base spans of each text with those that the tagger adds."""
    starts = [window_starts(t) for t in texts]
    owner = [(i, a) for i, s in enumerate(starts) for a in s]
    found: list[list] = [[] for _ in texts]
    for k in range(0, len(owner), DECODE_WINDOWS):
        part = owner[k : k + DECODE_WINDOWS]
        ids = np.concatenate([_window_ids(texts[i], [a]) for i, a in part])
        paths, scores = tagger.decode(ids)
        for (i, a), path, score in zip(part, paths, scores):
            if path.any():
                found[i] += _tagged(path, score, a, len(texts[i]))
    out = []
    for text, base, spans in zip(texts, bases, found):
        spans = [
            s for s in spans
            if s[3] > 0 and _SEED.search(text, s[0], s[1]) and not any(s[0] < e and b < s[1] for _, b, e in base)
        ]
        added = [(kind, a, b) for a, b, kind, _ in _best_set(spans)]
        out.append(sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0]), s[2])))
    return out


def _variant(rng: np.random.Generator) -> tuple[str, int, int, str]:
    """A written-in example: text, start and end of its span, kind (empty: none)."""

    def digits(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def letters(n: int) -> str:
        return "".join(chr(97 + int(c)) for c in rng.integers(0, 26, n))

    def pick(*options: str) -> str:
        return options[rng.integers(len(options))]

    kind = rng.integers(0, 7)
    before = after = ""
    if kind == 0:
        name = letters(rng.integers(2, 9)) + pick("", ".", "_", "-") + pick(digits(2), letters(4), "")
        body = f"{name}@{letters(rng.integers(3, 8))}{pick('', digits(1))}" + pick(
            f".{letters(7)}.{letters(3)}", f".{letters(3)}", f".{letters(2)}", ""
        )
        label, after = "email", pick("", "", "", ">", ",")
    elif kind == 1:
        dot = pick(".", ".", ".", "[.]")
        body = dot.join(str(n) for n in rng.integers(0, 256, 4))
        label, after = "ip", pick("", "", ":8080", "/24")
    elif kind == 2:
        gap = pick("", "", " ", "-", ".")
        body = gap.join(digits(4) for _ in range(4))
        label = "card"
    elif kind == 3:
        body = pick(
            f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}",
            f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(2)} {digits(2)} {digits(7)}",
            f"{digits(3)}.{digits(3)}.{digits(4)}", f"+{digits(11)}",
        )
        label = "phone"
    else:
        label = ""
        hexed = "".join(pick(*"0123456789abcdef") for _ in range(rng.integers(16, 41)))
        body = pick(
            f'token = "{hexed}"', hexed, hexed.upper(), f"{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(1)}.{digits(1)}",
            f"20{digits(2)}-0{digits(1)}-1{digits(1)}", digits(rng.integers(1, 8)), f"{digits(3)},{digits(3)}.{digits(2)}",
            f"@{letters(6)}", f"version {digits(1)}.0.", f"{digits(1)}:{digits(2)}", digits(rng.integers(21, 40)),
        )
    return before + body + after, len(before), len(before) + len(body), label


def _tags(spans: list[tuple[str, int, int]], start: int) -> np.ndarray:
    out = np.zeros(WIDTH, np.int8)
    for kind, a, b in spans:
        a, b = max(a - start, 0), min(b - start, WIDTH)
        if a < b:
            out[a:b] = 2 * KINDS.index(kind) + 2
            out[a] -= 1
    return out


_UNSURE = re.compile(r"[0-9](?:[\x20.-]?[0-9]){12,18}(?![0-9a-fA-F])")


def training_windows(texts: list[str], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Class ids and tags of windows: natural ones with base spans, and ones with a variant written in."""
    ids, tags, plain = [], [], [" ".join(["word"] * 20)]
    for text in texts:
        base = base_spans(text)
        sure = [m.span() for m in _UNSURE.finditer(text)]
        for a in window_starts(text)[:8]:
            here = [s for s in base if s[1] < a + WIDTH and a < s[2]]
            # long numbers that fail their check may be card numbers all the same: no label for them
            open_ = any(x < a + WIDTH and a < y and not any(b <= x and y <= e for _, b, e in here) for x, y in sure)
            if not open_ and len(ids) < FIT_WINDOWS:
                ids.append(_window_ids(text, [a])[0])
                tags.append(_tags(here, a))
        a = int(rng.integers(0, max(1, len(text) - WIDTH)))
        if not _SEED.search(text, a, a + WIDTH) and len(text) > 20:
            plain.append(text[a : a + WIDTH])
    for _ in range(FIT_WINDOWS):
        body, a, b, kind = _variant(rng)
        around = plain[rng.integers(len(plain))]
        if rng.integers(8) == 0:
            around = around.upper()
        cut = int(rng.integers(0, len(around)))
        left = around[:cut].rstrip() + [" ", " ", "\n", " | ", ' "'][rng.integers(5)]
        right = ["", "", "", "###", "!!", ",", ".", "%%%", '"'][rng.integers(9)] + " " + around[cut:]
        text, shift = (left + body + right), len(left)
        start = max(0, min(shift - int(rng.integers(0, WIDTH // 2)), len(text) - WIDTH))
        ids.append(_window_ids(text, [start])[0])
        tags.append(_tags([(kind, shift + a, shift + b)] if kind else [], start))
    return np.array(ids), np.array(tags)


def fit_tagger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    """A tagger learnt from a bounded sample: the windows with digits of ``FIT_ROWS`` texts."""
    text = text_or_empty(text_col)
    chosen = (
        docs.where(text.rlike("[0-9@]"))
        .select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("order"))
        .orderBy("order", "id")
        .limit(FIT_ROWS)
        .select("id")
        .distinct()
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a digit's window and its neighbours are all that training looks at
        for batch in batches:
            first = [(window_starts(t) or [0])[:8] for t in batch["text"]]
            parts = [t[max(s[0] - WIDTH, 0) : s[-1] + 2 * WIDTH][: 24 * WIDTH] for t, s in zip(batch["text"], first)]
            yield pd.DataFrame({"id": batch["id"], "part": parts})

    sample = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(chosen), "id")  # FIT_ROWS ids
    rows = sample.mapInPandas(cut, "id long, part string").collect()  # FIT_ROWS rows of 24 windows at most
    rng = np.random.default_rng(4)
    ids, tags = training_windows(sorted({r["part"] for r in rows}), rng)
    tagger = Tagger.fresh(2 * len(KINDS) + 1, HIDDEN, rng)
    tagger.fit(ids, tags.astype(np.int64), EPOCHS, BATCH, RATE, rng)
    return tagger


def find_pii(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, base, spans`` per row, both arrays of ``kind, start, end`` in code points."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tagger.params)
    span = "array<struct<kind: string, start: int, end: int>>"

    def rows_of(spans: list[tuple[str, int, int]]) -> list[dict]:
        return [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Tagger(shared.value)
        for batch in batches:
            texts = batch["text"].tolist()
            bases = [base_spans(t) for t in texts]
            every = add_spans(texts, bases, model)
            yield pd.DataFrame(
                {"id": batch["id"], "base": [rows_of(b) for b in bases], "spans": [rows_of(s) for s in every]}
            )

    held = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return spread_rows(held).mapInPandas(run, f"id long, base {span}, spans {span}")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, fit_tagger(docs))

    def listed(name: str):
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("id").alias("doc_id"),
        *[count(k) for k in KINDS],
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )
