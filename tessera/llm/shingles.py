"""Word shingles as 64-bit integers, computed for whole batches of texts with array operations."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_RANDOM = np.random.Generator(np.random.PCG64(20_240_601))
_BYTES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_PLACES = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, text index, first byte, end byte)`` of all words; A-Z is folded, words end at ASCII white space.

    The byte positions count from the start of the word's text.
    """
    joined = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    gap = _SPACE[joined]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    first, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    power = _powers(len(joined) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[_FOLD[joined]] * power[:-1], dtype=np.uint64)])
    inverse = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(joined), _INVERSE)]))
    hashes = mix((total[end] - total[first]) * inverse[first] + (end - first).astype(np.uint64))
    row = np.searchsorted(starts, first, side="right") - 1
    base = starts[row] if len(row) else first
    return hashes, row, first - base, end - base


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; a shorter text is one shingle, a text without words none."""
    hashes, row, _, _ = word_hashes(texts)
    cuts = np.searchsorted(row, np.arange(len(texts) + 1))
    return [sorted_shingles(hashes[a:b], width) for a, b in zip(cuts, cuts[1:])]


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The shingle that starts at each word, in order."""
    width = min(width, len(words)) or 1
    out = np.full(max(0, len(words) - width + 1), width, np.uint64)
    for k in range(width):
        out += words[k : k + len(out)] * _PLACES[k]
    return mix(out)


def sorted_shingles(words: np.ndarray, width: int) -> np.ndarray:
    return np.unique(shingles(words, width))
