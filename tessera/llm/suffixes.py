"""Array helpers of substring dedup: anchors of long byte strings, and a blockwise suffix order.

Both work on one slice of texts or one bucket of contexts; neither knows of Spark.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.shingles import mix

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


class RangeHash:
    """64-bit hashes of any byte ranges of one array in constant time each."""

    def __init__(self, raw: np.ndarray):
        power = np.full(len(raw), _BASE, np.uint64)
        back = np.full(len(raw) + 1, _INVERSE, np.uint64)
        power[:1], back[0] = 1, 1
        np.multiply.accumulate(power, out=power)
        self.back = np.multiply.accumulate(back, out=back)
        power *= _BYTES[raw]
        self.total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(power, out=self.total[1:])

    def __call__(self, first, end) -> np.ndarray:
        return mix((self.total[end] - self.total[first]) * self.back[first] + (end - first).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all ranges of one width."""
        raw = self.total[width:] - self.total[:-width]
        raw *= self.back[: len(raw)]
        return mix(raw)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by running minima within blocks from both ends."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(texts: list[bytes], length: int, gram: int):
    """Anchors that every ``length``-byte string of the texts shares with its copies.

    An anchor is the smallest ``gram``-byte hash of some ``length``-byte string, the
    rightmost of equal ones, so it depends on the string alone. Returns arrays: text
    index, offset of the anchor in its text, its hash, and the hash of its context,
    the bytes of all ``length``-byte strings that may have it as their anchor.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    reach = length - gram
    ranges = RangeHash(raw)
    order = ranges.windows(gram)
    places = np.arange(len(order), dtype=np.uint64)
    low = _U((1 << 24) - 1)
    order &= ~low
    order |= low - (places & low)
    least = sliding_minimum(order, reach + 1)
    inside = np.ones(len(least), bool)  # strings that don't run into the next text
    for s, n in zip(starts + sizes, sizes):
        inside[max(s - min(n, length - 1), 0) : s] = False
    first = np.nonzero(inside)[0]
    place = (low - (least[first] & low)).astype(np.int64)
    place += (first - place + (1 << 24) - 1) // (1 << 24) * (1 << 24)
    at = np.unique(place)
    row = np.searchsorted(starts, at, side="right") - 1
    left = np.maximum(at - reach, starts[row])
    right = np.minimum(at + length, starts[row] + sizes[row])
    context = mix(ranges(left, right) + (at - left).astype(np.uint64))
    return row, at - starts[row], ranges(at, at + gram), context


def difference_cover(period: int) -> np.ndarray:
    """Residues such that any two positions have a common shift below ``period`` into them."""
    step = int(np.ceil(np.sqrt(period)))
    return np.unique(np.concatenate([np.arange(step), np.arange(step, period, step)]))


class CoverRanks:
    """Order of the suffixes of a text at difference-cover positions, by their first ``8 * period`` bytes.

    Names of ``period``-byte blocks are doubled three times; a step of a whole number
    of periods stays inside the cover, so nothing else of the text has to be ranked.
    """

    def __init__(self, text: np.ndarray, period: int = 32):
        self.period = period
        padded = np.concatenate([text, np.zeros(10 * period, np.uint8)])
        self.words = np.zeros(len(padded) - 7, np.uint64)  # eight bytes from every position, big-endian
        for b in range(8):
            self.words <<= _U(8)
            self.words |= padded[b : len(padded) - 7 + b]
        cover = difference_cover(period)
        residue = np.arange(period)
        wait = (cover[None, :] - residue[:, None]) % period
        self.wait = wait.min(axis=1)  # bytes from a residue to the next cover position
        last = len(text) + period
        sample = (np.arange(0, last, period)[:, None] + cover).ravel()
        steps = len(cover)
        order = np.lexsort([self.words[sample + k] for k in range(period - 8, -1, -8)])
        new = np.zeros(len(sample), bool)
        for k in range(0, period, 8):
            w = self.words[sample[order] + k]
            new[1:] |= w[1:] != w[:-1]
        rank = np.empty(len(sample), np.int64)
        rank[order] = np.cumsum(new)
        names = [rank]
        for reach in (1, 2, 4):  # periods; as many cover positions lie between
            follow = np.append(rank[steps * reach :], np.full(min(steps * reach, len(rank)), -1)) + 1
            rank = np.unique(rank * (len(sample) + 1) + follow, return_inverse=True)[1]
            names.append(rank)
        self.place = np.full(last + period, 0, np.int64)
        self.place[sample] = np.arange(len(sample))
        self.rank, self.double = names[3], names[1]

    def ahead(self, at: np.ndarray, wait: int) -> np.ndarray:
        """One integer by which suffixes at positions of one residue are ordered: the bytes before the
        next cover position, then its rank."""
        lead = self.words[at] >> _U(64 - 8 * wait) if wait else np.zeros(len(at), np.uint64)
        return lead << _U(24) | self.rank[self.place[at + wait]].astype(np.uint64)

    def same(self, a: np.ndarray, b: np.ndarray, wait: int, length: int) -> np.ndarray:
        """Whether the first ``length`` bytes at each pair of positions of one residue agree."""
        out = self.words[a] == self.words[b]
        block, k = 2 * self.period, wait
        while k + block <= length:
            out &= self.double[self.place[a + k]] == self.double[self.place[b + k]]
            k += block
        while k < length:
            k = min(k, length - 8)
            out &= self.words[a + k] == self.words[b + k]
            k += 8
        return out


def repeated_strings(parts: list[bytes], before: np.ndarray, kind: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context, which of its ``length``-byte strings also stand in another one of its kind.

    ``before`` counts the bytes of a context that stand before its anchor; equal strings
    have anchors of one kind at one distance. Contexts are laid out with their anchors at
    multiples of the period, so the suffixes of a bucket, all those at one distance from
    their anchors, have one residue: a short lead of bytes takes them all to the
    cover, whose ranks settle ties of any depth. Buckets are sorted one at a time;
    neighbours that agree for ``length`` bytes are repeats.
    """
    period = 32
    sizes = np.array([len(p) for p in parts], np.int64)
    pad = -before % period
    room = (pad + sizes + period - 1) // period * period
    starts = np.concatenate([[0], np.cumsum(room)[:-1]]) + pad
    text = np.zeros(int(room.sum()), np.uint8)
    for s, p in zip(starts, parts):
        text[s : s + len(p)] = np.frombuffer(p, np.uint8)
    ranks = CoverRanks(text, period)
    anchor = starts + before
    hits = [np.zeros(max(n - length + 1, 0), bool) for n in sizes]
    flat = np.zeros(int(np.maximum(sizes - length + 1, 0).sum()), bool)
    first = np.concatenate([[0], np.cumsum([len(h) for h in hits])]).astype(np.int64)
    for distance in range(int(before.max(initial=0)) + 1):
        mine = np.nonzero((before >= distance) & (before - distance + length <= sizes))[0]
        if len(mine) < 2:
            continue
        at = anchor[mine] - distance
        wait = int(ranks.wait[-distance % period])
        order = np.lexsort((ranks.ahead(at, wait), kind[mine]))
        at, mine = at[order], mine[order]
        equal = np.nonzero(kind[mine[1:]] == kind[mine[:-1]])[0]
        equal = equal[ranks.same(at[equal], at[equal + 1], wait, length)]
        here = first[mine] + before[mine] - distance
        flat[here[equal]] = flat[here[equal + 1]] = True
    return [flat[a:b] for a, b in zip(first, first[1:])]
