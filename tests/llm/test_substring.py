import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import substring
from tessera.llm.suffixes import CoverRanks, RangeHash, anchors, difference_cover, repeated_strings, sliding_minimum
from tests.llm.conftest import plain


def brute(rows, length=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if counts[b[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(spans, rows):
    out = []
    for r in substring.removed(rows, spans).collect():
        out.append((r["id"], r["n_bytes"], r["n_removed"], len(r["runs"]) // 2, hashlib.sha256(r["kept"]).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def mixed_rows():
    rng = random.Random(4)

    def fresh(n, letters="abcdefghij "):
        return "".join(rng.choice(letters) for _ in range(n))

    shared = [fresh(n) for n in (199, 200, 201, 260, 700)]
    rows = [fresh(150), fresh(200), "ab" * 400, "ab" * 300, "x" * 900, "x" * 150 + "y" + "x" * 199, "é" * 500]
    for _ in range(40):
        parts = [fresh(rng.randrange(0, 300)) for _ in range(3)] + rng.sample(shared, rng.randrange(0, 3))
        rng.shuffle(parts)
        rows.append("".join(parts))
    near = fresh(1000)
    rows += [near[:k] + "#" + near[k + 1 :] for k in range(100, 1000, 150)] + [rows[8], rows[8], shared[4] * 2]
    return list(enumerate(rows))


def test_op1_equals_brute_force(spark, docs_of, table, mixed_rows):
    folder = table(docs_of([(i, t, "s") for i, t in mixed_rows]))
    assert plain(substring.op1_suffix_array(spark, folder)) == brute(mixed_rows)


@pytest.mark.parametrize("most, bucket", [(1, 2048), (16_384, 3)])
def test_hot_anchors_and_small_buckets_give_the_same(docs_of, mixed_rows, most, bucket):
    rows = substring.keyed_rows(docs_of([(i, t, "s") for i, t in mixed_rows]))
    spans = substring.covered_spans(rows, most_contexts=most, bucket_contexts=bucket)
    assert result(spans, rows) == brute(mixed_rows)


def test_odd_rows(spark, table, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert plain(substring.op1_suffix_array(spark, table(odd_docs))) == brute(rows)
    assert plain(substring.op1_suffix_array(spark, table(no_docs))) == []


def test_rows_that_share_an_id_keep_their_own_result(spark, docs_of, table):
    rng = random.Random(1)
    long_ = "".join(rng.choice("abcdef") for _ in range(400))
    rows = [(1, long_), (1, "short"), (2, long_[50:350]), (2, long_[::-1]), (None, long_[:250]), (None, "zz")]
    got = plain(substring.op1_suffix_array(spark, table(docs_of([(i, t, "s") for i, t in rows]))))
    assert got == brute(rows)


def test_cover_ranks_order_suffixes():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, 700).astype(np.uint8)
    ranks = CoverRanks(text)
    cover = set(difference_cover(32).tolist())
    raw = text.tobytes() + b"\0" * 400
    at = [p for p in range(700) if p % 32 in cover]
    wanted = sorted(at, key=lambda p: raw[p : p + 256])
    got = sorted(at, key=lambda p: ranks.rank[ranks.place[p]])
    assert [raw[p : p + 256] for p in got] == [raw[p : p + 256] for p in wanted]


@pytest.mark.parametrize("period", [16, 32, 64])
def test_cover_meets_all_pairs(period):
    cover = set(difference_cover(period).tolist())
    for i in range(period):
        for j in range(period):
            assert any((i + k) % period in cover and (j + k) % period in cover for k in range(period))


def test_repeated_strings_equal_counting():
    rng = np.random.default_rng(1)
    for _ in range(12):
        n, base = int(rng.integers(2, 40)), rng.integers(97, 99, 400).astype(np.uint8)
        parts, before, kind = [], [], rng.integers(0, 3, n)
        for _ in range(n):
            t = base.copy()
            t[rng.integers(0, 400, rng.integers(0, 4))] = 120
            b, e = int(rng.integers(0, 105)), int(rng.integers(150, 201))
            parts.append(t[104 - b : 104 + e].tobytes())
            before.append(b)
        counts = Counter((kind[i], k - before[i], p[k : k + 200]) for i, p in enumerate(parts) for k in range(len(p) - 199))
        for i, hit in enumerate(repeated_strings(parts, np.array(before), kind, 200)):
            assert hit.tolist() == [counts[kind[i], k - before[i], parts[i][k : k + 200]] > 1 for k in range(len(parts[i]) - 199)]


def test_every_string_has_its_anchor_and_equal_strings_share_it():
    rng = random.Random(2)
    shared = "".join(rng.choice("abc") for _ in range(260))
    texts = [("".join(rng.choice("abc") for _ in range(n)) + shared).encode() for n in (0, 77, 333)] + [b"a" * 500, b"short", b""]
    row, at, gram, _ = anchors(texts, 200, 96)
    for i, t in enumerate(texts):
        own = at[row == i]
        for p in range(len(t) - 199):
            assert ((own >= p) & (own <= p + 104)).any()
    ends = [{(int(a) - len(t) + 260, int(g)) for a, g in zip(at[row == i], gram[row == i]) if a >= len(t) - 260} for i, t in enumerate(texts[:3])]
    assert ends[0] and set.intersection(*ends)


def test_sliding_minimum_and_range_hashes():
    x = np.random.default_rng(3).integers(0, 1 << 60, 100).astype(np.uint64)
    assert sliding_minimum(x, 7).tolist() == [x[i : i + 7].min() for i in range(94)]
    h = RangeHash(np.frombuffer(b"abcabcab", np.uint8))
    assert h(np.array([0]), np.array([3])) == h(np.array([3]), np.array([6])) != h(np.array([1]), np.array([4]))
