import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, winnowing
from tests.llm.conftest import plain


def selected(hashes, window):
    """Positions of winnowing by its definition, from the hash of every gram."""
    out = set()
    for a in range(max(1, len(hashes) - window + 1) if hashes else 0):
        part = hashes[a : a + window]
        out.add(a + max(i for i, h in enumerate(part) if h == min(part)))
    return out


def test_fingerprints_equal_the_definition(spark):
    rng = random.Random(1)
    texts = ["", "a", "short", "ab" * 60, "x" * 100, "é🎉" * 40] + ["".join(rng.choice("abcd ") for _ in range(n)) for n in (11, 12, 13, 42, 43, 44, 300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    grams = sorted({g for t in texts for g in ([t] if 0 < len(t) < 12 else [t[i : i + 12] for i in range(len(t) - 11)])})
    hashed = spark.createDataFrame([(g,) for g in grams], "g string").select("g", F.shiftrightunsigned(F.xxhash64("g"), 33)).collect()
    value = {r[0]: r[1] for r in hashed}
    for t, (text, got) in zip(texts, df.select("text", winnowing.as_text(winnowing.fingerprint(F.col("text")))).collect()):
        own = [value[g] for g in ([t] if 0 < len(t) < 12 else [t[i : i + 12] for i in range(len(t) - 11)])]
        want = ",".join(f"{own[p]:X}:{p:X}" for p in sorted(selected(own, 32)))
        assert text == t and got == want


def neighbours(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for k, (i, t) in enumerate(rows):
        n = len(t)
        after = rows[(k + 1) % len(rows)][1]
        yield i, t, t[: n - n // 4] + after[: n // 4]


@pytest.mark.parametrize("bucket_rows", [4_000, 3])
def test_op8_edits_and_likeness(spark, docs_of, table, monkeypatch, bucket_rows):
    monkeypatch.setattr(winnowing, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(winnowing, "STEP", 4)
    rng = random.Random(2)
    rows = [(7 * k - 20, "".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(0, 400)))) for k in range(25)]
    rows += [(1000, rows[3][1]), (1001, ""), (1002, ""), (1003, "x" * 500)]
    folder = table(docs_of([(i, t, "s") for i, t in rows]))
    got = {r["doc_id"]: r for r in winnowing.op8_winnowing(spark, folder).collect()}
    edits = list(neighbours(rows))
    fresh = spark.createDataFrame([(i, e) for i, _, e in edits], "id long, e string")
    direct = dict(tuple(r) for r in fresh.select("id", winnowing.as_text(winnowing.fingerprint(F.col("e")))).collect())

    def hashes(text):
        return {p.split(":")[0] for p in text.split(",") if p}

    def share(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    for k, (i, t, e) in enumerate(edits):
        r, after = got[i], got[edits[(k + 1) % len(edits)][0]]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["edited_fingerprint"] == direct[i]
        assert r["near_edited"] == pytest.approx(share(hashes(r["fingerprint"]), hashes(direct[i])))
        assert r["near_next"] == pytest.approx(share(hashes(r["fingerprint"]), hashes(after["fingerprint"])))
    assert got[1000]["fingerprint"] == got[1]["fingerprint"] and len(got) == len(rows)


def test_winnowing_of_odd_rows(spark, table, odd_docs, no_docs):
    got = winnowing.op8_winnowing(spark, table(odd_docs)).collect()
    want = Counter((i, hashlib.sha256(e.encode()).hexdigest()) for i, _, e in neighbours([(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]))
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want
    assert plain(winnowing.op8_winnowing(spark, table(no_docs))) == []
    one = winnowing.op8_winnowing(spark, table(odd_docs.where("doc_id = 12"))).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_shared_runs_share_a_hash(spark):
    rng = random.Random(5)
    run = "".join(rng.choice("abcdefghijkl") for _ in range(winnowing.GRAM + winnowing.WINDOW - 1))
    texts = ["".join(rng.choice("mnopqrs") for _ in range(n)) + run + "tail" * n for n in range(20)]
    prints = [set(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(
        F.transform(winnowing.fingerprint(F.col("t")), lambda k: F.shiftright(k, 32))).collect()]
    assert set.intersection(*prints)


def brute_mix(rows, limit, budget=None):
    """Copies per row index, walking documents in their order."""
    def h(*parts):
        return int(hashlib.md5(":".join(("mix", *parts)).encode()).hexdigest()[:8], 16)

    tokens = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    total = defaultdict(int)
    for (_, _, s), n in zip(rows, tokens):
        total["n:" if s is None else "s:" + s] += n
    total = {k: n for k, n in total.items() if n}
    every = sum(total.values())

    def shown(a):
        z = sum((n / every) ** a for n in total.values())
        size = budget if budget is not None else every * z * (max(total.values()) / every) ** (1 - a)
        return {k: (n / every) ** a / z * size / n for k, n in total.items()}

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if max(shown(mid).values()) <= limit else (mid, high)
    ratio = shown(0.0 if max(shown(0.0).values()) <= limit else round(high, 9))
    copies = [1] * len(rows)
    for key, n in total.items():
        r = round(ratio[key], 9)
        passes = math.floor(r)
        rest, blocks = math.floor((r - passes) * n), math.ceil(n / mixing.BLOCK_TOKENS)

        def place(k, key=key, blocks=blocks):
            i = "null" if rows[k][0] is None else str(rows[k][0])
            block = h(i) * blocks // 2**32
            return h(key, str(block)), block, h(i), i

        own = [k for k, (_, _, s) in enumerate(rows) if ("n:" if s is None else "s:" + s) == key and tokens[k]]
        used, last = 0, None
        for k in sorted(own, key=place):
            if used < rest or place(k) == last:
                copies[k], last = passes + 1, place(k)
            else:
                copies[k] = passes
            used += tokens[k]
    return copies


@pytest.fixture(scope="module")
def sources():
    rng = random.Random(6)
    sizes = {"big": 60, "mid": 20, "small": 5, None: 3}
    return [(k, "w " * rng.randrange(0, 60), s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_op10_equals_walking_the_order(spark, docs_of, table, sources, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", block)
    got = {r["doc_id"]: r for r in mixing.op10_mixing(spark, table(docs_of(sources))).collect()}
    every = sum(len(t.split()) for _, t, _ in sources)
    want = brute_mix(sources, mixing.LIMIT, every)
    assert [got[k]["copies"] for k in range(len(sources))] == want
    assert abs(sum(got[k]["n_tokens"] * got[k]["copies"] for k in got) - every) <= 60 * 4
    assert max(r["copies"] for r in got.values()) <= math.ceil(mixing.LIMIT)


def test_mixed_shows_every_row_and_none_too_often(docs_of, sources):
    docs = docs_of(sources)
    shown = Counter(r["doc_id"] for r in mixing.mixed(docs).collect())
    assert [shown[k] for k in range(len(sources))] == brute_mix(sources, mixing.LIMIT)
    assert min(shown.values()) == 1 and max(shown.values()) == 2


def test_entropy_target_is_met(spark):
    rows = spark.createDataFrame([("a", 800), ("b", 150), ("c", 50)], "key string, tokens long")
    a, _ = mixing.temperature(rows, entropy=0.9)
    z = sum(p**a for p in (0.8, 0.15, 0.05))
    assert -sum(p**a / z * math.log(p**a / z) for p in (0.8, 0.15, 0.05)) == pytest.approx(0.9, abs=1e-6)


def test_mixing_of_odd_rows(spark, table, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd_docs.collect()]
    got = mixing.op10_mixing(spark, table(odd_docs))
    every = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows)
    want = brute_mix(rows, mixing.LIMIT, every)
    assert Counter((r["doc_id"], r["source"], r["copies"]) for r in got.collect()) == Counter((i, s, c) for (i, _, s), c in zip(rows, want))
    shown = mixing.mixed(odd_docs)
    assert shown.columns == odd_docs.columns and shown.count() >= odd_docs.count()
    assert mixing.mixed(no_docs).count() == 0 and plain(mixing.op10_mixing(spark, table(no_docs))) == []
    blank = odd_docs.where("trim(coalesce(text, '')) = ''")
    assert mixing.mixed(blank).count() == blank.count()
