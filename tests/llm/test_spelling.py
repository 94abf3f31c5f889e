import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import spelling
from tests.llm.conftest import plain


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def expected(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower(text or "")):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            cut = h % len(run)
            n[run[:cut] + run[cut + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(
        ((w, form.get(w), root(w), k, len(near[w]), n[form[w]] if w in form else None) for w, k in n.items()), key=repr
    )


def random_rows(seed, words, texts, size):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdéÀß÷", k=rng.randint(4, 8))) for _ in range(words)]
    out = []
    for i in range(texts):
        picked = []
        for _ in range(size):
            w = base[int(len(base) * rng.random() ** 3)]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "e", w[k] + "a"]) + w[k + 1 :]
            picked.append(w if rng.random() < 0.9 else w.upper())
        out.append((i, " ".join(picked), "s"))
    return out


@pytest.mark.parametrize("cells", [1 << 17, 500])
def test_equals_brute_force(spark, docs_of, monkeypatch, cells):
    monkeypatch.setattr(spelling, "CHUNK_CELLS", cells)
    rows = random_rows(1, 120, 60, 120)
    got = plain(spelling.spelling_variants(docs_of(rows)))
    assert got == expected([r[:2] for r in rows])
    assert sum(r[1] is not None for r in got) > 20


def test_long_chain_of_forms(spark, docs_of):
    words = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb", "bbbbbb"]
    text = " ".join(" ".join([w] * (3 << k)) for k, w in enumerate(words))
    got = {r.word: r for r in spelling.spelling_variants(docs_of([(6, text, "s")])).collect()}
    assert {r.form for r in got.values()} == {*words[1:], None} and {r.root for r in got.values()} == {"bbbbbb"}


def test_near_pairs_of_all_kinds():
    rng = random.Random(4)
    for _ in range(30):
        a = ["".join(rng.choices("abcé", k=5)) for _ in range(40)]
        for b in (["".join(rng.choices("abcé", k=n)) for _ in range(50)] for n in (5, 6)):
            i, j = spelling.near_pairs(a, b, False)
            want = {(x, y) for x in range(40) for y in range(50) if one_edit(a[x], b[y])}
            assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_moves_reach_every_near_block():
    moves = {tuple(m) for m in spelling._moves()}
    rng = np.random.default_rng(0)
    for _ in range(300):
        w = rng.integers(0, 90, 6)
        v = np.delete(w, 2) if rng.random() < 0.5 else np.where(np.arange(6) == 3, rng.integers(0, 90), w)
        a, b = (np.bincount(x % spelling.GROUPS, minlength=spelling.GROUPS) for x in (w, v))
        assert tuple(a - b) in moves or tuple(b - a) in moves


def test_odd_rows(spark, docs_of, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert plain(spelling.spelling_variants(odd_docs)) == expected(rows)
    assert plain(spelling.spelling_variants(no_docs)) == []
    giant = "xy" * 40_000
    texts = [f"{giant} {giant}x {giant} {giant}x {giant} {giant}x"] * 2
    assert plain(spelling.spelling_variants(docs_of(texts))) == expected(list(enumerate(texts)))
