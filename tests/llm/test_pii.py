import hashlib
import re

import numpy as np
import pytest

from tessera.llm import pii
from tessera.llm.tagger import CLASSES, Tagger, class_ids
from tests.llm.conftest import plain

SAMPLES = [
    "", "plain text", "mail a.b-c+d@mail7.example.com, now", "a@b", "a@b.c@d.e", "@@x@y.z", "x@-.-", "1.2.3.4 and 1.2.3.4.5.6.7.8",
    "256.1.1.1 001.002.003.004 1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0",
    "+1 (017) 555-7713 rest", "+1 (017) 555-7713 97.51.17.173", "++49.30.1234567", "é@é.com b@é.com 🎉 me@x.org", "0" * 6000 + ".1.1.1",
    "9" * 40 + " a@b.c", "+12 3", "5500 0000 0000 0004",
]


def brute(text):
    def luhn(digits):
        return sum((c if k % 2 == 0 else c * 2 - 9 * (c > 4)) for k, c in enumerate(map(int, digits[::-1]))) % 10 == 0

    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@pytest.mark.parametrize("text", SAMPLES)
def test_base_spans_equal_plain_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    model = Tagger.fresh(5, 4, rng)
    model.params = {k: v.astype(float) for k, v in model.params.items()}
    ids, tags = rng.integers(0, CLASSES, (3, 7)).astype(np.uint8), rng.integers(0, 5, (3, 7))
    _, slopes = model.gradients(ids, tags)
    for k, v in model.params.items():
        at = tuple(rng.integers(0, n) for n in v.shape)
        at = (ids[0, 2], at[1]) if k.endswith("_in") else at
        v[at] += 1e-3
        up = model.gradients(ids, tags)[0]
        v[at] -= 2e-3
        down = model.gradients(ids, tags)[0]
        v[at] += 1e-3
        assert slopes[k][at] == pytest.approx((up - down) / 2e-3, abs=1e-4)


def test_decoding_is_the_best_path():
    import itertools

    rng = np.random.default_rng(1)
    model = Tagger.fresh(3, 4, rng)
    ids = rng.integers(0, CLASSES, (4, 5)).astype(np.uint8)
    paths, scores = model.decode(ids)
    for path, score in zip(paths, scores):
        def total(p, score=score):
            return model.params["first"][p[0]] + score[range(5), p].sum() + sum(model.params["moves"][a, b] for a, b in zip(p, p[1:]))

        best = max(itertools.product(range(3), repeat=5), key=lambda p: total(list(p)))
        assert total(path.tolist()) == pytest.approx(total(list(best)), abs=1e-4)


def test_windows_cover_every_digit_with_room():
    text = "x" * 130 + "7" + "y" * 400 + "@"
    starts = pii.window_starts(text)
    for p in (130, 531):
        assert any(a <= p < a + pii.WIDTH for a in starts)
        assert any(a <= max(p - 20, 0) and min(p + 20, len(text)) <= a + pii.WIDTH for a in starts)
    assert pii.window_starts("no such thing") == [] and len(class_ids("é1")) == 2


def test_reconciled_spans_are_disjoint_and_best():
    spans = [(0, 10, "card", 3.0), (5, 15, "phone", 4.0), (10, 20, "card", 2.0), (0, 10, "card", 3.0)]
    assert pii._best_set(spans) == [(0, 10, "card", 3.0), (10, 20, "card", 2.0)]


@pytest.fixture(scope="module")
def found(spark):
    return pii.op4_pii(spark, "/root/testdata/sf0.01").collect()


def test_op4_base_columns_equal_plain_patterns(spark, found):
    texts = dict(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect())
    assert len(found) == len(texts)
    for r in found:
        want = brute(texts[r["doc_id"]])
        listed = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert set(listed) <= set(r["spans"].split(","))


def test_added_spans_are_long_numbers_and_clean_texts_have_none(spark, found):
    texts = dict(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect())
    added = []
    for r in found:
        base = {f"{k}:{a}:{b}" for k, a, b in brute(texts[r["doc_id"]])}
        for s in filter(None, set(r["spans"].split(",")) - base):
            kind, a, b = s.split(":")
            added.append((kind, texts[r["doc_id"]][int(a) : int(b)]))
        if not re.search("[0-9@]", texts[r["doc_id"]]):
            assert r["spans"] == ""
    unchecked = re.compile(r"(?<![0-9a-f\"])(?<![0-9] )[0-9]{16}(?![0-9a-f])(?! [0-9])")
    wanted = sum(len([m for m in unchecked.finditer(t) if ("card", *m.span()) not in brute(t)]) for t in texts.values())
    assert sum(kind == "card" for kind, _ in added) >= 0.9 * wanted
    assert sum(not re.fullmatch(r"[0-9 .()+-]{9,24}", s) for _, s in added) <= 0.05 * len(texts)


def test_pii_of_odd_rows(spark, table, odd_docs, no_docs):
    got = {r["doc_id"]: r for r in pii.op4_pii(spark, table(odd_docs)).collect()}
    assert got[12]["n_email"] == got[12]["n_ip"] == 1 and got[1]["spans"] == got[8]["base_sha256"][:0] == ""
    assert pii.op4_pii(spark, table(odd_docs)).count() == odd_docs.count()
    assert plain(pii.op4_pii(spark, table(no_docs))) == []
