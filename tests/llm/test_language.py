import zlib

import numpy as np
import pytest

from tessera.llm import language


def test_codewords_are_far_apart():
    for k in (2, 3, 4, 5, 6, 9, 40):
        code = language.codewords(k)
        apart = [(code[a] != code[b]).sum() for a in range(k) for b in range(a)]
        assert set(np.unique(code)) <= {-1, 1} and min(apart) >= (code.shape[1] + 1) // 2
        assert all(len(set(code[:, bit])) == 2 for bit in range(code.shape[1])) or k > 5
    assert language.codewords(4).shape == (4, 7)


def test_decoding_survives_wrong_bits():
    code = language.codewords(5)
    model = language.CodeModel(list("abcde"), code, None, np.full(code.shape, 1 / code.shape[1]))
    rng = np.random.default_rng(1)
    for k in range(5):
        raw = 3.0 * code[k]
        raw[rng.choice(code.shape[1], 3, replace=False)] *= -1  # exhaustive codes of 15 bits differ in 8
        each = np.logaddexp(0, -raw[None, None, :] * code[None])
        assert (each * model.trust[None]).sum(2).argmin() == k


def test_features_do_not_depend_on_segments(monkeypatch):
    texts = ["Die Katze lief über den Hof. " * 40, "", "x", "12 34", "Ünï" * 50]
    whole = language.features(texts)
    monkeypatch.setattr(language, "SEGMENT", 37)
    assert np.allclose(language.features(texts), whole, atol=1e-6)
    norms = np.linalg.norm(whole, axis=1)
    assert np.allclose(norms[[0, 2, 4]], 1) and norms[1] == 0 and norms[3] == 0


def test_ngrams_against_a_plain_count():
    text = "Ab  c"
    raw, want = " ab  c ", np.zeros(language.COLUMNS)
    for n in language.LENGTHS:
        for i in range(len(raw) - n + 1):
            gram = raw[i : i + n]
            if gram[0] == gram[-1] == " ":
                continue
            h = (int.from_bytes(gram.encode(), "big") + n) * 0x9E3779B97F4A7C15 % 2**64
            want[h >> (64 - language.BITS)] += 1 - 2 * (h >> (63 - language.BITS) & 1)
    want = np.sign(want) * np.sqrt(abs(want))
    assert np.allclose(language.features([text])[0], want / np.linalg.norm(want), atol=1e-6)


def test_contract_and_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = language.op13_language(spark, folder).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    right = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if r.held_out:
            right.append(r.lang_pred == docs[r.doc_id].lang)
    assert np.mean(right) > 0.98


def test_only_the_training_fold_is_learnt_from(spark, table, docs_of):
    en, de = "the quick brown fox jumps over it", "der schnelle braune Fuchs springt"
    docs = docs_of([(i, f"{(en, de)[i % 2]} {i}", "s") for i in range(80)])
    from pyspark.sql import functions as F

    other = F.when(F.col("doc_id") % 2 == 0, "xx").otherwise("yy")
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1
    named = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    flipped = named.withColumn("lang", F.when(held, other).otherwise(F.col("lang")))
    got = [sorted(map(tuple, language.op13_language(spark, table(d)).collect())) for d in (named, flipped)]
    assert got[0] == got[1] and {r[2] for r in got[0]} == {"en", "de"}
    assert all(r[2] == ("en", "de")[r[0] % 2] for r in got[0])


@pytest.mark.parametrize("langs", [None, ["one"], ["one", "two", "three"], [f"l{i}" for i in range(7)]])
def test_odd_rows(spark, table, odd_docs, no_docs, langs):
    from pyspark.sql import functions as F

    lang = F.lit(None).cast("string") if langs is None else F.element_at(F.array(*map(F.lit, langs)), (F.coalesce("doc_id", F.lit(0)) % len(langs) + 1).cast("int"))
    docs = odd_docs.withColumn("lang", lang)
    rows = language.op13_language(spark, table(docs)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        if r.doc_id in (1, 2, 3) or langs is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None:
            assert r.lang_pred in langs
        assert (r.held_out is None) == (r.doc_id is None)
    assert len({tuple(r) for r in rows if r.doc_id == 6}) == 1
    assert language.op13_language(spark, table(no_docs)).count() == 0
