"""Batch embedding."""

import hashlib
import numpy as np
import pytest

from tessera.operators.embed import HashingEmbedder, embed, embed_queries, embed_unseen
from tessera.sources.vectors import VectorCache


def lengths(texts):
    assert 0 < len(texts) <= 3
    return [[float(len(t)), 1.0] for t in texts]


def test_order_and_batches(spark):
    df = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(50)], "n int, text string").repartition(3)
    got = {r.n: r.embedding for r in embed(df, "text", lengths, batch_size=3).collect()}
    assert got == {i: [float(i + 1), 1.0] for i in range(50)}


def test_empty_table_and_empty_text(spark):
    df = spark.createDataFrame([(1, "")], "n int, text string")
    assert embed(df.limit(0), "text", lengths).count() == 0
    with pytest.raises(Exception, match="empty text"):
        embed(df, "text", lengths).collect()


def test_wrong_number_of_vectors(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, text string").coalesce(1)
    with pytest.raises(Exception, match="wrong number"):
        embed(df, "text", lambda texts: [[1.0]] * (len(texts) + 1)).collect()


def picky(texts):
    if any("bad" in t for t in texts):
        raise ConnectionError("refused")
    return [[float(len(t)), 1.0] for t in texts]


def test_errors_stay_with_their_rows(spark):
    texts = ["a", "bad one", "", None, "cc", "ddd", "bad"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string").coalesce(1)
    got = {r.n: (r.embedding, r.error) for r in embed(df, "text", picky, 3, error_col="error").collect()}
    assert got[0] == ([1.0, 1.0], None) and got[4] == ([2.0, 1.0], None) and got[5] == ([3.0, 1.0], None)
    assert got[1] == got[6] == (None, "ConnectionError: refused")
    assert got[2] == got[3] == (None, "cannot embed an empty text")
    assert embed(df.limit(0), "text", picky, error_col="error").count() == 0


def test_only_unseen_texts_are_embedded(spark, tmp_path):
    cache = VectorCache(spark, str(tmp_path), "picky/1")
    calls = spark.sparkContext.accumulator(0)

    def counted(texts):
        calls.add(len(texts))
        return picky(texts)

    def run(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
        return {r.n: (r.embedding, r.error) for r in embed_unseen(df, "text", counted, cache).collect()}

    first = run(["a", "bb", "a", "", None])
    assert first[0] == first[2] == ([1.0, 1.0], None) and first[3][1] == first[4][1] == "cannot embed an empty text"
    assert calls.value == 2
    assert run(["bb", "a"])[0] == ([2.0, 1.0], None) and calls.value == 2
    again = run(["ccc", "bad", "a"])
    assert again[0] == ([3.0, 1.0], None) and again[1] == (None, "ConnectionError: refused") and again[2][0] == [1.0, 1.0]
    assert cache.read().count() == 3 and VectorCache(spark, str(tmp_path), "other").read().count() == 0


def test_known_texts_are_not_exchanged_to_find_them(spark, tmp_path, monkeypatch):
    import tessera.operators.embed as module

    cache = VectorCache(spark, str(tmp_path), "lengths/1")
    df = spark.createDataFrame([(n, "text " * (n % 3 + 1)) for n in range(9)], "n int, text string")
    want = {r.n: r.embedding for r in embed_unseen(df, "text", lengths, cache).collect()}
    plans = []
    written = module.persist_table

    def seen(table, label):
        plans.append((label, table._jdf.queryExecution().executedPlan().toString()))
        return written(table, label)

    monkeypatch.setattr(module, "persist_table", seen)
    again = embed_unseen(df, "text", picky, cache)  # its vectors would differ
    assert {r.n: r.embedding for r in again.collect()} == want
    assert [label for label, _ in plans][-1] == "vectors" and "Exchange hashpartitioning" not in plans[-1][1]


def test_queries(spark):
    df = spark.createDataFrame([(1, "ab"), (2, ""), (3, None)], "query_id int, query string")
    got = {r.query_id: (r.embedding, r.error) for r in embed_queries(df, lengths, 3).collect()}
    assert got[1] == ([2.0, 1.0], None)
    assert got[2][0] is None and got[2][1] == got[3][1] == "cannot embed an empty text"


def test_hashing_embedder(spark):
    texts = ["alpha beta alpha", "Beta ALPHA alpha", "other words", "...", "alpha"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    got = {r.n: np.array(r.embedding) for r in embed(df, "text", HashingEmbedder(128)).collect()}
    assert np.allclose(got[0], got[1]) and all(len(v) == 128 for v in got.values())
    assert all(abs(np.linalg.norm(got[i]) - 1) < 1e-6 for i in (0, 1, 2, 4)) and not got[3].any()
    assert np.count_nonzero(got[4]) == 1 and got[0] @ got[4] > 0.8
    number = int(hashlib.md5(b"alpha").hexdigest()[:15], 16)
    assert got[4][number % 128] == (-1.0 if (number >> 58) & 1 else 1.0)
