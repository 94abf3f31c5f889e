import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality, toxicity
from tests.llm.conftest import plain


def held(i, mod, rest):
    return zlib.crc32(str(i).encode()) % mod == rest


def test_flattened_trees_equal_walking_them():
    rng = np.random.default_rng(0)
    x = rng.random((500, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    forest = quality.fit_forest(x, y, trees=20)

    def walk(row):
        total = forest.base
        for i in forest.roots:
            while forest.left[i] != i:
                i = forest.left[i] if row[forest.feature[i]] <= forest.threshold[i] else forest.right[i]
            total += forest.value[i]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(x), [walk(r) for r in x])
    assert (forest.score(x).round() == y).mean() > 0.97


def test_histogram_split_equals_trying_all():
    x = np.array([[1.0], [2.0], [3.0], [4.0]] * 5)
    y = np.array([0.0, 0.0, 1.0, 1.0] * 5)
    forest = quality.fit_forest(x, y, trees=1, depth=1)
    assert 2.0 <= forest.threshold[0] < 3.0


@pytest.mark.parametrize("query, mod, rest, cut, label", [
    (quality.op7_quality, 5, 0, 0.3, "quality"), (toxicity.op2_toxicity, 3, 1, 0.7, "toxic")])
def test_contract_and_held_out_accuracy(spark, query, mod, rest, cut, label):
    folder = "/root/testdata/sf0.1" if label == "toxic" else "/root/testdata/sf0.01"
    rows = query(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == held(r["doc_id"], mod, rest) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= cut)
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    tested = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p == t for p, t in tested]) > 0.95
    assert np.mean([p == 0 for p, t in tested if t == 0]) > (0.98 if label == "toxic" else 0.7)


@pytest.mark.parametrize("query", [quality.op7_quality, toxicity.op2_toxicity])
def test_odd_rows_and_no_labels(spark, table, odd_docs, no_docs, query):
    rows = query(spark, table(odd_docs)).collect()
    assert len(rows) == odd_docs.count() and {r["score"] for r in rows} == {0.5}
    one_class = query(spark, table(odd_docs, [(i, 1, 0) for i in range(1, 13)])).collect()
    assert len({r["score"] for r in one_class}) == 1
    both = query(spark, table(odd_docs, [(i, i % 2, i % 2) for i in range(1, 13)] * 2)).collect()
    assert len(both) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in both)
    assert all(r["held_out"] is None for r in both if r["doc_id"] is None)
    assert plain(query(spark, table(no_docs))) == []


def test_labels_of_the_held_out_fold_change_nothing(spark, table, docs_of):
    words = ["plain words go here", "awful nasty words go"]
    docs = docs_of([(i, words[i % 2] + f" number {i}", "s") for i in range(60)])
    labels = [(i, i % 2, i % 2) for i in range(60)]
    for query, mod, rest in ((quality.op7_quality, 5, 0), (toxicity.op2_toxicity, 3, 1)):
        flipped = [(i, 1 - q, 1 - t) if held(i, mod, rest) else (i, q, t) for i, q, t in labels]
        assert plain(query(spark, table(docs, labels))) == plain(query(spark, table(docs, flipped)))


def test_ngrams_are_counted_once_per_text_and_stay_inside():
    got = [(int(r), int(c)) for row, col in toxicity.present_columns(["ab ab", "ab", ""]) for r, c in zip(row, col)]
    assert len(got) == len(set(got))
    assert {c for r, c in got if r == 1} < {c for r, c in got if r == 0}


def test_fit_sample_is_bounded(spark, docs_of):
    from tessera.llm.common import fit_sample

    docs = docs_of([(i, "x" * 10, "s") for i in range(50)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    assert fit_sample(docs, labels, "quality", F.lit(True), 20, 10_000).count() == 20
    assert fit_sample(docs, labels, "quality", F.lit(True), 20, 55).count() == 5


def test_only_copies_are_left_out_of_the_training_rows(spark):
    line = "https://example.org/a-very-long-address-that-many-texts-hold"
    texts = [f"{line} " + " ".join(f"t{i}w{k}" for k in range(30)) for i in range(12)]
    rows = [(i, t, i % 2) for i, t in enumerate(texts)] + [(20, texts[0].upper(), 0), (21, texts[0], 1), (22, texts[2] + " more", 0)]
    kept = toxicity.without_copies(spark.createDataFrame(rows, "id long, text string, y int"))
    assert sorted(r["id"] for r in kept.collect()) == [*range(12), 21]
