import hashlib
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from tessera.llm import mixing, quality
from tessera.llm.bpe import read_ranks
from tests.llm.conftest import plain
from tests.llm.test_native import brute_mix
from tests.llm.test_near import brute


def test_stages_equal_brute_force(spark, sf_dir):
    rows = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    good = {r["doc_id"] for r in quality.op7_quality(spark, sf_dir).collect() if r["predicted"]}
    rows = [r for r in rows if r["doc_id"] in good]
    last = {}
    for r in rows:
        key = r["text"].encode().lower()
        last[key] = max(last.get(key, r["doc_id"]), r["doc_id"])
    rows = [r for r in rows if last[r["text"].encode().lower()] == r["doc_id"]]
    top = {i: c for i, _, c in brute([(r["doc_id"], r["text"]) for r in rows], 5, 80)}
    rows = [r for r in rows if top[r["doc_id"]] == r["doc_id"]]
    copies = brute_mix([(r["doc_id"], r["text"], r["source"]) for r in rows], mixing.LIMIT)
    ranks = {t: i for i, t in enumerate(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r, n in zip(rows, copies):
        ids = coder.encode_ordinary(r["text"])
        listed = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want[(r["doc_id"], len(ids), listed, hashlib.sha256(r["text"].encode()).hexdigest())] += n
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want


def test_stages_keep_columns_and_take_odd_rows(spark, table, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        folder = table(docs, [(i, i % 2, 0) for i in range(1, 13)])
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns, name
            assert out.count() <= 2 * docs.count()
        assert stage is not None and set(corpus_pipeline.STAGES[-1][1](spark, docs, folder).columns) >= {"doc_id", "n_tokens"}


def test_clean_documents_are_kept(spark, docs_of, table):
    clean = [(i, " ".join(f"clean{i * 97 + k * k % 89} word{k}" for k in range(60)) + ".", f"s{i % 2}") for i in range(30)]
    docs = docs_of(clean)
    folder = table(docs, [(i, 1, 0) for i in range(30)])
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, folder)
    assert {r["doc_id"] for r in out.collect()} == set(range(30))


def test_all_thirteen_and_the_pipeline_are_registered(no_docs):
    names = [n for n in queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names
    assert set(oracle_sql()) <= set(queries()) and plain(no_docs) == []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
