import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items, top=10):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    count, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        scored = []
        for doc, c, n in held:
            m = 25 + (75 * n * count) // length
            score = 0
            for t in terms(text):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, math.inf if doc is None else doc, doc))
        for rank, (s, _, doc) in enumerate(sorted(scored, key=lambda x: x[:2])[:top], 1):
            out.append((item, rank, doc, -s))
    return sorted(out, key=repr)


def corpus(seed, size=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(80)] + ["Été", "ß9"]
    draw = lambda k: " ".join(words[int(len(words) * rng.random() ** 2)] for _ in range(k))
    docs = [(i, draw(rng.randint(1, 40))) for i in range(size)]
    docs += [(size + i, docs[7][1]) for i in range(60)]  # many ties
    rng.shuffle(docs)
    return docs, [(i, draw(rng.randint(1, 15))) for i in range(25)]


def found(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in lexical.lexical_search(d, i, **kw).collect()), key=repr)


@pytest.mark.parametrize("setting", [{}, {"LEAF": 2, "TASK_DOCUMENTS": 100}, {"TREE_CELLS": 300}, {"BLOCK_ITEMS": 7}])
def test_equals_scoring_everything(spark, monkeypatch, setting):
    for name, value in setting.items():
        monkeypatch.setattr(lexical, name, value)
    docs, items = corpus(3)
    assert found(spark, docs, items) == expected(docs, items)


def tree_of(docs, items):
    vocabulary = sorted({t for _, x in items for t in terms(x)})
    held = [(i, Counter(t for t in terms(x) if t in vocabulary), len(terms(x))) for i, x in docs]
    df = Counter(t for _, c, _ in held for t in c)
    rank = np.empty(len(vocabulary), np.int64)
    rank[sorted(range(len(vocabulary)), key=lambda k: (-df[vocabulary[k]], k))] = np.arange(len(vocabulary))
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, _, _ in held]),
            pa.array([n for _, _, n in held]),
            pa.array([[vocabulary.index(t) for t in c] for _, c, _ in held], pa.list_(pa.int32())),
            pa.array([list(c.values()) for _, c, _ in held], pa.list_(pa.int64())),
        ],
        names=["doc_id", "n", "terms", "tfs"],
    )
    (tree,) = lexical.trees_of(iter([batch]), rank, len(docs), sum(n for _, _, n in held))
    queries = []
    for i, x in items:
        counted = Counter(terms(x))
        number = sorted(vocabulary.index(t) for t in counted)
        queries.append(lexical.Query(i, np.array(number), np.array([100 * counted[vocabulary[t]] for t in number])))
    return tree, queries


def test_bounds_hold_and_prune(monkeypatch):
    monkeypatch.setattr(lexical, "LEAF", 4)
    docs, items = corpus(5)
    tree, queries = tree_of(docs, items)
    leaves = [v for v, c in enumerate(tree.children) if not c]
    assert sorted(p for v in leaves for p in range(tree.low[v], tree.high[v])) == list(range(len(tree.ids)))
    read = 0
    for q in queries:
        bound = tree.bounds(q)
        for v in leaves:
            assert bound[v] >= tree.leaf_scores(v, q).max()
        for v, below in enumerate(tree.children):
            assert all(bound[v] >= bound[c] and tree.low[v] <= tree.low[c] < tree.high[c] <= tree.high[v] for c in below)
        tree.search(q, [])
        read += tree.leaves_read
    assert read < 0.7 * len(leaves) * len(queries)


def test_documents_of_a_subtree_share_its_path(monkeypatch):
    monkeypatch.setattr(lexical, "LEAF", 1)
    docs, items = corpus(6, 100)
    tree, _ = tree_of(docs, items)
    depth = {0: 0}
    for v, below in enumerate(tree.children):
        for c in below:
            rows = [tree.term[tree.start[p] : tree.start[p + 1]].tolist() for p in range(tree.low[c], tree.high[c])]
            depth[c] = depth[v] + 1 if len(set(map(tuple, rows))) > 1 else depth[v]
            assert len({tuple(r[: depth[c]]) for r in rows}) == 1


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    items = [(1, "one two three"), (1, "one two three"), (2, None), (3, ""), (4, "nowhere"), (5, "w1 w2 w2 é id"), (None, "mail ONE")]
    got = found(spark, docs, items)
    assert got == expected(docs, [(i, t or "") for i, t in items])
    assert {r[0] for r in got} == {1, 5, None}
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert lexical.lexical_search(no_docs, benchmark).count() == 0
    assert lexical.lexical_search(odd_docs, benchmark.limit(0)).count() == 0
    assert lexical.lexical_search(odd_docs, benchmark.withColumn("rank", benchmark.item_id)).count() == len(got)
