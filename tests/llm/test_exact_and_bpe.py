import hashlib
from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken

from tessera.llm.bpe import Codec, encoded, model_bytes, op3_byte_bpe, read_ranks
from tessera.llm.exact_dedup import OP6_SQL, drop_exact_copies, exact_groups, op6_exact_dedup
from tests.compare import compare, connect
from tests.llm.conftest import plain

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def folded(text):
    return (text or "").encode().lower()


def test_op6_equals_sql(spark, sf_dir):
    ok, message = compare(spark, connect(sf_dir), sf_dir, op6_exact_dedup, OP6_SQL)
    assert ok, message


def test_exact_groups_of_odd_rows(odd_docs):
    groups = defaultdict(list)
    for r in odd_docs.collect():
        groups[folded(r["text"])].append(r["doc_id"])
    want = []
    for ids in groups.values():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep) for i in ids]
    assert plain(exact_groups(odd_docs)) == sorted(want, key=repr)


def test_same_length_and_head_but_other_tail(docs_of):
    head = "x" * 300
    got = {r["id"]: r["keep_id"] for r in exact_groups(docs_of([head + "a", head + "b", head + "A"])).collect()}
    assert got == {0: 2, 1: 1, 2: 2}


def test_drop_keeps_one_row_of_each(odd_docs, no_docs):
    kept = drop_exact_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [folded(r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({folded(r["text"]) for r in odd_docs.collect()})
    assert drop_exact_copies(no_docs).count() == 0 and exact_groups(no_docs).count() == 0


@pytest.fixture(scope="module")
def reference():
    ranks = {t: i for i, t in enumerate(read_ranks(RANKS))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_token_and_odd_texts_encode_alike(reference):
    tokens = read_ranks(RANKS)
    codec = Codec(model_bytes(tokens), public_tokenizers.PATTERN)
    assert codec.pieces == tokens
    texts = ["", "\0\x01é▁<unk> <|endoftext|>", "a" * 20_000, "  \n\n \t", "日本語🎉👩‍👩‍👧 ", "I'll we've\r\n", "ab" * 3000 + " " * 3000]
    texts += [t.decode() for t in tokens if t.decode("utf-8", "ignore").encode() == t]
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids == reference.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_op3_against_the_library(spark, table, odd_docs, reference):
    want = []
    for r in odd_docs.collect():
        ids = reference.encode_ordinary(r["text"] or "")
        listed = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want.append((r["doc_id"], len(ids), listed, hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert plain(op3_byte_bpe(spark, table(odd_docs))) == sorted(want, key=repr)


def test_encoded_gives_ids_and_bytes(spark, docs_of, no_docs, reference):
    from pyspark.sql import functions as F

    df = docs_of(["round trip é", ""]).select(encoded(spark, F.col("text"), RANKS, public_tokenizers.PATTERN).alias("c"))
    assert [(r["c"]["ids"], bytes(r["c"]["decoded"])) for r in df.collect()] == [
        (reference.encode_ordinary(t), t.encode()) for t in ("round trip é", "")
    ]
    assert no_docs.select(encoded(spark, F.col("text"), RANKS, public_tokenizers.PATTERN)).count() == 0
