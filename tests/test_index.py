"""Index records, upserts, deletes and the store."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.index import build_index_rows, chunk_id, delete_paths, latest, upsert
from tessera.schema import INDEX
from tessera.sources.store import IndexStore


def records(spark, entries):
    chunks = spark.createDataFrame(
        [(p, s, s + 1, "function", text) for p, s, text in entries],
        "file_path string, start_line int, end_line int, chunk_type string, content string",
    )
    return build_index_rows(chunks, now=1)


def contents(df):
    return {(r.file_path, r.start_line): r.content for r in df.collect()}


def test_records(spark):
    df = records(spark, [("a", 1, "x"), ("a", 5, "y")])
    assert df.schema == INDEX or [f.dataType for f in df.schema] == [f.dataType for f in INDEX]
    ids = {r.start_line: r.id for r in df.collect()}
    assert ids[1] != ids[5] and len(ids[1]) == 64
    assert df.filter(F.col("id") == chunk_id(F.col("file_path"), F.col("start_line"))).count() == 2


def test_records_with_files_and_vectors(spark):
    chunks = records(spark, [("a", 1, "x"), ("b", 1, "y")]).select(
        "file_path", "start_line", "end_line", "chunk_type", "content"
    )
    files = spark.createDataFrame(
        [("a", "/p", "go", "go")], "file_path string, project_path string, project_type string, language string"
    )
    vectors = chunks.filter("file_path = 'a'").select(
        chunk_id(F.col("file_path"), F.col("start_line")).alias("id"), F.array(F.lit(1.0)).alias("embedding")
    )
    got = {r.file_path: r for r in build_index_rows(chunks, files, vectors, now=5).collect()}
    assert (got["a"].project_type, got["a"].embedding, got["a"].last_indexed) == ("go", [1.0], 5)
    assert (got["b"].project_type, got["b"].embedding) == (None, None)


def test_upsert_replaces_and_is_idempotent(spark):
    old = records(spark, [("a", 1, "old"), ("b", 1, "kept")])
    new = records(spark, [("a", 1, "new"), ("c", 1, "added")])
    once = upsert(old, new)
    want = {("a", 1): "new", ("b", 1): "kept", ("c", 1): "added"}
    assert contents(once) == want and once.count() == 3
    assert contents(upsert(once, new)) == want and upsert(once, new).count() == 3
    assert contents(upsert(old, new.limit(0))) == contents(old)


def test_last_update_of_a_hot_id_wins(spark):
    rows = records(spark, [("a", 1, f"v{i}") for i in range(3000)] + [("b", 1, "b")])
    numbered = rows.withColumn("seq", F.when(F.col("file_path") == "a", F.expr("int(substr(content, 2))")).otherwise(0))
    assert contents(latest(numbered, "id", "seq")) == {("a", 1): "v2999", ("b", 1): "b"}
    plan = latest(numbered, "id", "seq")._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan


def test_delete(spark):
    index = records(spark, [("a", 1, "x"), ("a", 9, "y"), ("ab", 1, "z")])
    assert contents(delete_paths(index, "a")) == {("ab", 1): "z"}
    assert delete_paths(index, "none").count() == 3
    assert contents(delete_paths(index, spark.createDataFrame([("ab",), ("q",)], "file_path string"))) == {
        ("a", 1): "x", ("a", 9): "y"
    }
    with pytest.raises(ValueError):
        delete_paths(index, "")


def test_store(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), buckets=4)
    assert store.ensure() and not store.ensure()
    assert store.count() == 0 and store.read().schema.names == INDEX.names
    entries = [(f"f{i}", 1, f"t{i}") for i in range(20)]
    store.upsert(records(spark, entries))
    reader = store.read()
    store.upsert(records(spark, [("f3", 1, "changed"), ("new", 1, "n")]))
    got = contents(store.read())
    assert len(got) == 21 and got[("f3", 1)] == "changed" and got[("new", 1)] == "n"
    # A reader keeps the version it started with.
    assert contents(reader)[("f3", 1)] == "t3"
    store.upsert(records(spark, [("f3", 1, "changed"), ("new", 1, "n")]))
    assert contents(store.read()) == got
    store.delete("f3")
    store.delete("absent")
    assert ("f3", 1) not in contents(store.read()) and store.count() == 20
    with pytest.raises(ValueError):
        store.delete("")
    store.upsert(records(spark, []))
    assert store.count() == 20
    store.delete(store.read().select("file_path"))
    assert store.count() == 0


def test_repeated_ids_leave_one_row(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), buckets=2)
    store.upsert(records(spark, [("a", 1, f"v{i}") for i in range(5)]))
    assert contents(store.read()) == {("a", 1): "v4"} and store.count() == 1


def parquet_files(path):
    return {str(f) for f in path.rglob("*.parquet")}


def test_a_change_writes_only_what_it_brings(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), buckets=16)
    store.upsert(records(spark, [(f"f{i}", 1, "t") for i in range(200)]))
    before = parquet_files(tmp_path)
    store.apply(
        updates=records(spark, [("f0", 1, "u")]), deletes=spark.createDataFrame([("f0",)], "file_path string")
    )
    added = parquet_files(tmp_path) - before
    assert before <= parquet_files(tmp_path)
    held = [(str(f), r.file_path) for f in added for r in spark.read.parquet(f).collect()]
    assert {p for _, p in held} == {"f0"} and len(held) == 2
    assert store.count() == 200 and contents(store.read())[("f0", 1)] == "u"


def test_merging_equals_applying_one_by_one(spark, tmp_path):
    """Random changes against a dictionary, read after each one, compacted now and then."""
    rng = random.Random(8)
    store, want = IndexStore(spark, str(tmp_path / "index"), buckets=3, postings=True), {}
    for step in range(12):
        gone = rng.sample([f"f{i}" for i in range(8)], rng.randint(0, 3))
        puts = {(f"f{rng.randrange(8)}", rng.randrange(1, 4)): f"s{step} w{k}" for k in range(rng.randint(0, 4))}
        store.apply(
            updates=records(spark, [(*k, v) for k, v in puts.items()]) if puts else None,
            deletes=spark.createDataFrame([(g,) for g in gone], "file_path string") if gone else None,
        )
        want = {k: v for k, v in want.items() if k[0] not in gone} | puts
        assert contents(store.read()) == want and store.read().count() == len(want)
        if step in (4, 9):
            assert store.compact(buckets=5 if step == 9 else None) and store.segments() == 0
            assert not store.compact()
            assert contents(store.read()) == want
        held = {(r.id, r.term, r.tf, r.length) for r in store.read_postings().postings.collect()}
        ids = {(r.file_path, r.start_line): r.id for r in store.read().collect()}
        assert held == {(ids[k], w, 1, 2) for k, v in want.items() for w in v.split()}
        assert {(r.id, r.length) for r in store.read_postings().sizes.collect()} == {(i, 2) for i in ids.values()}


def test_untouched_buckets_are_read_without_a_join(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), buckets=4)
    store.upsert(records(spark, [(f"f{i}", 1, "t") for i in range(40)]))
    assert "Join" not in store.read()._jdf.queryExecution().optimizedPlan().toString()
    store.delete("f0")
    plan = store.read()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1 and plan.count("Union") == 1 and store.count() == 39


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), buckets=2)
    assert store.apply(updates=records(spark, [("a", 1, "x")]), batch=("feed", 0))
    assert store.apply(updates=records(spark, [("a", 1, "y")]), batch=("feed", 1))
    before = parquet_files(tmp_path)
    assert not store.apply(updates=records(spark, [("a", 1, "x")]), batch=("feed", 0))
    assert not store.apply(updates=records(spark, [("b", 1, "z")]), batch=("feed", 1))
    assert store.apply(updates=records(spark, [("b", 1, "z")]), batch=("other", 0))
    assert store.apply(updates=None, batch=("feed", 2)) and not store.apply(updates=None, batch=("feed", 2))
    assert contents(store.read()) == {("a", 1): "y", ("b", 1): "z"} and before < parquet_files(tmp_path)


def test_a_reader_keeps_its_segments(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), buckets=2)
    store.upsert(records(spark, [("a", 1, "x"), ("b", 1, "y")]))
    store.delete("a")
    reader = store.read()
    store.upsert(records(spark, [("b", 1, "z")]))
    store.compact()
    assert contents(reader) == {("b", 1): "y"} and contents(store.read()) == {("b", 1): "z"}


def test_fetching_ids_opens_their_buckets_only(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), buckets=32)
    store.upsert(records(spark, [(f"f{i}", 1, f"t{i}") for i in range(300)]))
    store.delete("f4")
    chosen = store.read().filter("file_path in ('f3', 'f9')").select("id")
    ids = spark.createDataFrame([*chosen.collect(), *chosen.collect(), ("none",)], "id string")
    got = store.fetch(ids)
    assert contents(got) == {("f3", 1): "t3", ("f9", 1): "t9"} and got.count() == 2 and len(got.inputFiles()) <= 4


def test_reading_paths_opens_their_buckets_only(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), buckets=32)
    store.upsert(records(spark, [(f"f{i}", 1, f"t{i}") for i in range(300)]))
    got = store.read_paths(spark.createDataFrame([("f3",), ("f3",), ("none",)], "file_path string"))
    assert contents(got) == {("f3", 1): "t3"} and len(got.inputFiles()) <= 2


def test_replacing_a_file_drops_its_stale_chunks(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), buckets=4)
    store.upsert(records(spark, [("a", 1, "x"), ("a", 10, "y"), ("b", 1, "z")]))
    fresh = records(spark, [("a", 1, "only")])
    store.apply(updates=fresh, deletes=fresh.select("file_path"))
    assert contents(store.read()) == {("a", 1): "only", ("b", 1): "z"}


def test_no_row_is_stored_per_term(spark, tmp_path):
    words = [" ".join(f"w{(i * 7 + k) % 500}" for k in range(50)) for i in range(100)]
    store = IndexStore(spark, str(tmp_path / "index"), buckets=2, postings=True)
    store.apply(updates=records(spark, [(f"f{i}", 1, text) for i, text in enumerate(words)]))
    stored = [str(p) for p in (tmp_path / "index").rglob("*.parquet")]
    assert sum(spark.read.parquet(p).count() for p in stored) == 100
    assert store.read_postings().postings.count() == 5_000
