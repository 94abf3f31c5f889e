"""Whole jobs on real trees and streams."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators.embed import HashingEmbedder
from tessera.plans.jobs import Workspace, index_documents, run_index, run_status, search
from tessera.sources.metadata import read_metadata
from tessera.sources.store import IndexStore
from tessera.streaming.arrivals import stream_index


def put(root, name, text, at=None):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    if at:
        os.utime(path, ns=(at, at))


def test_index_search_status(spark, tmp_path):
    web, api = tmp_path / "web", tmp_path / "api"
    put(web, "package.json", '{\n  "name": "web",\n  "dependencies": {"a": "^1"}\n}\n')
    put(web, ".gitignore", "*.log\nbuild/\n")
    put(web, "src/app.js", "const a = 1\nfunction login() {\n  return token\n}\nfunction logout() {\n}\n")
    put(web, "debug.log", "ignored text")
    put(web, "build/out.js", "function built() {}")
    put(web, ".git/config", "hidden text")
    put(web, ".env", "KEY=1")
    put(web, "logo.png", b"\x89PNG\0\0")
    put(api, "go.mod", "module api\nrequire x.org/y v1.2.3\n")
    put(api, "docs/guide.md", "# Setup\ninstall it\n\n# Login\ntoken = \"0123456789abcdef\"\n")
    roots = [str(web), str(api)]
    space = Workspace(spark, str(tmp_path / "space"), buckets=4)
    embedder = HashingEmbedder(64)

    before = {r.root: r.state for r in run_status(spark, roots, space).collect()}
    assert set(before.values()) == {"no metadata"}

    run_index(spark, roots, space, embedder, now=100)
    rows = space.store.read().collect()
    paths = {os.path.relpath(r.file_path, tmp_path) for r in rows}
    assert paths == {"web/package.json", "web/.gitignore", "web/src/app.js", "api/go.mod", "api/docs/guide.md"}
    app = sorted((r.start_line, r.chunk_type) for r in rows if r.file_path.endswith("app.js"))
    assert app == [(1, "preamble"), (2, "function"), (5, "function")]
    assert all(len(r.embedding) == 64 and r.last_indexed == 100 for r in rows)
    guide = {r.start_line: r for r in rows if r.file_path.endswith("guide.md")}
    assert guide[4].content == '# Login\ntoken = "[REDACTED]"'
    assert (guide[4].project_path, guide[4].project_type, guide[4].language) == (str(api), "go", "markdown")

    stored = {r.root: r for r in read_metadata(spark, space.metadata_path).collect()}
    assert stored[str(web)].project_type == "node" and stored[str(web)].dependencies == {"a": "^1"}
    assert stored[str(api)].dependencies == {"x.org/y": "v1.2.3"} and stored[str(api)].file_count == 2
    states = {r.root: (r.state, r.documents) for r in run_status(spark, roots, space).collect()}
    assert set(states.values()) == {("up to date", len(rows))}

    queries = spark.createDataFrame([(1, "login token"), (2, "nowhere")], "query_id int, query string")
    results = search(queries, space.store.read(), limit=2).collect()
    assert {r.query_id for r in results} == {1} and results[0].header.startswith("[")
    hybrid = search(queries, space.store.read(), embedder, limit=2).collect()
    assert [r.file_path for r in hybrid if r.query_id == 1 and r["rank"] == 1]
    assert sorted(search(queries, space.store, limit=2).collect()) == sorted(results)
    assert sorted(search(queries, space.store, embedder, limit=2).collect()) == sorted(hybrid)

    # Nothing changed: nothing is read or written.
    assert run_index(spark, roots, space, embedder, now=200).count() == 0
    assert {r.last_indexed for r in space.store.read().collect()} == {100}

    # One root changes: a file edited, one removed, one added, one newly ignored.
    later = time.time_ns() + 10**9
    put(web, "src/app.js", "function only() {\n}\n", later)
    put(web, ".gitignore", "*.log\nbuild/\n*.json\n", later)
    put(web, "src/new.py", "def fresh():\n  pass\n")
    changes = {(os.path.basename(r.root), r.change): r.files for r in run_index(spark, roots, space, embedder, now=300).collect()}
    assert changes == {("web", "added"): 1, ("web", "modified"): 2, ("web", "deleted"): 1}
    rows = space.store.read().collect()
    names = {os.path.relpath(r.file_path, tmp_path): r.last_indexed for r in rows}
    assert names == {
        "web/.gitignore": 300, "web/src/app.js": 300, "web/src/new.py": 300, "api/go.mod": 100, "api/docs/guide.md": 100
    }
    assert sum(r.file_path.endswith("app.js") for r in rows) == 1


def test_unreadable_file_is_reported_and_retried(spark, tmp_path):
    root = tmp_path / "r"
    put(root, "good.txt", "fine")
    os.symlink(tmp_path / "absent", root / "bad.txt")
    space = Workspace(spark, str(tmp_path / "space"), buckets=2)
    run_index(spark, [str(root)], space, now=1)
    assert {os.path.basename(r.file_path) for r in space.store.read().collect()} == {"good.txt"}
    errors = spark.read.json(space.errors_path).collect()
    assert [os.path.basename(r.path) for r in errors] == ["bad.txt"]
    assert run_status(spark, [str(root)], space).first().state == "changes detected"
    (root / "bad.txt").unlink()
    put(root, "bad.txt", "now readable")
    run_index(spark, [str(root)], space, now=2)
    assert {os.path.basename(r.file_path) for r in space.store.read().collect()} == {"good.txt", "bad.txt"}
    assert run_status(spark, [str(root)], space).first().state == "up to date"


def test_malformed_text_and_links_do_not_stop_a_run(spark, tmp_path):
    root = tmp_path / "r"
    put(root, "latin.txt", "caf\xe9 au lait".encode("latin-1"))
    put(root, "sub/good.txt", "fine")
    os.symlink(root / "sub", root / "link")
    space = Workspace(spark, str(tmp_path / "space"), buckets=2)
    run_index(spark, [str(root)], space, now=1)
    got = {os.path.basename(r.file_path): r.content for r in space.store.read().collect()}
    assert got == {"latin.txt": "caf\ufffd au lait", "good.txt": "fine"}
    assert run_status(spark, [str(root)], space).first().state == "up to date"
    assert run_index(spark, [str(root)], space, now=2).count() == 0


def test_unlisted_folder_deletes_nothing(spark, tmp_path, monkeypatch):
    import tessera.plans.jobs as jobs

    root, listed = tmp_path / "r", jobs.list_tree
    put(root, "top.txt", "top")
    put(root, "sub/low.txt", "low")
    put(root, "old.txt", "old")
    space = Workspace(spark, str(tmp_path / "space"), buckets=2)
    run_index(spark, [str(root)], space, now=1)
    (root / "old.txt").unlink()

    def failing(spark, roots, **options):
        rows = listed(spark, roots, **options)
        cause = F.when(F.col("rel_path") == "sub", "no access")
        return rows.filter(~F.col("rel_path").startswith("sub/")).withColumn("error", cause)

    monkeypatch.setattr(jobs, "list_tree", failing)
    for now in (2, 2, 3):
        run_index(spark, [str(root)], space, now=now)
        names = {os.path.basename(r.file_path) for r in space.store.read().collect()}
        assert names == {"top.txt", "low.txt"}
    errors = spark.read.json(space.errors_path).collect()
    assert sorted((r["at"], r.error) for r in errors) == [(2, "no access"), (3, "no access")]
    monkeypatch.setattr(jobs, "list_tree", listed)
    assert run_status(spark, [str(root)], space).first().state == "changes detected"
    run_index(spark, [str(root)], space, now=4)
    assert {os.path.basename(r.file_path) for r in space.store.read().collect()} == {"top.txt", "low.txt"}
    assert run_status(spark, [str(root)], space).first().state == "up to date"


def test_shared_folder_is_required_off_one_machine(spark):
    from types import SimpleNamespace

    from tessera.session import shared_folder

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(far)


class Picky:
    """Fails on texts that hold a word; counts the texts it is asked for."""

    name = "picky"

    def __init__(self, spark, word):
        self.word, self.calls = word, spark.sparkContext.accumulator(0)

    def __call__(self, texts):
        self.calls.add(len(texts))
        if self.word and any(self.word in t for t in texts):
            raise TimeoutError("no answer")
        return [[float(len(t)), 1.0] for t in texts]


def test_a_failing_embedder_leaves_the_rest_indexed(spark, tmp_path):
    root = tmp_path / "r"
    put(root, "a.txt", "fine")
    put(root, "b.txt", "old text\n\nand more")
    space = Workspace(spark, str(tmp_path / "space"), buckets=2)
    run_index(spark, [str(root)], space, Picky(spark, ""), now=1)

    def held():
        return {(os.path.basename(r.file_path), r.start_line): r.content for r in space.store.read().collect()}

    put(root, "b.txt", "poison", time.time_ns() + 10**9)
    put(root, "c.txt", "new")
    run_index(spark, [str(root)], space, Picky(spark, "poison"), now=2)
    # the file it failed on is as it was, and is tried again
    assert held() == {("a.txt", 1): "fine", ("b.txt", 1): "old text", ("b.txt", 3): "and more", ("c.txt", 1): "new"}
    errors = spark.read.json(f"{space.errors_path}/at=2").collect()
    assert [(os.path.basename(r.path), r.error) for r in errors] == [("b.txt", "TimeoutError: no answer")]
    assert run_status(spark, [str(root)], space).first().state == "changes detected"
    run_index(spark, [str(root)], space, Picky(spark, ""), now=3)
    assert held() == {("a.txt", 1): "fine", ("b.txt", 1): "poison", ("c.txt", 1): "new"}
    assert run_status(spark, [str(root)], space).first().state == "up to date"


def test_moved_files_are_not_embedded_again(spark, tmp_path):
    root = tmp_path / "r"
    for i in range(6):
        put(root, f"old/f{i}.txt", f"text {i}")
    space, embedder = Workspace(spark, str(tmp_path / "space"), buckets=2), Picky(spark, "")
    run_index(spark, [str(root)], space, embedder, now=1)
    assert embedder.calls.value == 6
    (root / "old").rename(root / "new")
    run_index(spark, [str(root)], space, embedder, now=2)
    rows = space.store.read().collect()
    assert embedder.calls.value == 6 and len(rows) == 6
    assert all("/new/" in r.file_path and r.embedding == [6.0, 1.0] for r in rows)


def test_many_runs_are_compacted(spark, tmp_path):
    root = tmp_path / "r"
    space = Workspace(spark, str(tmp_path / "space"), buckets=2, compact_after=2)
    for i in range(4):
        put(root, f"f{i}.txt", f"text {i}")
        run_index(spark, [str(root)], space, now=i)
        assert space.store.segments() < 2
    assert space.store.count() == 4


def test_overlapping_roots(spark, tmp_path):
    outer, inner = tmp_path / "o", tmp_path / "o" / "i"
    put(outer, "top.txt", "top")
    put(inner, "low.txt", "low")
    space = Workspace(spark, str(tmp_path / "space"), buckets=2)
    roots = [str(outer), str(inner)]
    run_index(spark, roots, space, now=1)
    assert sorted(os.path.basename(r.file_path) for r in space.store.read().collect()) == ["low.txt", "top.txt"]
    # Ignored below the outer root only: the inner root still shows the file.
    put(outer, ".gitignore", "i/\n")
    run_index(spark, roots, space, now=2)
    assert sorted(os.path.basename(r.file_path) for r in space.store.read().collect()) == [".gitignore", "low.txt", "top.txt"]


def test_repeated_paths_of_a_document_table(spark, tmp_path):
    rows = [("hot.txt", f"v{i}\n\nmore") for i in range(400)] + [("hot.txt", "last")] + [(f"f{i}", "x") for i in range(800)]
    docs = spark.createDataFrame(rows, "path string, content string")
    store = IndexStore(spark, str(tmp_path / "index"), buckets=2)
    index_documents(docs, store)
    got = {(r.file_path, r.start_line): r.content for r in store.read().collect()}
    assert store.count() == len(got) == 801 and got[("hot.txt", 1)] == "last"


def test_missing_root(spark, tmp_path):
    with pytest.raises(Exception):
        run_index(spark, [str(tmp_path / "none")], Workspace(spark, str(tmp_path / "s")))


def test_stream(spark, tmp_path):
    inbox, schema = tmp_path / "in", "path string, content string, seq int"
    store = IndexStore(spark, str(tmp_path / "index"), buckets=2)

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(inbox))

    def drain():
        docs = spark.readStream.schema(schema).parquet(str(inbox))
        stream_index(docs, store, str(tmp_path / "cp"), None, "seq", clock=lambda: 7, availableNow=True).awaitTermination()
        return {(r.file_path, r.start_line): r.content for r in store.read().collect()}

    arrive([("a.txt", "one\n\ntwo", 1), ("a.txt", "newest", 2), ("b.txt", "b", 1)])
    assert drain() == {("a.txt", 1): "newest", ("b.txt", 1): "b"}
    arrive([("b.txt", "x\n\ny", 3), ("c.txt", "c", 1), ("a.txt", " ", 4)])
    assert drain() == {("b.txt", 1): "x", ("b.txt", 3): "y", ("c.txt", 1): "c"}
    assert drain() == {("b.txt", 1): "x", ("b.txt", 3): "y", ("c.txt", 1): "c"}


def test_a_replayed_micro_batch_changes_nothing(spark, tmp_path):
    inbox, schema = tmp_path / "in", "path string, content string, seq int"
    store = IndexStore(spark, str(tmp_path / "index"), buckets=2)
    spark.createDataFrame([("a.txt", "one", 1)], schema).coalesce(1).write.parquet(str(inbox))

    def drain(now):
        docs = spark.readStream.schema(schema).parquet(str(inbox))
        stream_index(docs, store, str(tmp_path / "cp"), None, "seq", clock=lambda: now, availableNow=True).awaitTermination()
        return [(r.file_path, r.content, r.last_indexed) for r in store.read().collect()]

    assert drain(1) == [("a.txt", "one", 1)]
    # the batch was indexed, but the stream stopped before it noted so
    for name in ("0", ".0.crc"):
        (tmp_path / "cp" / "commits" / name).unlink(missing_ok=True)
    files = set((tmp_path / "index").rglob("*.parquet"))
    # the replay computes its rows again and finds its number applied
    assert drain(2) == [("a.txt", "one", 1)] and set((tmp_path / "index").rglob("*.parquet")) == files


def test_updates_reach_the_store_once_computed(spark, tmp_path):
    """A source that gives other rows each time must not tear the index apart."""
    from tessera.operators.index import build_index_rows

    chunks = spark.range(50).select(
        F.concat(F.lit("f"), (F.rand() * 1e9).cast("bigint").cast("string")).alias("file_path"),
        F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("t").alias("chunk_type"), F.lit("x").alias("content"),
    )
    store = IndexStore(spark, str(tmp_path / "i"), buckets=4)
    store.upsert(build_index_rows(chunks))
    assert store.count() == 50
