"""Directory trees, metadata tables and document tables."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators.filters import drop_binary
from tessera.schema import METADATA, METADATA_FILE_NAME
from tessera.session import persist_table
from tessera.sources.corpus import read_corpus, spread
from tessera.sources.metadata import merge_metadata, metadata_from_files, read_metadata, write_metadata
from tessera.sources.tree import list_files, list_tree, load_content, write_lines


@pytest.fixture()
def tree(tmp_path):
    for name in ["a.txt", "_u.txt", ".env", "s/b.txt", "s/n/c.txt", ".hid/x", "s/.git/config", "s/n/empty"]:
        path = tmp_path / "t" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("" if name.endswith("empty") else f"text {name}")
    os.symlink(tmp_path / "t", tmp_path / "t" / "s" / "loop")
    return tmp_path / "t"


def test_listing(spark, tree):
    rows = {r.rel_path: r for r in list_files(spark, str(tree)).collect()}
    assert set(rows) == {"a.txt", "_u.txt", ".env", "s/b.txt", "s/n/c.txt", "s/n/empty", "s/loop"}
    row = rows["s/b.txt"]
    assert row.path == str(tree / "s/b.txt") and row.root == str(tree) and row.size == len("text s/b.txt")
    assert row.mod_time_ns == os.stat(tree / "s/b.txt").st_mtime_ns and not row.is_dir


@pytest.mark.parametrize("entries", [1, 3, 7])
def test_rounds_list_every_entry_once(spark, tmp_path, entries):
    want = set()
    for i in range(6):
        for j in range(3):
            for name in (f"d{i}/e{j}/f{j}.txt", f"d{i}/g.txt", f"d{i}/e{j}/deep/er/x"):
                path = tmp_path / name
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_text("")
                parts = name.split("/")
                want |= {"/".join(parts[: k + 1]) for k in range(len(parts))}
    got = [r.rel_path for r in list_tree(spark, str(tmp_path), entries=entries).collect()]
    assert sorted(got) == sorted(want)


def test_a_wide_tree_takes_a_few_tasks_a_core(spark, tmp_path, monkeypatch):
    for i in range(300):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "x").write_text("")
    from tessera.sources import tree as module

    dealt, listed = [], module._list_folders
    monkeypatch.setattr(
        module, "_list_folders", lambda f, *a: (dealt.append(f.rdd.getNumPartitions()), listed(f, *a))[1]
    )
    got = [r.rel_path for r in list_tree(spark, str(tmp_path), entries=2).collect()]
    assert sorted(got) == sorted(f"d{i}{end}" for i in range(300) for end in ("", "/x"))
    assert max(dealt) <= module.CORE_TASKS * spark.sparkContext.defaultParallelism


def test_folders_and_hidden(spark, tree):
    shown = {r.rel_path for r in list_tree(spark, str(tree)).filter("is_dir").collect()}
    assert shown == {"s", "s/n", ".hid", "s/.git"}
    everything = {r.rel_path for r in list_tree(spark, str(tree), hidden=True).collect()}
    assert {".hid/x", "s/.git/config"} <= everything


def test_roots(spark, tree, tmp_path):
    with pytest.raises(Exception, match="missing"):
        list_files(spark, str(tmp_path / "missing")).collect()
    assert list_files(spark, str(tree / "a.txt")).count() == 0
    both = list_files(spark, [str(tree / "s"), str(tree / "s/n") + "/"])
    assert {(os.path.basename(r.root), r.rel_path) for r in both.collect()} >= {("s", "n/c.txt"), ("n", "c.txt")}


def test_missing_remote_root_is_an_error(spark):
    with pytest.raises(Exception, match="nowhere"):
        list_files(spark, "mock:///nowhere").collect()


def test_folder_that_cannot_be_listed(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a")
    # too long a path for the system, however often its parts may be entered one by one
    here = os.open(tmp_path, os.O_RDONLY)
    for _ in range(18):
        os.mkdir("d" * 240, dir_fd=here)
        here, old = os.open("d" * 240, os.O_RDONLY, dir_fd=here), here
        os.close(old)
    os.close(here)
    with pytest.raises(Exception, match="too long"):
        list_files(spark, str(tmp_path)).collect()
    rows = list_tree(spark, str(tmp_path), errors=True).collect()
    (bad,) = [r for r in rows if r.error]
    assert bad.is_dir and "too long" in bad.error and "a.txt" in {r.rel_path for r in rows if not r.error}


def test_link_to_folder_has_no_content(spark, tree):
    (row,) = load_content(list_files(spark, str(tree)).filter("rel_path = 's/loop'")).collect()
    assert row.content is None and row.error is None


def test_wide_tree(spark, tmp_path):
    for i in range(30):
        for j in range(4):
            (tmp_path / f"d{i}" / f"e{j}").mkdir(parents=True)
            (tmp_path / f"d{i}" / f"e{j}" / "f").write_text("x")
    df = list_files(spark, str(tmp_path))
    assert df.count() == 120 and df.select("path").distinct().count() == 120


def test_content(spark, tree):
    files = list_files(spark, str(tree)).filter(F.col("rel_path") != "s/loop")
    got = {r.rel_path: (bytes(r.content), r.error) for r in load_content(files, tasks=3).collect()}
    assert got["s/b.txt"] == (b"text s/b.txt", None) and got["s/n/empty"] == (b"", None)
    gone = spark.createDataFrame([(str(tree / "gone"),), (str(tree / "a.txt"),)], "path string")
    rows = {os.path.basename(r.path): r for r in load_content(gone).collect()}
    assert rows["gone"].content is None and rows["gone"].error and rows["a.txt"].error is None


def metadata(spark, root, count):
    return spark.createDataFrame(
        [(root, 1_700_000_000, count, "abc123", "go", ["go", "markdown"], {"cobra": "v1.8.0"})], METADATA
    )


def test_metadata_round_trip(spark, tmp_path):
    path = str(tmp_path / "meta")
    assert read_metadata(spark, path).count() == 0
    write_metadata(metadata(spark, "/r", 1), path)
    write_metadata(metadata(spark, "/r", 42), path)
    row = read_metadata(spark, path).collect()
    assert len(row) == 1 and row[0].file_count == 42 and row[0].dependencies == {"cobra": "v1.8.0"}
    merged = merge_metadata(metadata(spark, "/r", 1).unionByName(metadata(spark, "/q", 2)), metadata(spark, "/r", 9))
    assert {r.root: r.file_count for r in merged.collect()} == {"/r": 9, "/q": 2}


def test_corrupt_metadata_is_an_error(spark, tmp_path):
    path = tmp_path / "meta"
    write_metadata(metadata(spark, "/r", 1), str(path))
    version = next(p for p in path.iterdir() if p.is_dir())
    part = next(version.glob("part-*"))
    part.unlink()
    for crc in version.glob(".*.crc"):
        crc.unlink()
    part.write_text("{invalid json\n")
    with pytest.raises(Exception):
        read_metadata(spark, str(path)).collect()


def test_metadata_from_files(spark):
    text = '{\n  "last_indexed": 5,\n  "file_count": 2,\n  "content_hash": "h",\n  "languages": ["go"]\n}'
    files = spark.createDataFrame(
        [(f"/r/{METADATA_FILE_NAME}", text.encode()), ("/r/x.json", b"{bad")], "path string, content binary"
    )
    (row,) = metadata_from_files(files).collect()
    assert (row.root, row.file_count, row.languages, row.dependencies) == ("/r", 2, ["go"], None)
    broken = spark.createDataFrame([(f"/r/{METADATA_FILE_NAME}", b"{bad")], "path string, content binary")
    with pytest.raises(Exception):
        metadata_from_files(broken).collect()


def test_corpus(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", "go", 1)], "path string, content string, language string, n int")
    df.write.parquet(str(tmp_path / "c"))
    assert read_corpus(spark, str(tmp_path / "c")).columns == ["path", "content", "language"]
    df.drop("content").write.parquet(str(tmp_path / "d"))
    with pytest.raises(ValueError):
        read_corpus(spark, str(tmp_path / "d"))


def test_spread_only_small_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert "Exchange" in spread(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in spread(docs, limit=10)._jdf.queryExecution().executedPlan().toString()


def test_binaries_are_read_no_further_than_they_are_told(spark, tmp_path):
    data = {"late.bin": b"x" * 8192 + b"\0" + b"y" * 10_000, "early.bin": b"\0" + b"y" * 50_000, "a.txt": b"text" * 9000, "empty": b""}
    for name, raw in data.items():
        (tmp_path / name).write_bytes(raw)
    files = list_files(spark, str(tmp_path))
    whole = {r.rel_path: bytes(r.content) for r in load_content(files).collect()}
    assert whole == data
    probed = {r.rel_path: bytes(r.content) for r in load_content(files, 2, skip_binary=True).collect()}
    assert probed == {**data, "early.bin": data["early.bin"][:8192]}
    kept = [{r.rel_path for r in drop_binary(load_content(files, None, s)).collect()} for s in (False, True)]
    assert kept[0] == kept[1] == {"late.bin", "a.txt", "empty"}


def test_lines_are_written_as_files_of_their_folders(spark, tmp_path):
    rows = [("a/b", "x"), ("c", None), ("a/b", "y"), ("a", "é")]
    lines = spark.createDataFrame(rows, "folder string, text string").coalesce(1)
    assert write_lines(lines, str(tmp_path)) == 3
    got = {r.rel_path: bytes(r.content) for r in load_content(list_files(spark, str(tmp_path))).collect()}
    name = "part-00000.txt"
    assert got == {f"a/b/{name}": b"x\ny\n", f"c/{name}": b"\n", f"a/{name}": "é\n".encode()}


def test_a_written_table_leaves_no_shuffle_files(spark):
    def files():
        held = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {held.apply(k).getName() for k in range(held.size())}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    given, before = spark.conf.get(setting), files()
    table = persist_table(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert not [f for f in files() - before if f.startswith("shuffle_")]
    assert spark.conf.get(setting) == given and table.count() == 7
