"""Directory hashes and file differences."""

import hashlib
import random

from pyspark.sql import functions as F

from tessera.operators.change import (
    changed_folders,
    changed_roots,
    diff_files,
    directory_hash,
    folder_digests,
    in_changed_folders,
    with_change_flag,
)
from tessera.schema import METADATA_FILE_NAME

SCHEMA = "root string, path string, rel_path string, mod_time_ns bigint, is_dir boolean"


def rows(root, entries):
    return [(root, f"{root}/{p}", p, t, False) for p, t in entries]


def expected(entries):
    return hashlib.sha256("".join(sorted(f"{p}:{t}" for p, t in entries)).encode()).hexdigest()


def hashes(spark, data, **options):
    return {r.root: r.content_hash for r in directory_hash(spark.createDataFrame(data, SCHEMA), **options).collect()}


def test_hash_of_sorted_entries(spark):
    entries = [("b", 2), ("a", 1), ("a/é", 5), ("a-1", 3), ("B", 9)]
    data = rows("/r", entries) + rows("/q", [("x", 1)]) + [("/r", "/r/d", "d", 7, True)]
    data += rows("/r", [("sub/" + METADATA_FILE_NAME, 4)])
    assert hashes(spark, data) == {"/r": expected(entries), "/q": expected([("x", 1)])}


def test_root_without_files(spark):
    roots = spark.createDataFrame([("/e",)], "root string")
    got = hashes(spark, [], roots=roots)
    assert got == {"/e": hashlib.sha256(b"").hexdigest()}


def test_dominant_root(spark):
    random.seed(7)
    hot = [(f"dir{i % 50}/file{i}" + "x" * 300, random.randrange(10**18)) for i in range(12_000)]
    cold = {f"/c{i}": [(f"f{j}", i * j) for j in range(1, 4)] for i in range(20)}
    data = rows("/hot", hot) + [r for root, e in cold.items() for r in rows(root, e)]
    random.shuffle(data)
    want = {"/hot": expected(hot), **{root: expected(e) for root, e in cold.items()}}
    assert hashes(spark, data) == want


def test_many_roots(spark):
    data = [r for i in range(50) for r in rows(f"/{i}", [(f"f{j}", j) for j in range(4)])]
    assert hashes(spark, data) == {f"/{i}": expected([(f"f{j}", j) for j in range(4)]) for i in range(50)}


def test_change_flags(spark):
    current = spark.createDataFrame([("/a", "h1"), ("/b", "h2"), ("/c", "h3")], "root string, content_hash string")
    stored = spark.createDataFrame([("/a", "h1"), ("/b", "old"), ("/d", "x")], "root string, content_hash string")
    got = {r.root: r.has_changed for r in with_change_flag(current, stored).collect()}
    assert got == {"/a": False, "/b": True, "/c": True}
    assert {r.root for r in changed_roots(current, stored).collect()} == {"/b", "/c"}


def test_diff(spark):
    schema = "path string, mod_time_ns bigint"
    old = spark.createDataFrame([("same", 1), ("edit", 1), ("gone", 1)], schema)
    new = spark.createDataFrame([("same", 1), ("edit", 2), ("new", 1)], schema)
    got = {r.path: r.change for r in diff_files(old, new).collect()}
    assert got == {"edit": "modified", "gone": "deleted", "new": "added"}
    assert diff_files(old, old).count() == 0


def nested(entries):
    """Digest per folder of ``{path: mtime}``, by recursion."""
    out = {}

    def digest(folder):
        inside = {p[len(folder) :]: t for p, t in entries.items() if p.startswith(folder)}
        parts = [f"{p}:{t}" for p, t in inside.items() if "/" not in p]
        parts += [f"{d}/:{digest(folder + d + '/')}" for d in {p.split("/")[0] for p in inside if "/" in p}]
        out[folder.rstrip("/")] = hashlib.sha256("".join(sorted(parts)).encode()).hexdigest()
        return out[folder.rstrip("/")]

    if entries:
        digest("")
    return out


def random_tree(seed, size=120):
    rng = random.Random(seed)
    return {"/".join(rng.choices(["a", "b", "é", "a-1"], k=rng.randint(0, 4)) + [f"f{i}"]): i for i in range(size)}


def digests(spark, trees):
    data = [r for root, tree in trees.items() for r in rows(root, tree.items())] + [("/r", "/r/d", "d", 7, True)]
    return folder_digests(spark.createDataFrame(data, SCHEMA))


def test_folder_digests_equal_recursion(spark):
    trees = {"/r": random_tree(1), "/q": random_tree(2, 30), "/flat": {f"x{i}": i for i in range(500)}}
    got = {(r.root, r.folder): r.digest for r in digests(spark, trees).collect()}
    assert got == {(root, f): d for root, tree in trees.items() for f, d in nested(tree).items()}
    depths = {r.folder: r.depth for r in digests(spark, trees).collect()}
    assert all(depths[f] == (f.count("/") + 1 if f else 0) for f in depths)
    assert digests(spark, {}).count() == 0


def test_only_the_path_to_a_change_changes(spark):
    tree = random_tree(3)
    path = next(p for p in tree if p.count("/") == 3)
    later = {**tree, path: 999, "new/deep/x": 1}
    gone = next(p for p in tree if p.startswith("b/") and p != path)
    before, after = digests(spark, {"/r": tree}), digests(spark, {"/r": later})
    got = {r.folder: r.change for r in changed_folders(after, before).collect()}
    above = {"/".join(path.split("/")[:k]) for k in range(4)}
    assert got == {**dict.fromkeys(above, "changed"), "new": "added", "new/deep": "added"}
    assert {r.folder: r.change for r in changed_folders(before, after).collect()}["new"] == "deleted"
    files = spark.createDataFrame(rows("/r", later.items()), SCHEMA)
    looked = {r.rel_path for r in in_changed_folders(files, changed_folders(after, before)).collect()}
    assert path in looked and looked == {p for p in later if p.rpartition("/")[0] in got}
    assert gone not in looked or gone.rpartition("/")[0] in got


def test_small_folders_travel_in_batches():
    import pyarrow as pa

    from tessera.operators.change import _digest_blocks, _join_blocks

    names = [f"r{i:05}" for i in range(25_000)]
    given = pa.RecordBatch.from_pydict({"root": names, "entry": ["a:1"] * len(names)})
    blocks = list(_join_blocks(iter([given])))
    digests = list(_digest_blocks(iter(blocks)))
    assert [len(blocks), len(digests)] == [3, 3]
    assert [r for b in digests for r in b.column("root").to_pylist()] == names
    assert list(_join_blocks(iter([]))) == list(_digest_blocks(iter([]))) == []
