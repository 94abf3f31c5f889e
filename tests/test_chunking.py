"""Exact chunk rows for hand-written inputs."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.chunking import code_chunks
from tessera.operators.chunk import chunk_documents, split_large

GO = """package demo

import "fmt"

func First() {
	fmt.Println(1)
}

func (t T) Second() int {
	return 2
}


"""
PY = """import os

class Box:
    def get(self):
        return 1

    async def later(self):
        pass

def top():
    return 2

@wrap
async def skipped():
    pass
"""
JS = """const a = 1

export async function load() {
  return a
}
const arrow = () => 2
class Shape {
}
export class Hidden {}
"""
JAVA = """package demo;
class A {

    public static void main(String[] a) {
        run();
    }

    int size() {
        return 0;
    }
}
"""
MD = "lost text\n# One\nbody\n\n## Two\n```\n# in code\n```\n\n"
YAML = "# comment\nname: a\n\nitems:\n  - x\n  # y: z\nlast: 1\n\n"
JSON = """{
  "first": {
    "a": 1
  },
  "name": "x",
  "version": "1",
  "nested": {
    "b": [1, 2]
  },
  "end": true
}
"""
TOML = "\ntitle = 'x'\n\nowner = 'y'\n\n[a]\nk = 1\n\n[[b]]\nk = [\n  [1, 2],\n]\n\n"

CASES = {
    "a.go": (GO, [(1, 4, "preamble"), (5, 7, "function"), (9, 11, "function")]),
    "a.py": (PY, [(1, 2, "preamble"), (3, 8, "class"), (10, 15, "function")]),
    "a.js": (JS, [(1, 2, "preamble"), (3, 6, "function"), (7, 9, "class")]),
    "a.ts": (JS, [(1, 2, "preamble"), (3, 6, "function"), (7, 9, "class")]),
    "A.java": (JAVA, [(1, 2, "preamble"), (3, 6, "function"), (7, 11, "function")]),
    "a.md": (MD, [(2, 3, "header"), (5, 6, "header"), (7, 8, "header")]),
    "none.md": ("plain\n\ntext\n", [(1, 4, "paragraph")]),
    "a.yml": (YAML, [(2, 3, "config_key"), (4, 6, "config_key"), (7, 7, "config_key")]),
    "none.yaml": ("# only\n  a: 1\n", []),
    "a.json": (JSON, [(5, 5, "config_key"), (6, 9, "config_key"), (10, 10, "config_key")]),
    "one.json": ('{"a": 1, "b": 2}', []),
    "list.json": ('[\n  "a",\n  "b"\n]', []),
    "a.toml": (
        TOML,
        [(2, 4, "config_key"), (6, 7, "config_key"), (9, 10, "config_key"), (11, 12, "config_key")],
    ),
    "a.txt": ("one\ntwo\n \t\nthree\n  \n\nfour", [(1, 2, "paragraph"), (4, 4, "paragraph"), (7, 7, "paragraph")]),
    "b.xyz": ("x\n\ny", [(1, 1, "paragraph"), (3, 3, "paragraph")]),
    "blank.txt": (" \n \n", []),
    "plain.go": ("package a\nvar x = 1\n", [(1, 3, "code")]),
    "crlf.txt": ("a\r\n\r\nb\r\n", [(1, 1, "paragraph"), (3, 3, "paragraph")]),
    "crlf.go": ("x\r\nfunc a() {}\r\n\r\nfunc b() {}\r\n", [(1, 1, "preamble"), (2, 2, "function"), (4, 4, "function")]),
    "mark.go": ("\x01\x03x\nfunc a() {}\n\x01\x03y", [(1, 1, "preamble"), (2, 3, "function")]),
    "consumed.py": ("def \ndef foo():\n  pass\ndef bar(): pass", [(1, 3, "function"), (4, 4, "function")]),
}


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.createDataFrame([(p, c[0]) for p, c in CASES.items()], "path string, content string")
    out = {}
    for r in chunk_documents(docs).orderBy("file_path", "start_line").collect():
        out.setdefault(r.file_path, []).append(r)
    return out


@pytest.mark.parametrize("path", list(CASES))
def test_ranges(rows, path):
    got = [(r.start_line, r.end_line, r.chunk_type) for r in rows.get(path, [])]
    assert got == CASES[path][1]


def test_contents(rows):
    assert rows["a.go"][0].content == 'package demo\n\nimport "fmt"\n'
    assert rows["a.go"][2].content == "func (t T) Second() int {\n\treturn 2\n}"
    assert rows["A.java"][1].content.startswith("\n    public static")
    assert rows["a.yml"][0].content == "name: a\n"
    assert rows["a.yml"][2].content == "last: 1\n\n"
    assert rows["a.json"][0].content == '"name": "x"'
    assert rows["a.json"][1].content == '"version": "1",\n  "nested": {\n    "b": [1, 2]\n  }'
    assert rows["a.json"][2].content == '"end": true'
    assert rows["a.toml"][0].content == "title = 'x'\nowner = 'y'"
    assert rows["a.toml"][1].content == "[a]\nk = 1\n"
    assert rows["a.toml"][3].content == "  [1, 2],\n]\n\n"
    assert rows["none.md"][0].content == "plain\n\ntext\n"
    assert rows["crlf.txt"][0].content == "a\r"
    assert rows["mark.go"][0].content == "\x01\x03x"
    assert rows["mark.go"][1].content == "func a() {}\n\x01\x03y"


def test_route_prefers_given_language(spark):
    docs = spark.createDataFrame(
        [("x.txt", "# H\nt", "Markdown"), ("x.md", "# H\nt", "unknown"), ("y.md", "# H\n\nt", "ruby"), ("z.jsx", "class A\n", "")],
        "path string, content string, language string",
    )
    got = {(r.file_path, r.chunk_type, r.end_line) for r in chunk_documents(docs).collect()}
    assert got == {
        ("x.txt", "header", 2),
        ("x.md", "header", 2),
        ("y.md", "paragraph", 1),
        ("y.md", "paragraph", 3),
        ("z.jsx", "paragraph", 1),
    }


def test_unlisted_language_is_one_code_chunk(spark):
    df = spark.createDataFrame([("a\nb\n",)], "content string")
    got = df.select(F.explode(code_chunks(F.col("content"), F.lit("rust"))).alias("c")).select("c.*").collect()
    assert [(r.content, r.start_line, r.end_line, r.chunk_type) for r in got] == [("a\nb\n", 1, 3, "code")]


def pack(lines, limit):
    """Piece number per line: fill a piece while it stays within the limit."""
    out, piece, used = [], 0, 0
    for i, line in enumerate(lines):
        size = len(line.encode())
        if used and used + size + 1 > limit:
            piece, used = piece + 1, 0
        used += size + (1 if i else 0)
        out.append(piece)
    return out


@pytest.mark.parametrize(
    "text",
    [
        "\n".join(f"line {i} " + "x" * (i % 90) for i in range(400)),
        "y" * 5000,
        "a\n" + "y" * 5000 + "\nb",
        "\n".join(["é" * 1000] * 7),
        "\n".join(["z" * 1999] * 5),
        "\n" * 20 + "w" * 4100,
    ],
)
def test_size_split(spark, text):
    df = spark.createDataFrame([(text, 11, 500, True)], "content string, start_line int, end_line int, divisible boolean")
    got = sorted(split_large(df).collect(), key=lambda r: r.start_line)
    assert "".join(r.content for r in got) == text
    lines = text.split("\n")
    numbers = pack(lines, 4000)
    starts = [11 + numbers.index(p) for p in range(max(numbers) + 1)]
    assert [r.start_line for r in got] == starts
    assert [r.end_line for r in got] == [s - 1 for s in starts[1:]] + [500]
    for r in got:
        assert len(r.content.encode()) <= 4001 or "\n" not in r.content.lstrip("\n")


def test_undivided_kinds_stay_whole(spark):
    big = "\n".join(["import x"] * 1000)
    docs = spark.createDataFrame(
        [("p.go", big + "\nfunc a() {}"), ("n.go", big), ("n.md", big), ("n.txt", big)],
        "path string, content string",
    )
    counts = {}
    for r in chunk_documents(docs).collect():
        counts[r.file_path] = counts.get(r.file_path, 0) + 1
    assert counts["p.go"] == 2 and counts["n.go"] == 1 and counts["n.md"] == 1 and counts["n.txt"] > 1


def test_long_json_keeps_depth_across_blocks(spark):
    body = ",\n".join(f'  "k{i}": {{\n    "x": [1]\n  }}' if i % 7 == 0 else f'  "k{i}": {i}' for i in range(1500))
    docs = spark.createDataFrame([("l.json", "{\n" + body + "\n}\n")], "path string, content string")
    got = chunk_documents(docs, limit=10**9).orderBy("start_line").collect()
    assert len(got) == 1500 - len(range(0, 1500, 7))
    assert got[0].content == '"k1": 1'


def test_no_shuffle(spark):
    docs = spark.createDataFrame([("a.txt", "x")], "path string, content string")
    plan = chunk_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
