"""Chunkers against SQL on random texts made of awkward lines."""

import random

import duckdb
import pandas as pd
import pytest

from tessera.operators.chunk import chunk_documents
from tessera.plans.catalog.chunking import chunk_ctes
from tessera.plans.catalog.shapes import EXTENSION

COMMON = ["", " ", "\t", " ", " \u0085", "\r", "text", "  indented", "a\rb", "é€😀", "x" * 90, "end ", "\x0b", "-" * 700]
LINES = {
    "go": ["func a() {", "func\tb()", "func", "func ", " func c()", "functional", "func x", "}", "func\r", "func\x0bz"],
    "python": ["class A:", "def f():", "def ", "class ", "  def g():", "async def h():", "@x", "def é", "classy", "def\tq", "class\x0cB"],
    "javascript": ["function a() {", "async function b()", "export function c()", "export async function d()", "class E {",
                   "export class F", "const g = () => 1", "async", "export", "export ", "function", "class", "export default function h()"],
    "java": ["public void a(", "  static int b (", "private c(", "return d(", "else if (x)", "public static void e()", "f g", "(", "h",
             "publicstatic i(", "static static(", "protected", "int j(int k) {", "@Override"],
    "markdown": ["# a", "## ", "##", "###### six", "####### seven", "#no", " # in", "#\tt", "```", "# nb", "#\r"],
    "yaml": ["key:", "a_b-c: 1", "_x:", "9k:", "  nested: 1", "# c", "- item", "a b:", "key :", "k:v", "é:"],
    "json": ["{", "}", "},", '"a": 1,', '  "b": {', '"c": [', "]", "],", '  "d": "}"', '"e" : 2', '{"f": 1}', "[", '"g": {}', " {", "} ", '"h\t": [],'],
    "toml": ["[a]", "  [b.c]", "[[d]]", "[]", "k = 1", "[ [1] ]", "[e", "]", "# [f]", "[g] # h", "x = [", "[1, 2],"],
    "text": ["para", "more", "  lead", "trail  "],
}


@pytest.mark.parametrize("fmt", list(LINES))
def test_random_texts(spark, fmt):
    random.seed(fmt)
    pool = LINES[fmt] * 3 + COMMON
    rows = []
    for n in range(400):
        lines = random.choices(pool, k=random.choice([1, 2, 3, 5, 8, 20, 120]))
        if fmt == "json":
            # Depth one is where keys count; random braces rarely get back to it.
            lines = ["{"] + [l for l in lines if random.random() < 0.3 or l.count("{") + l.count("[") == l.count("}") + l.count("]")]
        rows.append((f"d{n}{EXTENSION[fmt]}", "\n".join(lines)))
    docs = pd.DataFrame(rows, columns=["path", "content"])
    got = sorted(
        (r.file_path, r.start_line, r.end_line, r.chunk_type, r.content)
        for r in chunk_documents(spark.createDataFrame(rows, "path string, content string")).collect()
    )
    con = duckdb.connect()
    con.register("random_docs", docs)
    sql = chunk_ctes(fmt, "SELECT path, content FROM random_docs")
    want = sorted(
        con.execute(sql + " SELECT file_path, start_line, end_line, chunk_type, content FROM chunks").fetchall()
    )
    assert len(got) > 300
    for a, b in zip(got, want):
        assert a == b
    assert len(got) == len(want)
