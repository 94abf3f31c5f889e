"""Inputs derived from the tables, as Spark expressions and as SQL.

``documents.text`` has neither headers nor functions nor keys, so each chunker
gets the text with every line rewritten into its format. ``i`` counts lines from
zero on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.corpus import spread

EXTENSION = {
    "go": ".go",
    "python": ".py",
    "javascript": ".js",
    "java": ".java",
    "markdown": ".md",
    "yaml": ".yaml",
    "json": ".json",
    "toml": ".toml",
    "text": ".txt",
}
FORMATS = list(EXTENSION)

# Per format: cases of (modulus, remainder, text before, text after); ``{i}`` is
# the line number. Lines that fit no case stay as they are, but for YAML's indent.
_CASES: dict[str, list[tuple[int, int, str, str]]] = {
    "go": [(3, 1, "func F(", ") {"), (3, 2, "", "\n \n}")],
    "python": [(6, 1, "class C ", ""), (6, 4, "def f{i}(): ", ""), (3, 2, "", "\n")],
    "javascript": [
        (6, 1, "export async function f ", ""),
        (6, 4, "class C ", ""),
        (6, 3, "const f = () => ", ""),
        (3, 2, "", "\n\t"),
    ],
    "java": [(3, 1, "\n  public static void m(", ")"), (6, 5, "else if (", ")")],
    "markdown": [(3, 1, "## ", ""), (6, 3, "#####\n", ""), (3, 2, "", "\n")],
    "yaml": [(3, 1, "key_{i}: ", ""), (6, 5, "  # ", "\n"), (1, 0, "  ", "")],
    "toml": [(4, 1, "[s.{i}]\n", ""), (4, 3, "", "\n")],
    "json": [(3, 2, '  "k{i}": {\n    "v": "', '"\n  }'), (1, 0, '  "k{i}": "', '"')],
    "text": [(3, 1, "", "\n"), (6, 5, "", "\n \t\n")],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shaped(text: Column, fmt: str) -> Column:
    def numbered(template: str, i: Column) -> Column:
        head, sep, tail = template.partition("{i}")
        if not sep:
            return F.lit(head)
        return F.concat(F.lit(head), i.cast("string"), F.lit(tail))

    def line(l: Column, i: Column) -> Column:
        if fmt == "json":
            l = F.replace(F.replace(l, F.lit('"'), F.lit("")), F.lit("\\"), F.lit(""))
        out = None
        for modulus, remainder, before, after in _CASES[fmt]:
            value = F.concat(numbered(before, i), l, F.lit(after))
            test = i % modulus == remainder
            out = F.when(test, value) if out is None else out.when(test, value)
        return out.otherwise(l)

    joint = ",\n" if fmt == "json" else "\n"
    body = F.array_join(F.transform(F.split(text, "\n", -1), line), joint)
    return F.concat(F.lit("{\n"), body, F.lit("\n}\n")) if fmt == "json" else body


def shaped_sql(fmt: str, text: str = "text") -> str:
    def quoted(value: str) -> str:
        parts = ["'" + p.replace("'", "''") + "'" for p in value.split("\n")]
        return " || chr(10) || ".join(parts).replace("\t", "' || chr(9) || '")

    def numbered(template: str) -> str:
        head, sep, tail = template.partition("{i}")
        return quoted(head) if not sep else f"{quoted(head)} || (k - 1)::VARCHAR || {quoted(tail)}"

    l = "replace(replace(l, '\"', ''), chr(92), '')" if fmt == "json" else "l"
    whens = " ".join(
        f"WHEN (k - 1) % {m} = {r} THEN {numbered(b)} || {l} || {quoted(a)}" for m, r, b, a in _CASES[fmt]
    )
    joint = "',' || chr(10)" if fmt == "json" else "chr(10)"
    body = (
        f"array_to_string(list_transform(string_split({text}, chr(10)), "
        f"lambda l, k: CASE {whens} ELSE {l} END), {joint})"
    )
    return f"'{{' || chr(10) || {body} || chr(10) || '}}' || chr(10)" if fmt == "json" else body


def document_path(extension: Column) -> Column:
    return F.concat(
        F.col("source"), F.lit("/"), F.col("lang"), F.lit("/d"), F.col("doc_id").cast("string"), extension
    )


def document_path_sql(extension: str) -> str:
    return f"source || '/' || lang || '/d' || doc_id::VARCHAR || {extension}"


def documents_as(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    """All documents as files of one format: ``(path, content)``."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "text")
    return spread(docs).select(
        document_path(F.lit(EXTENSION[fmt])).alias("path"), shaped(F.col("text"), fmt).alias("content")
    )


def documents_as_sql(fmt: str) -> str:
    return (
        f"SELECT {document_path_sql(repr(EXTENSION[fmt]))} AS path, {shaped_sql(fmt)} AS content FROM documents"
    )


def documents_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, their format following from the document number."""
    docs = spread(table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "text"))
    kind = F.col("doc_id") % len(FORMATS)
    extension, content = None, None
    for n, fmt in enumerate(FORMATS):
        text = shaped(F.col("text"), fmt)
        ext = F.lit(EXTENSION[fmt])
        extension = F.when(kind == n, ext) if extension is None else extension.when(kind == n, ext)
        content = F.when(kind == n, text) if content is None else content.when(kind == n, text)
    return docs.select(document_path(extension).alias("path"), content.alias("content"))


def epoch_nanos(timestamp: Column) -> Column:
    """Nanoseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    t = timestamp.cast("timestamp_ntz")
    days = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = days * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    micros = (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long") % 1_000_000
    return (seconds.cast("long") * 1_000_000 + micros) * 1000
