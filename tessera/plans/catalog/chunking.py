"""Chunking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.chunk import chunk_documents, with_chunk_route
from tessera.plans.catalog.shapes import (
    EXTENSION,
    FORMATS,
    document_path_sql,
    documents_as,
    documents_as_sql,
    documents_mixed,
    shaped_sql,
    table,
)

# White space in the checking engine's pattern language.
WS = (
    r"\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# The boundary patterns in that language.
_PATTERNS = {
    "go": r"^func\s+",
    "python": r"^(class|def)\s+\w+",
    "javascript": r"^(async\s+)?function\s+\w+|^(export\s+)?(async\s+)?function\s+\w+|^class\s+\w+",
    "java": r"^\s*(public|private|protected)?\s*(static)?\s*\w+\s+\w+\s*\(",
    "markdown": r"^#{1,6}\s+",
}


def blank_sql(text: str) -> str:
    return f"NOT regexp_matches({text}, '[^{WS}]')"


def trim_sql(text: str) -> str:
    return f"regexp_replace({text}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def _boundary_sql(fmt: str) -> str:
    if fmt in _PATTERNS:
        return "starts_with(mline, chr(1))"
    if fmt == "yaml":
        return "regexp_matches(line, '^[a-zA-Z_][a-zA-Z0-9_-]*:')"
    if fmt == "toml":
        return r"regexp_matches(line, '^\s*\[[^\]]+\]')"
    if fmt == "json":
        return (
            "braces = 1 AND brackets = 0 AND "
            f"regexp_matches({trim_sql('line')}, '^\\s*\"[^\"]+\"\\s*:')"
        )
    return (
        f"NOT ({blank_sql('line')}) AND (n = 1 OR {blank_sql('lag(line) OVER (PARTITION BY path ORDER BY n)')})"
    )


def raw_chunk_ctes(fmt: str, docs: str) -> str:
    """CTEs ending in ``raw_<fmt>``: chunks of ``docs(path, content)`` before the size split."""
    marked = (
        f"regexp_replace(content, '(?m){_PATTERNS[fmt]}', chr(1) || '\\0', 'g')"
        if fmt in _PATTERNS
        else "content"
    )

    def net(a: str, b: str) -> str:
        def count(c: str) -> str:
            return f"(length(line) - length(replace(line, '{c}', '')))"

        return f"sum({count(a)} - {count(b)}) OVER (PARTITION BY path ORDER BY n)"

    depth = f", {net('{', '}')} AS braces, {net('[', ']')} AS brackets" if fmt == "json" else ""
    shown = "TRUE"
    if fmt == "text":
        shown = "NOT blank"
    if fmt == "json":
        shown = f"n = s OR {trim_sql('line')} NOT IN ('{{', '}}')"
    if fmt == "json":
        solid = f"{trim_sql('line')} NOT IN ('', '}}', '}},')"
    else:
        solid = "NOT blank"
    head = f"""
ln_{fmt} AS (
  SELECT path, generate_subscripts(ls, 1) AS n, unnest(ls) AS line, unnest(ms) AS mline
  FROM (SELECT path, string_split(content, chr(10)) AS ls, string_split({marked}, chr(10)) AS ms
        FROM {docs} WHERE NOT ({blank_sql('content')}))),
dp_{fmt} AS (SELECT *{depth} FROM ln_{fmt}),
bd_{fmt} AS (SELECT *, {blank_sql('line')} AS blank, CASE WHEN {_boundary_sql(fmt)} THEN 1 ELSE 0 END AS opens FROM dp_{fmt}),
sn_{fmt} AS (SELECT *, sum(opens) OVER (PARTITION BY path ORDER BY n) AS seg, sum(opens) OVER (PARTITION BY path) AS segs FROM bd_{fmt}),
rg_{fmt} AS (
  SELECT path, seg, segs, min(n) AS s, max(n) AS e, min(n) FILTER (WHERE NOT blank) AS first_solid,
         max(n) FILTER (WHERE {solid}) AS last_solid
  FROM sn_{fmt} GROUP BY path, seg, segs),
tx_{fmt} AS (
  SELECT path, seg, segs, s, e, first_solid, last_solid, greatest(s, coalesce(last_solid, s)) AS te,
         string_agg(line, chr(10) ORDER BY n) FILTER (WHERE {shown}) AS body,
         string_agg(line, chr(10) ORDER BY n) FILTER (WHERE n <= greatest(s, coalesce(last_solid, s))) AS trimmed,
         string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT blank) AS solid
  FROM sn_{fmt} JOIN rg_{fmt} USING (path, seg, segs) GROUP BY ALL)"""
    if fmt in ("go", "python", "javascript", "java"):
        kind = "'function'"
        if fmt in ("python", "javascript"):
            kind = f"CASE WHEN starts_with({trim_sql('trimmed')}, 'class ') THEN 'class' ELSE 'function' END"
        rows = f"""
  SELECT path, s AS start_line, e AS end_line, 'code' AS chunk_type, body AS content, FALSE AS divisible FROM tx_{fmt} WHERE segs = 0
  UNION ALL SELECT path, s, e, 'preamble', body, FALSE FROM tx_{fmt} WHERE segs > 0 AND seg = 0 AND last_solid IS NOT NULL
  UNION ALL SELECT path, s, te, {kind}, trimmed, TRUE FROM tx_{fmt} WHERE seg > 0"""
    elif fmt == "markdown":
        rows = f"""
  SELECT path, s AS start_line, e AS end_line, 'paragraph' AS chunk_type, body AS content, FALSE AS divisible FROM tx_{fmt} WHERE segs = 0
  UNION ALL SELECT path, s, te, 'header', trimmed, TRUE FROM tx_{fmt} WHERE seg > 0"""
    elif fmt == "yaml":
        rows = f"""
  SELECT path, s AS start_line, CASE WHEN seg = segs THEN te ELSE e END AS end_line, 'config_key' AS chunk_type,
         body AS content, TRUE AS divisible FROM tx_{fmt} WHERE seg > 0"""
    elif fmt == "toml":
        rows = f"""
  SELECT path, s AS start_line, te AS end_line, 'config_key' AS chunk_type, body AS content, TRUE AS divisible
  FROM tx_{fmt} WHERE seg > 0
  UNION ALL SELECT path, first_solid, last_solid, 'config_key', solid, TRUE FROM tx_{fmt} WHERE seg = 0 AND last_solid IS NOT NULL"""
    elif fmt == "json":
        rows = f"""
  SELECT path, s AS start_line, CASE WHEN seg = segs THEN te ELSE e END AS end_line, 'config_key' AS chunk_type,
         regexp_replace({trim_sql('body')}, ',$', '') AS content, TRUE AS divisible FROM tx_{fmt} WHERE seg > 0"""
    else:
        rows = f"""
  SELECT path, s AS start_line, last_solid AS end_line, 'paragraph' AS chunk_type, body AS content, TRUE AS divisible
  FROM tx_{fmt} WHERE seg > 0"""
    return f"{head},\nraw_{fmt} AS ({rows})"


def split_ctes(raw: str, out: str, limit: int = 4000) -> str:
    """CTEs ending in ``out``: chunks of ``raw`` with large ones cut by lines."""
    opens = f"r.used + strlen(b.line) + 1 > {limit} AND r.used > 0"
    return f"""
big_{out} AS (SELECT * FROM {raw} WHERE divisible AND strlen(content) > {limit}),
bl_{out} AS (
  SELECT path, start_line, generate_subscripts(ls, 1) AS i, unnest(ls) AS line
  FROM (SELECT path, start_line, string_split(content, chr(10)) AS ls FROM big_{out})),
rec_{out} AS (
  SELECT path, start_line, i, strlen(line) AS used, 0 AS piece FROM bl_{out} WHERE i = 1
  UNION ALL
  SELECT b.path, b.start_line, b.i,
         CASE WHEN {opens} THEN 1 + strlen(b.line) ELSE r.used + 1 + strlen(b.line) END,
         r.piece + CASE WHEN {opens} THEN 1 ELSE 0 END
  FROM rec_{out} r JOIN bl_{out} b ON b.path = r.path AND b.start_line = r.start_line AND b.i = r.i + 1),
pc_{out} AS (
  SELECT path, start_line, piece, min(i) AS a, max(i) AS z, string_agg(line, chr(10) ORDER BY i) AS body
  FROM rec_{out} JOIN bl_{out} USING (path, start_line, i) GROUP BY path, start_line, piece),
{out} AS (
  SELECT path AS file_path, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, chunk_type, content
  FROM {raw} WHERE NOT (divisible AND strlen(content) > {limit})
  UNION ALL
  SELECT p.path, (p.start_line + p.a - 1)::INTEGER,
         (CASE WHEN p.piece = max(p.piece) OVER (PARTITION BY p.path, p.start_line) THEN g.end_line ELSE p.start_line + p.z - 1 END)::INTEGER,
         g.chunk_type, CASE WHEN p.piece > 0 THEN chr(10) || p.body ELSE p.body END
  FROM pc_{out} p JOIN big_{out} g USING (path, start_line))"""


def chunk_ctes(fmt: str, docs_sql: str) -> str:
    """``WITH`` clause ending in ``chunks`` for all rows of ``docs_sql``."""
    return (
        f"WITH RECURSIVE docs AS ({docs_sql}),{raw_chunk_ctes(fmt, 'docs')},{split_ctes('raw_' + fmt, 'chunks')}"
    )


_COLUMNS = ["file_path", "start_line", "end_line", "chunk_type", "content"]


def _format_query(fmt: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return chunk_documents(documents_as(spark, sf_dir, fmt)).select(*_COLUMNS)

    return run


def _dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(documents_mixed(spark, sf_dir)).select(*_COLUMNS)


def _dispatch_sql() -> str:
    ctes, union = [], []
    for n, fmt in enumerate(FORMATS):
        path = document_path_sql(repr(EXTENSION[fmt]))
        ctes.append(
            f"docs_{fmt} AS (SELECT {path} AS path, {shaped_sql(fmt)} AS content FROM documents "
            f"WHERE doc_id % {len(FORMATS)} = {n})"
        )
        ctes.append(raw_chunk_ctes(fmt, f"docs_{fmt}"))
        union.append(f"SELECT path, start_line, end_line, chunk_type, content, divisible FROM raw_{fmt}")
    ctes.append(f"raw AS ({' UNION ALL '.join(union)})")
    ctes.append(split_ctes("raw", "chunks"))
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT * FROM chunks"


_SUFFIXES = [".go", ".PY", ".js", ".jsx", ".ts", ".tsx", ".java", ".md", ".markdown", ".yml", ".Yaml", ".json", ".toml", ".c", ""]


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    suffix = F.get(F.array(*[F.lit(s) for s in _SUFFIXES]), (F.col("doc_id") % len(_SUFFIXES)).cast("int"))
    given = (
        F.when(F.col("n_chars") % 4 == 0, F.lit("unknown"))
        .when(F.col("n_chars") % 4 == 1, F.lit("Markdown"))
        .when(F.col("n_chars") % 4 == 2, F.lit(""))
    )
    named = docs.select(
        F.concat("source", F.lit("/v1.2/d"), F.col("doc_id").cast("string"), suffix).alias("path"),
        given.alias("language"),
    )
    return with_chunk_route(named).select("path", "route")


def _routes_sql() -> str:
    suffix = f"({_SUFFIXES!r})[(doc_id % {len(_SUFFIXES)} + 1)::INTEGER]"
    # Chunker by extension.
    known = {
        ".go": "go", ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java",
        ".md": "markdown", ".markdown": "markdown", ".yml": "yaml", ".yaml": "yaml", ".json": "json", ".toml": "toml",
    }
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in known.items())
    return f"""
SELECT path, CASE WHEN n_chars % 4 = 1 THEN 'markdown' ELSE CASE lower(suffix) {whens} ELSE 'text' END END AS route
FROM (SELECT source || '/v1.2/d' || doc_id::VARCHAR || {suffix} AS path, {suffix} AS suffix, n_chars FROM documents)"""


def _piece_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: pieces, bytes over all pieces, largest piece."""
    docs = documents_as(spark, sf_dir, "text")
    return (
        chunk_documents(docs)
        .groupBy("file_path")
        .agg(
            F.count(F.lit(1)).alias("pieces"),
            F.sum(F.octet_length("content")).alias("bytes"),
            F.max(F.octet_length("content")).cast("bigint").alias("largest"),
            F.max("end_line").alias("last_line"),
        )
    )


_NAMES = {
    "go": "c02_go_chunks",
    "python": "c03_python_chunks",
    "javascript": "c04_script_chunks",
    "java": "c05_java_chunks",
    "markdown": "c09_markdown_chunks",
    "text": "c10_paragraph_chunks",
    "yaml": "c11_yaml_chunks",
    "json": "c12_json_chunks",
    "toml": "c13_toml_chunks",
}

QUERIES = {
    "c01_dispatch": _dispatch,
    **{name: _format_query(fmt) for fmt, name in _NAMES.items()},
    "c14_size_split": _piece_invariants,
    "d02_chunk_route": _routes,
}

SQL = {
    "c01_dispatch": _dispatch_sql(),
    **{
        name: chunk_ctes(fmt, documents_as_sql(fmt)) + " SELECT * FROM chunks" for fmt, name in _NAMES.items()
    },
    "c14_size_split": chunk_ctes("text", documents_as_sql("text"))
    + """
SELECT file_path, count(*) AS pieces, sum(strlen(content))::BIGINT AS bytes, max(strlen(content)) AS largest,
       max(end_line) AS last_line FROM chunks GROUP BY file_path""",
    "d02_chunk_route": _routes_sql(),
}
