"""Filter and secret queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.chunk import drop_blank
from tessera.operators.filters import (
    drop_binary,
    drop_hidden,
    drop_ignored,
    drop_metadata_file,
    flag_skipped,
    ignore_rulesets,
)
from tessera.operators.secrets import find_secrets, redact
from tessera.plans.catalog.chunking import blank_sql
from tessera.plans.catalog.shapes import table
from tessera.schema import METADATA_FILE_NAME
from tessera.sources.corpus import spread

_SUFFIXES = [".md", ".log", ".tmp", ".py"]


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files; some below ``build`` or below a hidden folder."""
    folder = (
        F.when(F.col("n_chars") % 5 == 0, F.lit("/build"))
        .when(F.col("n_chars") % 7 == 0, F.lit("/.cache/deep"))
        .otherwise(F.lit(""))
    )
    name = F.concat(
        F.when(F.col("n_chars") % 11 == 0, F.lit(".")).otherwise(F.lit("")),
        F.lit("d"),
        F.col("doc_id").cast("string"),
        F.get(F.array(*[F.lit(s) for s in _SUFFIXES]), (F.col("doc_id") % 4).cast("int")),
    )
    rel = F.concat(F.col("source"), F.lit("/"), F.col("lang"), folder, F.lit("/"), name)
    return table(spark, sf_dir, "documents").select(
        F.lit("/corpus").alias("root"),
        F.concat(F.lit("/corpus/"), rel).alias("path"),
        rel.alias("rel_path"),
        F.col("n_chars").alias("size"),
        F.lit(False).alias("is_dir"),
    )


LISTING_SQL = f"""
SELECT rel_path, n_chars AS size, source, lang, doc_id, n_chars FROM (
  SELECT *, source || '/' || lang
    || CASE WHEN n_chars % 5 = 0 THEN '/build' WHEN n_chars % 7 = 0 THEN '/.cache/deep' ELSE '' END || '/'
    || CASE WHEN n_chars % 11 = 0 THEN '.' ELSE '' END || 'd' || doc_id::VARCHAR
    || ({_SUFFIXES!r})[(doc_id % 4 + 1)::INTEGER] AS rel_path
  FROM documents)"""


def _hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_hidden(listing(spark, sf_dir)).select("rel_path", "size")


def _ignore_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ignore file at the root and one per source folder."""
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    own = sources.select(
        F.lit("/corpus").alias("root"),
        F.concat("source", F.lit("/.gitignore")).alias("rel_path"),
        F.concat(
            F.lit("# per source\n*.log\n!*1.log\nfr/*.md\n/"),
            F.col("source"),
            F.lit("/es/\n\n**/build/d[0-4]*\n"),
        ).alias("content"),
    )
    root = sources.agg(F.count(F.lit(1))).select(
        F.lit("/corpus").alias("root"),
        F.lit(".gitignore").alias("rel_path"),
        F.lit("*.tmp\r\nsrc1?/de/build/  \nd1.py/\n").alias("content"),
    )
    return own.unionByName(root)


def _ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ignore_rulesets(_ignore_files(spark, sf_dir))
    return drop_ignored(listing(spark, sf_dir), rules).select("rel_path", "size")


_IGNORED_SQL = f"""
SELECT rel_path, size FROM ({LISTING_SQL})
WHERE NOT (
     rel_path LIKE '%.tmp'
  OR (rel_path LIKE '%.log' AND rel_path NOT LIKE '%1.log')
  OR lang = 'es'
  OR (lang = 'de' AND regexp_matches(source, '^src1.$') AND n_chars % 5 = 0)
  OR regexp_matches(rel_path, '(^|/)build/d[0-4]'))"""


def _with_nul(text: Column) -> Column:
    at = (F.col("doc_id") * 997 % 12000).cast("int")
    return F.concat(
        F.encode(F.substring(text, F.lit(1), at), "UTF-8"),
        F.unhex(F.lit("00")),
        F.encode(F.substr(text, at + 1), "UTF-8"),
    )


def _binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", _with_nul(F.repeat(F.col("text"), F.lit(4))).alias("content")
    )
    return drop_binary(docs).select("doc_id", F.octet_length("content").cast("bigint").alias("size"))


_NAMES = [".env", ".setenv", "server.pem", "id.key", "credentials.json", "credentials", "notes.txt", "env", "key.txt"]


def _names() -> Column:
    name = F.get(F.array(*[F.lit(n) for n in _NAMES]), (F.col("p_partkey") % len(_NAMES)).cast("int"))
    return F.concat(F.lit("/p.pem/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("/"), name)


def _skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", _names().alias("path"))
    return flag_skipped(parts).select("p_partkey", "path", "should_skip")


_SKIPPED_SQL = f"""
SELECT p_partkey, path, base IN ('.env', '.setenv') OR base LIKE '%.pem' OR base LIKE '%.key' OR base LIKE 'credentials.%' AS should_skip
FROM (SELECT p_partkey, ({_NAMES!r})[(p_partkey % {len(_NAMES)} + 1)::INTEGER] AS base,
             '/p.pem/' || replace(p_name, ' ', '/') || '/' || ({_NAMES!r})[(p_partkey % {len(_NAMES)} + 1)::INTEGER] AS path FROM part)"""


def _kept_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        flag_skipped(table(spark, sf_dir, "part").select("p_partkey", _names().alias("path")))
        .filter(~F.col("should_skip"))
        .select("p_partkey", "path")
    )


def _blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaces = F.lit("\t \n  \u0085\r\n")
    content = (
        F.when(F.col("n_chars") % 3 == 0, spaces)
        .when(F.col("n_chars") % 3 == 1, F.concat(spaces, F.col("text")))
        .otherwise(F.col("text"))
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))
    return drop_blank(docs).select("doc_id", F.length("content").cast("bigint").alias("chars"))


_SPACES = "chr(9) || ' ' || chr(10) || chr(160) || chr(8195) || chr(133) || chr(13) || chr(10)"


def _metadata_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("o_orderstatus") == "P", F.lit(METADATA_FILE_NAME)).otherwise(F.lit("data.json"))
    files = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("/c"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit("/"), name).alias("path")
    )
    return drop_metadata_file(files)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content")
    )


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_docs(spark, sf_dir))


_ASSIGNED = (
    r"""(?i)((?:token|secret|password|passwd|api[_-]?key)["'']?[ \t]*(?::=|[:=])[ \t]*["''])"""
    r"""([0-9a-z_.=+/-]{8,})(["''])"""
)
_CLOUD = r"(\b)((?:AKIA|ASIA)[0-9A-Z]{16})(\b)"
_HOSTING = r"(\b)(gh[pousr]_[0-9A-Za-z]{36,})(\b)"
_HEADER = r"()(-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----)()"


def _planted(spark: SparkSession, sf_dir: str, keys: bool) -> DataFrame:
    """Documents with a line that each rule finds, or just does not, by turns."""
    number = F.col("doc_id").cast("string")
    small, large = F.md5(number), F.substring(F.upper(F.md5(number)), 1, 16)
    turn = F.col("doc_id") % 6
    line = (
        F.when(turn == 0, F.concat(F.lit("key AKIA"), large, F.lit(" end")))
        .when(turn == 1, F.concat(F.lit('export TOKEN = "'), small, F.lit('"')))
        .when(turn == 2, F.concat(F.lit("ghp_"), small, small))
        .when(turn == 3, F.lit(_KEY_LINE if keys else _NO_KEY_LINE))
        .when(turn == 4, F.concat(F.lit("password: 'x1' AKIA"), F.lower(large)))
        .otherwise(F.concat(F.lit("api-key := '"), small, F.lit("' and ASIA"), large))
    )
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        F.concat(F.lit("d"), number).alias("path"), F.concat_ws("\n", "text", line, F.lit("tail")).alias("content")
    )


def _planted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_planted(spark, sf_dir, True))


def _planted_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(_planted(spark, sf_dir, False)).select("path", "content")


_KEY_LINE = "-----BEGIN RSA PRIVATE KEY-----"
_NO_KEY_LINE = "BEGIN RSA PRIVATE KEY"


def _planted_sql(keys: bool) -> str:
    return f"""text || chr(10) || CASE doc_id % 6
    WHEN 0 THEN 'key AKIA' || left(upper(md5(doc_id::VARCHAR)), 16) || ' end'
    WHEN 1 THEN 'export TOKEN = "' || md5(doc_id::VARCHAR) || '"'
    WHEN 2 THEN 'ghp_' || md5(doc_id::VARCHAR) || md5(doc_id::VARCHAR)
    WHEN 3 THEN '{_KEY_LINE if keys else _NO_KEY_LINE}'
    WHEN 4 THEN 'password: ' || chr(39) || 'x1' || chr(39) || ' AKIA' || left(md5(doc_id::VARCHAR), 16)
    ELSE 'api-key := ' || chr(39) || md5(doc_id::VARCHAR) || chr(39) || ' and ASIA' || left(upper(md5(doc_id::VARCHAR)), 16)
  END || chr(10) || 'tail'"""


def _findings_sql(text: str = "text") -> str:
    rules = [
        ("assigned-secret", _ASSIGNED),
        ("cloud-access-key", _CLOUD),
        ("hosting-token", _HOSTING),
        ("private-key", _HEADER),
    ]
    union = " UNION ALL ".join(
        f"SELECT file_path, line, '{kind}' AS type, "
        f"string_split(regexp_replace(text, '{pattern}', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g'), chr(1)) AS parts FROM lines"
        for kind, pattern in rules
    )
    return f"""
WITH lines AS (
  SELECT 'd' || doc_id::VARCHAR AS file_path, generate_subscripts(ls, 1)::INTEGER AS line, unnest(ls) AS text
  FROM (SELECT doc_id, string_split({text}, chr(10)) AS ls FROM documents)),
marked AS ({union}),
hits AS (SELECT *, unnest(range(2, len(parts) + 1)) AS k FROM marked WHERE len(parts) > 1)
SELECT file_path, line, (1 + length(replace(array_to_string(parts[1:k - 1], ''), chr(2), '')))::INTEGER AS col,
       string_split(parts[k], chr(2))[1] AS match, type FROM hits"""


def _redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(_docs(spark, sf_dir)).select("path", "content")


def redact_sql(text: str) -> str:
    """Redaction of ``text``; the tables hold no private keys."""
    for pattern in (_ASSIGNED, _CLOUD, _HOSTING):
        text = f"regexp_replace({text}, '{pattern}', '\\1[REDACTED]\\3', 'g')"
    return text


QUERIES = {
    "f01_hidden_folders": _hidden,
    "f02_ignore_rules": _ignored,
    "f03_binary_content": _binary,
    "f04_skip_list": _kept_files,
    "f05_blank_content": _blank,
    "f06_metadata_file": _metadata_file,
    "x01_should_skip": _skipped,
    "x02_findings": _findings,
    "x03_redaction": _redacted,
    "x04_planted_findings": _planted_findings,
    "x05_planted_redaction": _planted_redaction,
}

SQL = {
    "f01_hidden_folders": f"SELECT rel_path, size FROM ({LISTING_SQL}) WHERE rel_path NOT LIKE '%/.cache/%'",
    "f02_ignore_rules": _IGNORED_SQL,
    "f03_binary_content": """
SELECT doc_id, strlen(t) + 1 AS size FROM (SELECT doc_id, repeat(text, 4) AS t FROM documents)
WHERE strlen(left(t, doc_id * 997 % 12000)) >= 8192""",
    "f04_skip_list": f"SELECT p_partkey, path FROM ({_SKIPPED_SQL}) WHERE NOT should_skip",
    "f05_blank_content": f"""
SELECT doc_id, length(c) AS chars FROM (
  SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN {_SPACES} WHEN n_chars % 3 = 1 THEN {_SPACES} || text ELSE text END AS c
  FROM documents) WHERE NOT ({blank_sql('c')})""",
    "f06_metadata_file": """
SELECT '/c' || o_custkey::VARCHAR || '/' || o_orderkey::VARCHAR || '/data.json' AS path FROM orders WHERE o_orderstatus <> 'P'""",
    "x01_should_skip": _SKIPPED_SQL,
    "x02_findings": _findings_sql(),
    "x03_redaction": f"SELECT 'd' || doc_id::VARCHAR AS path, {redact_sql('text')} AS content FROM documents",
    "x04_planted_findings": _findings_sql(_planted_sql(True)),
    "x05_planted_redaction": f"""
SELECT path, {redact_sql('content')} AS content FROM (SELECT 'd' || doc_id::VARCHAR AS path, {_planted_sql(False)} AS content FROM documents)""",
}
