"""Language, project and dependency queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.detect import (
    dependencies,
    detect_projects,
    root_rollup,
    with_language,
    with_project,
)
from tessera.plans.catalog.shapes import table
from tessera.sources.corpus import spread

# Extensions and markers with what they stand for.
_SUFFIXES = [".go", ".PY", ".js", ".jsx", ".ts", ".tsx", ".java", ".rs", ".rb", ".c", ".h", ".cpp", ".cc", ".cxx",
             ".hpp", ".md", ".json", ".yaml", ".yml", ".toml", ".xyz", ""]
_LANGUAGES = ["go", "python", "javascript", "javascript", "typescript", "typescript", "java", "rust", "ruby", "c", "c",
              "cpp", "cpp", "cpp", "cpp", "markdown", "json", "yaml", "yaml", "toml", "unknown", "unknown"]

_MARKERS = ["go.mod", "package.json", "requirements.txt", "pyproject.toml", "setup.py", "Cargo.toml", "pom.xml",
            "build.gradle", "Gemfile"]
_TYPES = ["go", "node", "python", "python", "python", "rust", "java", "java", "ruby"]
_NAMES = ["README.md", "src", ".hg", "Gemfile", ".idea", ".svn", "pom.xml", "Cargo.toml", ".git", "setup.py", "x.go",
          ".vscode", "package.json", "build.gradle", "requirements.txt", "pyproject.toml", "go.mod"]


def _pick(values: list[str], number):
    return F.get(F.array(*[F.lit(v) for v in values]), (number % len(values)).cast("int"))


def _pick_sql(values: list[str], number: str) -> str:
    return f"({values!r})[({number} % {len(values)} + 1)::INTEGER]"


def _named_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/"), F.col("source"), F.lit("/a.b/d"), F.col("doc_id").cast("string"), _pick(_SUFFIXES, F.col("doc_id"))).alias("path"),
        F.concat(F.lit("/"), F.col("source")).alias("root"),
        F.lit(False).alias("is_dir"),
    )


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_language(_named_documents(spark, sf_dir)).select("path", "language")


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker files and folders: a few entries per repository and sub-folder."""
    name = _pick(_NAMES, F.col("p_partkey"))
    repository = F.concat(F.lit("/repo/r"), F.floor(F.col("p_partkey") / 4).cast("string"))
    nested = F.when(F.col("p_size") % 3 == 0, F.lit("/s1")).otherwise(F.lit(""))
    return table(spark, sf_dir, "part").select(
        F.concat(repository, nested, F.lit("/"), name).alias("path"),
        (F.startswith(name, F.lit(".")) & (F.col("p_size") % 5 != 0)).alias("is_dir"),
    )


_LISTING_SQL = f"""
SELECT '/repo/r' || (p_partkey // 4)::VARCHAR || CASE WHEN p_size % 3 = 0 THEN '/s1' ELSE '' END AS dir,
       {_pick_sql(_NAMES, 'p_partkey')} AS name,
       starts_with({_pick_sql(_NAMES, 'p_partkey')}, '.') AND p_size % 5 <> 0 AS is_dir
FROM part"""

_PROJECTS_SQL = f"""
SELECT dir AS project_path,
       coalesce(({_TYPES!r})[min(list_position({_MARKERS!r}, name))], 'unknown') AS project_type,
       ({_MARKERS!r})[min(list_position({_MARKERS!r}, name))] AS marker,
       bool_or(is_dir AND name IN ('.git', '.svn', '.hg')) AS has_vcs,
       coalesce((['git', 'svn', 'hg'])[min(CASE WHEN is_dir THEN list_position(['.git', '.svn', '.hg'], name) END)], '') AS vcs_type,
       bool_or(is_dir AND name IN ('.vscode', '.idea')) AS has_ide_config
FROM ({_LISTING_SQL})
WHERE list_contains({_MARKERS!r}, name) OR (is_dir AND name IN ('.git', '.svn', '.hg', '.vscode', '.idea'))
GROUP BY dir"""


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_projects(_listing(spark, sf_dir))


def _enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.concat(
        F.lit("/repo/r"), F.col("user_id").cast("string"), F.lit("/s"), (F.col("event_id") % 3).cast("string"),
        F.lit("/"), F.col("event_type"),
    )
    files = table(spark, sf_dir, "events").select(
        F.concat(folder, F.lit("/e"), F.col("event_id").cast("string"), F.lit(".go")).alias("path")
    )
    return with_project(files, detect_projects(_listing(spark, sf_dir))).select(
        "path", "project_path", "project_type"
    )


_ENCLOSING_SQL = f"""
WITH projects AS (SELECT project_path, project_type FROM ({_PROJECTS_SQL}) WHERE project_type <> 'unknown'),
files AS (
  SELECT '/repo/r' || user_id::VARCHAR AS top, '/s' || (event_id % 3)::VARCHAR AS sub,
         '/' || event_type || '/e' || event_id::VARCHAR || '.go' AS rest FROM events)
SELECT top || sub || rest AS path, coalesce(i.project_path, o.project_path, '') AS project_path,
       coalesce(i.project_type, o.project_type, 'unknown') AS project_type
FROM files LEFT JOIN projects i ON i.project_path = top || sub LEFT JOIN projects o ON o.project_path = top"""


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest per part row; its kind follows from the part's size."""
    name, brand, size = F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string")
    text = F.concat(
        F.lit("module demo\n\nrequire alone/"), brand, F.lit(" v"), size,
        F.lit("\nrequire (\n\tlib/"), name, F.lit(" v1\n\t// about "), name,
        F.lit("\n\tshort\n\n\talone/"), brand, F.lit(" v2 // indirect\n)\nreplace x => y\nrequire (\n"),
        F.lit("\tlast/x v"), size, F.lit("\n)\nrequire\ttab v9\nrequire late v3\n"),
    )
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")).select(
        F.concat(F.lit("/p"), F.col("p_partkey").cast("string")).alias("project_path"),
        F.lit("go.mod").alias("marker"),
        text.alias("content"),
    )


def _module_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependencies(_manifests(spark, sf_dir))


_MODULE_SQL = r"""
WITH m AS (
  SELECT p_partkey,
    'module demo' || chr(10) || chr(10) || 'require alone/' || p_brand || ' v' || p_size::VARCHAR || chr(10)
    || 'require (' || chr(10) || chr(9) || 'lib/' || p_name || ' v1' || chr(10) || chr(9) || '// about ' || p_name || chr(10)
    || chr(9) || 'short' || chr(10) || chr(10) || chr(9) || 'alone/' || p_brand || ' v2 // indirect' || chr(10) || ')' || chr(10)
    || 'replace x => y' || chr(10) || 'require (' || chr(10) || chr(9) || 'last/x v' || p_size::VARCHAR || chr(10) || ')' || chr(10)
    || 'require' || chr(9) || 'tab v9' || chr(10) || 'require late v3' || chr(10) AS content
  FROM part),
lines AS (
  SELECT p_partkey, generate_subscripts(ls, 1) AS n, trim(unnest(ls), ' ' || chr(9)) AS line
  FROM (SELECT p_partkey, string_split(content, chr(10)) AS ls FROM m)),
marks AS (
  SELECT *, max(CASE WHEN starts_with(line, 'require (') THEN n END) OVER w AS opened,
            max(CASE WHEN line = ')' THEN n END) OVER w AS closed
  FROM lines WINDOW w AS (PARTITION BY p_partkey ORDER BY n)),
fields AS (SELECT *, string_split_regex(line, '\s+') AS f, opened IS NOT NULL AND opened > coalesce(closed, 0) AS inside FROM marks),
deps AS (
  SELECT p_partkey, n, f[1] AS name, f[2] AS version FROM fields WHERE inside AND NOT starts_with(line, 'require (') AND len(f) >= 2
  UNION ALL
  SELECT p_partkey, n, f[2], f[3] FROM fields WHERE starts_with(line, 'require ') AND NOT contains(line, '(') AND len(f) >= 3)
SELECT '/p' || p_partkey::VARCHAR AS project_path, name, arg_max(version, n) AS version FROM deps GROUP BY p_partkey, name"""


def _package_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as package manifests with repeated keys, some of them malformed or mistyped."""
    kind, key = F.col("event_type"), F.col("event_id").cast("string")
    first = (
        F.when(kind == "error", F.lit("7"))
        .when(kind == "view", F.lit("null"))
        .otherwise(F.concat(F.lit('"^'), F.col("user_id").cast("string"), F.lit('"')))
    )
    text = F.concat(
        F.lit('{"name": "n", "Dependencies": {"d": "1", "a": '), first, F.lit(', "b": "1", "d": "9"}, "devDependencies": {"b": "2", "c'),
        key, F.lit('": "x"}, "name": "again", "props": '), F.col("props"),
        F.when(kind == "purchase", F.lit(",}")).otherwise(F.lit("}")),
    )
    manifests = spread(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "props")).select(
        F.concat(F.lit("/e"), key).alias("project_path"), F.lit("package.json").alias("marker"), text.alias("content")
    )
    return dependencies(manifests)


_PACKAGE_SQL = """
WITH good AS (SELECT '/e' || event_id::VARCHAR AS project_path, * FROM events WHERE event_type NOT IN ('error', 'purchase'))
SELECT project_path, 'a' AS name, CASE WHEN event_type = 'view' THEN '' ELSE '^' || user_id::VARCHAR END AS version FROM good
UNION ALL SELECT project_path, 'b', '2' FROM good
UNION ALL SELECT project_path, 'd', '9' FROM good
UNION ALL SELECT project_path, 'c' || event_id::VARCHAR, 'x' FROM good"""


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _named_documents(spark, sf_dir)
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    root = F.concat(F.lit("/"), F.col("source"))
    projects = sources.select(
        root.alias("project_path"),
        F.when(F.col("source").like("%1"), F.lit("unknown")).otherwise(F.lit("go")).alias("project_type"),
    )
    manifests = sources.select(
        root.alias("project_path"),
        F.lit("go.mod").alias("marker"),
        F.concat(F.lit("require (\n z/"), F.col("source"), F.lit(" v1\n a/b v2\n)")).alias("content"),
    ).filter(~F.col("project_path").like("%1"))
    rolled = root_rollup(files, projects, dependencies(manifests))
    return rolled.select(
        "root", "file_count", "project_type",
        F.array_join("languages", ",").alias("languages"),
        F.array_join(
            F.transform(F.array_sort(F.map_entries("dependencies")), lambda e: F.concat(e.key, F.lit("="), e.value)), ","
        ).alias("dependencies"),
    )


_ROLLUP_SQL = f"""
SELECT '/' || source AS root, count(*)::INTEGER AS file_count,
       CASE WHEN source LIKE '%1' THEN 'unknown' ELSE 'go' END AS project_type,
       string_agg(DISTINCT nullif({_pick_sql(_LANGUAGES, 'doc_id')}, 'unknown'), ',' ORDER BY nullif({_pick_sql(_LANGUAGES, 'doc_id')}, 'unknown')) AS languages,
       CASE WHEN source LIKE '%1' THEN '' ELSE 'a/b=v2,z/' || source || '=v1' END AS dependencies
FROM documents GROUP BY source"""

QUERIES = {
    "d01_language": _languages,
    "d03_projects": _projects,
    "d06_module_dependencies": _module_dependencies,
    "d07_package_dependencies": _package_dependencies,
    "d08_root_rollup": _rollup,
    "j02_enclosing_project": _enclosing,
}

SQL = {
    "d01_language": f"""
SELECT '/' || source || '/a.b/d' || doc_id::VARCHAR || {_pick_sql(_SUFFIXES, 'doc_id')} AS path,
       {_pick_sql(_LANGUAGES, 'doc_id')} AS language FROM documents""",
    "d03_projects": _PROJECTS_SQL,
    "d06_module_dependencies": _MODULE_SQL,
    "d07_package_dependencies": _PACKAGE_SQL,
    "d08_root_rollup": _ROLLUP_SQL,
    "j02_enclosing_project": _ENCLOSING_SQL,
}
