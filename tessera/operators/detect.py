"""Language, project and dependency detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import base_name, extension, parent, prefixes
from tessera.functions.text import let, trim_space
from tessera.operators.chunk import literal_map

# File extension to language.
LANGUAGE_BY_EXTENSION = {
    ".go": "go",
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".rs": "rust",
    ".rb": "ruby",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".md": "markdown",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".toml": "toml",
}

# Marker file to project type; the earlier marker wins.
PROJECT_MARKERS = {
    "go.mod": "go",
    "package.json": "node",
    "requirements.txt": "python",
    "pyproject.toml": "python",
    "setup.py": "python",
    "Cargo.toml": "rust",
    "pom.xml": "java",
    "build.gradle": "java",
    "Gemfile": "ruby",
}

# Version-control folders, in order of precedence.
VCS_MARKERS = {".git": "git", ".svn": "svn", ".hg": "hg"}

# Editor-settings folders.
IDE_MARKERS = (".vscode", ".idea")

UNKNOWN = "unknown"


def language_of(path: Column) -> Column:
    return F.coalesce(
        F.try_element_at(literal_map(LANGUAGE_BY_EXTENSION), extension(path)), F.lit(UNKNOWN)
    )


def with_language(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Add ``language``. The 20-entry map is a literal, so no join is planned."""
    return files.withColumn("language", language_of(F.col(path_col)))


def detect_projects(files: DataFrame) -> DataFrame:
    """One row per folder that holds a marker of any kind.

    Only marker rows reach the aggregation, and every aggregate is a primitive
    minimum or boolean: partial aggregation keeps even a huge folder to one
    row per task before the shuffle.
    """
    name = base_name(F.col("path"))
    markers = list(PROJECT_MARKERS)
    vcs = list(VCS_MARKERS)
    tagged = files.select(
        parent(F.col("path")).alias("project_path"), name.alias("name"), "is_dir"
    ).filter(
        F.col("name").isin(*markers)
        | (F.col("is_dir") & F.col("name").isin(*vcs, *IDE_MARKERS))
    )

    def rank(names: list[str]) -> Column:
        return F.try_element_at(
            F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)]), F.col("name")
        )

    ranks = tagged.groupBy("project_path").agg(
        F.min(rank(markers)).alias("marker_rank"),
        F.min(F.when(F.col("is_dir"), rank(vcs))).alias("vcs_rank"),
        F.max(F.col("is_dir") & F.col("name").isin(*IDE_MARKERS)).alias("has_ide_config"),
    )

    def pick(values, rank_col: str) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.col(rank_col))

    return ranks.select(
        "project_path",
        F.coalesce(pick(PROJECT_MARKERS.values(), "marker_rank"), F.lit(UNKNOWN)).alias("project_type"),
        pick(markers, "marker_rank").alias("marker"),
        F.col("vcs_rank").isNotNull().alias("has_vcs"),
        F.coalesce(pick(VCS_MARKERS.values(), "vcs_rank"), F.lit("")).alias("vcs_type"),
        "has_ide_config",
    )


def with_project(files: DataFrame, projects: DataFrame, path_col: str = "path") -> DataFrame:
    """Add ``project_path`` and ``project_type`` of the nearest enclosing project.

    The search runs over distinct folders, which are far fewer than files, and
    meets projects by equi-joins on ancestor folders; no prefix comparison
    between all pairs is ever made. Files join the folder result once.
    """
    folder = parent(F.col(path_col))
    typed = projects.filter(F.col("project_type") != UNKNOWN).select(
        F.col("project_path").alias("_ancestor"), F.col("project_type").alias("_type")
    )
    nearest = (
        files.select(folder.alias("_folder"))
        .distinct()
        .select("_folder", F.explode(prefixes(F.col("_folder"), True)).alias("_ancestor"))
        .join(typed, "_ancestor")
        .groupBy("_folder")
        .agg(
            F.max(F.struct(F.length("_ancestor").alias("n"), "_ancestor", "_type")).alias("_nearest")
        )
        .select(
            "_folder",
            F.col("_nearest._ancestor").alias("project_path"),
            F.col("_nearest._type").alias("project_type"),
        )
    )
    return (
        files.withColumn("_folder", folder)
        .join(nearest, "_folder", "left")
        .drop("_folder")
        .withColumn("project_path", F.coalesce("project_path", F.lit("")))
        .withColumn("project_type", F.coalesce("project_type", F.lit(UNKNOWN)))
    )


# --- manifests --------------------------------------------------------------

_DEPS = "array<struct<name:string,version:string>>"


def _dep(name: Column, version: Column) -> Column:
    return F.struct(name.alias("name"), version.alias("version"))


def module_requirements(content: Column) -> Column:
    """``require`` entries of a ``go.mod`` text, in order of appearance.

    One fold over the lines carries whether a block is open. The list grows
    only where a dependency is found.
    """
    state_type = f"struct<block:boolean,deps:{_DEPS}>"
    zero = F.struct(F.lit(False).alias("block"), F.array().cast(_DEPS).alias("deps")).cast(state_type)

    def step(state: Column, raw: Column) -> Column:
        def on_line(line: Column) -> Column:
            opens = F.startswith(line, F.lit("require ("))
            closes = state.block & (line == ")")
            fields = F.split(line, r"\p{IsWhite_Space}+", -1)
            n = F.size(fields)
            in_block = state.block & ~closes & (n >= 2)
            single = (
                F.startswith(line, F.lit("require ")) & ~F.contains(line, F.lit("(")) & ~closes & (n >= 3)
            )
            found = F.concat(
                F.when(in_block, F.array(_dep(fields[0], F.get(fields, F.lit(1))))).otherwise(F.array().cast(_DEPS)),
                F.when(single, F.array(_dep(F.get(fields, F.lit(1)), F.get(fields, F.lit(2))))).otherwise(
                    F.array().cast(_DEPS)
                ),
            )
            return F.struct(
                F.when(opens, True).when(closes, False).otherwise(state.block).alias("block"),
                F.when(opens | ~(in_block | single), state.deps)
                .otherwise(F.concat(state.deps, found))
                .alias("deps"),
            ).cast(state_type)

        return let(trim_space(raw), on_line)

    return F.aggregate(F.split(content, "\n", -1), zero, step, lambda s: s.deps)


def package_requirements(content: Column) -> Column:
    """Dependencies of a ``package.json`` text, development ones last.

    Strict as a whole: malformed JSON or one value that is neither a string nor
    null yields nothing. Key names of the two sections ignore case.
    """
    variants = "map<string,variant>"
    wrapped = F.try_parse_json(F.concat(F.lit("["), content, F.lit("]")))

    def is_object(v: Column) -> Column:
        return F.schema_of_variant(v).startswith("OBJECT")

    def is_null(v: Column) -> Column:
        return F.schema_of_variant(v) == "VOID"

    def section(doc: Column, name: str) -> Column:
        entries = F.filter(F.map_entries(doc), lambda e: (F.lower(e["key"]) == name) & ~is_null(e["value"]))
        return F.transform(entries, lambda e: e["value"])

    def strings(values: Column) -> Column:
        return F.flatten(
            F.transform(
                values,
                lambda v: F.transform(
                    F.map_entries(v.cast(variants)),
                    lambda e: _dep(e["key"], F.coalesce(F.when(~is_null(e["value"]), e["value"].cast("string")), F.lit(""))),
                ),
            )
        )

    def valid(values: Column) -> Column:
        return F.forall(
            values,
            lambda v: is_object(v)
            & F.when(
                is_object(v),
                F.forall(
                    F.map_values(v.cast(variants)),
                    lambda x: F.schema_of_variant(x).isin("STRING", "VOID"),
                ),
            ),
        )

    def of_document(doc: Column) -> Column:
        return let(
            F.concat(section(doc, "dependencies"), section(doc, "devdependencies")),
            lambda values: F.when(valid(values), strings(values)),
        )

    def of_list(items: Column) -> Column:
        return F.when(
            (F.size(items) == 1) & F.when(F.size(items) == 1, is_object(items[0])),
            let(items[0].cast(variants), of_document),
        )

    # In brackets, text behind the first value cannot go unnoticed.
    found = let(wrapped, lambda w: F.when(w.isNotNull(), let(w.cast("array<variant>"), of_list)))
    return F.coalesce(found, F.array().cast(_DEPS))


def dependencies(manifests: DataFrame) -> DataFrame:
    """``(project_path, marker, content)`` to ``(project_path, name, version)``.

    Takes one manifest per project, that of the marker that decided its type.
    A later entry of the same name replaces an earlier one. This is settled
    inside the row, where sorting brings equal names together, so nothing is
    exchanged.
    """
    # Of repeated keys the last counts; by default the parser refuses such a text.
    manifests.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    content = F.col("content").cast("string")
    deps = (
        F.when(F.col("marker") == "go.mod", module_requirements(content))
        .when(F.col("marker") == "package.json", package_requirements(content))
        .otherwise(F.array().cast(_DEPS))
    )

    def last_of_each_name(entries: Column) -> Column:
        ordered = F.array_sort(
            F.transform(
                entries,
                lambda d, i: F.struct(d["name"].alias("name"), i.alias("seq"), d["version"].alias("version")),
            )
        )
        return let(
            ordered,
            lambda s: F.filter(
                s, lambda d, i: F.coalesce(F.get(s, i + 1)["name"] != d["name"], F.lit(True))
            ),
        )

    return manifests.select(
        "project_path", F.explode(let(deps, last_of_each_name)).alias("dep")
    ).select("project_path", F.col("dep.name").alias("name"), F.col("dep.version").alias("version"))


def root_rollup(files: DataFrame, projects: DataFrame, deps: DataFrame) -> DataFrame:
    """Per-root summary: file count, languages, project type, dependencies.

    Languages are a set over a closed list of names, and the dependency map of
    a root comes from one manifest, so no aggregate buffer grows with the data.
    """
    counts = (
        with_language(files.filter(~F.col("is_dir")))
        .groupBy("root")
        .agg(
            F.count(F.lit(1)).cast("int").alias("file_count"),
            F.sort_array(
                F.collect_set(F.when(F.col("language") != UNKNOWN, F.col("language")))
            ).alias("languages"),
        )
    )
    types = projects.select(F.col("project_path").alias("root"), "project_type")
    maps = (
        deps.groupBy(F.col("project_path").alias("root"))
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "version")))).alias("dependencies"))
    )
    return (
        counts.join(types, "root", "left")
        .join(maps, "root", "left")
        .select(
            "root",
            "file_count",
            "languages",
            F.coalesce("project_type", F.lit(UNKNOWN)).alias("project_type"),
            F.coalesce("dependencies", F.create_map().cast("map<string,string>")).alias("dependencies"),
        )
    )
