"""Row filters over file listings."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import base_name, parent, prefixes
from tessera.functions.text import let
from tessera.schema import BINARY_PROBE_BYTES, METADATA_FILE_NAME, SKIP_GLOBS


def drop_hidden(files: DataFrame) -> DataFrame:
    """Drop everything below a folder whose name begins with a dot.

    Hidden files themselves stay; only folders below the root count.
    """
    return files.filter(~F.rlike("rel_path", F.lit(r"(?s)(^|/)\.[^/]*/")))


def looks_binary(content: Column) -> Column:
    """A NUL among the first bytes."""
    head = F.substring(content, 1, BINARY_PROBE_BYTES)
    return F.position(F.unhex(F.lit("00")), head) > 0


def drop_binary(files: DataFrame) -> DataFrame:
    return files.filter(~looks_binary(F.col("content")))


def glob_regex(globs: Iterable[str]) -> str:
    """One anchored pattern for a list of file-name globs."""

    def one(glob: str) -> str:
        out = []
        for token in re.findall(r"\[!?[^\]]+\]|.", glob):
            if token == "*":
                out.append("[^/]*")
            elif token == "?":
                out.append("[^/]")
            elif token.startswith("[") and len(token) > 1:
                out.append("[^" + token[2:] if token[1] == "!" else token)
            else:
                out.append(re.escape(token))
        return "".join(out)

    return "^(?:" + "|".join(one(g.strip()) for g in globs if g.strip()) + ")$"


def flag_skipped(files: DataFrame, globs: Iterable[str] = SKIP_GLOBS) -> DataFrame:
    """Add ``should_skip``: the file name matches one of the secret-file globs."""
    globs = [g for g in globs if g.strip()]
    verdict = F.rlike(base_name(F.col("path")), F.lit(glob_regex(globs))) if globs else F.lit(False)
    return files.withColumn("should_skip", verdict)


def drop_metadata_file(files: DataFrame, name: str = METADATA_FILE_NAME) -> DataFrame:
    return files.filter(base_name(F.col("path")) != name)


# --- ignore files -----------------------------------------------------------


def _rule(line: Column) -> Column:
    """One line of an ignore file as ``(regex, dir_only, negate)``; null if none."""
    text = F.regexp_replace(F.regexp_replace(line, r"\r$", ""), r"(?<!\\) +$", "")

    def parsed(text: Column) -> Column:
        negate = F.startswith(text, F.lit("!"))
        body = F.when(negate, F.substr(text, F.lit(2))).otherwise(text)
        dir_only = F.endswith(body, F.lit("/"))
        bare = F.regexp_replace(body, r"/$", "")
        anchored = F.contains(bare, F.lit("/"))
        glob = F.regexp_replace(bare, r"^/", "")
        # Runs of stars mean "any depth" only as a whole path part.
        glob = F.regexp_replace(glob, r"(?<=[^/*])\*{2,}|\*{2,}(?=[^/*])", "*")
        parts = F.regexp_extract_all(
            glob, F.lit(r"(\\.|\*\*/|\*+|\?|\[!?[^\]]+\]|[^\\*?\[]+|.)"), F.lit(1)
        )
        regex = F.array_join(F.transform(parts, _glob_part), "")
        return F.when(
            (text != "") & ~F.startswith(text, F.lit("#")) & (bare != ""),
            F.struct(
                F.concat(F.when(anchored, F.lit("^")).otherwise(F.lit("^(?:.*/)?")), regex, F.lit("$")).alias("regex"),
                dir_only.alias("dir_only"),
                negate.alias("negate"),
            ),
        )

    return let(text, parsed)


def _glob_part(part: Column) -> Column:
    def quoted(text: Column) -> Column:
        return F.regexp_replace(text, r"([.+^$(){}|\[\]\\*?&~#-])", r"\\$1")

    char_class = F.concat(
        F.lit("(?!/)["),
        F.regexp_replace(
            F.regexp_replace(F.substr(part, F.lit(2)), r"^!", "^"), r"([\\\[&~])", r"\\$1"
        ),
    )
    return (
        F.when(part == "**/", F.lit("(?:[^/]+/)*"))
        .when(part == "**", F.lit(".+"))
        .when(part == "*", F.lit("[^/]*"))
        .when(part == "?", F.lit("[^/]"))
        .when(F.startswith(part, F.lit("[")) & (F.length(part) > 1), char_class)
        .when(F.startswith(part, F.lit("\\")) & (F.length(part) == 2), quoted(F.substr(part, F.lit(2))))
        .otherwise(quoted(part))
    )


def ignore_rulesets(ignore_files: DataFrame) -> DataFrame:
    """``(root, rel_path, content)`` of ignore files to one row of rules each.

    A ruleset is parsed inside its own row, so rules never need grouping.
    """
    lines = F.split(F.col("content").cast("string"), "\n", -1)
    rules = F.filter(F.transform(lines, _rule), lambda r: r.isNotNull())
    return (
        ignore_files.select("root", parent(F.col("rel_path")).alias("rule_dir"), rules.alias("rules"))
        .filter(F.size("rules") > 0)
    )


def _ignored_by(rules: Column, rule_dir: Column, rel_path: Column, is_dir: Column) -> Column:
    """Any part of the path below ``rule_dir`` is ignored; the last match decides.

    Rules are the outer loop, so a pattern is compiled once per path and not
    once per part of it.
    """
    below = F.filter(prefixes(rel_path, include_self=True), lambda p: F.length(p) > F.length(rule_dir))

    def verdicts(parts: Column) -> Column:
        return F.aggregate(
            rules,
            F.transform(parts, lambda _: F.lit(False)),
            lambda acc, r: F.zip_with(
                acc,
                parts,
                lambda ignored, part: F.when(
                    (~r.dir_only | (part != rel_path) | is_dir) & F.rlike(part, r.regex), ~r.negate
                ).otherwise(ignored),
            ),
        )

    return F.exists(let(below, verdicts), lambda ignored: ignored)


def active_rulesets(folders: DataFrame, rulesets: DataFrame) -> DataFrame:
    """``(root, folder, active)``: the rulesets in force in each folder, outermost first.

    ``folders`` are distinct ``(root, folder)`` rows; folders without rules are left out.
    """
    above = folders.select("root", "folder", F.explode(prefixes(F.col("folder"), True)).alias("rule_dir"))
    ruleset = F.struct(F.length("rule_dir").alias("depth"), "rule_dir", "rules")
    return (
        above.join(rulesets, ["root", "rule_dir"])
        .groupBy("root", "folder")
        .agg(F.sort_array(F.collect_list(ruleset)).alias("active"))
    )


def drop_ignored(files: DataFrame, rulesets: DataFrame) -> DataFrame:
    """Apply ignore files: each is active in its own folder and below.

    Rules are composed once per folder; a file then meets them by one equi-join on its
    folder and is tested in its own row. Paths are tested relative to the listing's
    root, whichever folder the rule came from.
    """
    placed = files.withColumn("_folder", parent(F.col("rel_path")))
    active = active_rulesets(placed.select("root", F.col("_folder").alias("folder")).distinct(), rulesets)
    ignored = F.exists(
        "active", lambda s: _ignored_by(s["rules"], s["rule_dir"], F.col("rel_path"), F.col("is_dir"))
    )
    return (
        placed.join(active.withColumnRenamed("folder", "_folder"), ["root", "_folder"], "left")
        .filter(F.col("active").isNull() | ~ignored)
        .select(*files.columns)
    )
