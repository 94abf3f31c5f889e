"""Secret detection and redaction.

A rule names its type, the words without which it cannot match, and a pattern
with three groups: text in front that stays, the secret, and text behind that
stays. Patterns never cross a line end. Looking for the words first spares
nearly all documents the pattern, which is far slower than a substring search.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import let, lines_of
from tessera.schema import REDACTION


class Rule(NamedTuple):
    kind: str
    words: tuple[str, ...]
    pattern: str


# Public token formats. Words are in lower case.
RULES = (
    Rule(
        "assigned-secret",
        ("token", "secret", "passw", "api_key", "api-key", "apikey"),
        r"""(?i)((?:token|secret|password|passwd|api[_-]?key)["']?[ \t]*(?::=|[:=])[ \t]*["'])"""
        r"""([0-9a-z_.=+/-]{8,})(["'])""",
    ),
    Rule("cloud-access-key", ("akia", "asia"), r"(\b)((?:AKIA|ASIA)[0-9A-Z]{16})(\b)"),
    Rule("hosting-token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"(\b)(gh[pousr]_[0-9A-Za-z]{36,})(\b)"),
    Rule("private-key", ("private key",), r"()(-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----)()"),
)

# The lines of a private key after its header, up to and including its end.
_KEY_BODY = (
    r"(?:-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"
    r"|(?!\A)\G(?<!END [A-Z ]{0,40}PRIVATE KEY-----)(\r?\n)"
    r"(?:[0-9A-Za-z+/=]+|-----END (?:[A-Z]+ )*PRIVATE KEY-----|(?:Proc-Type|DEK-Info):[^\n]*|)"
    r"(?=\r?\n|\z))"
)

_OPEN = "\x01\x03"
_CLOSE = "\x01\x04"


def _may_match(text: Column, rules: Sequence[Rule]) -> Column:
    words = sorted({w for rule in rules for w in rule.words})

    def any_word(lowered: Column) -> Column:
        verdict = F.lit(False)
        for word in words:
            verdict = verdict | F.contains(lowered, F.lit(word))
        return verdict

    return let(F.lower(text), any_word)


def _without_marks(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_CLOSE), F.lit("")), F.lit("\x01\x02"), F.lit("\x01"))


def _findings(line: Column, rule: Rule) -> Column:
    """All matches of a rule in a line, with their columns."""
    escaped = F.replace(line, F.lit("\x01"), F.lit("\x01\x02"))
    marked = F.regexp_replace(escaped, rule.pattern, f"$1{_OPEN}$2{_CLOSE}$3")

    def found(parts: Column) -> Column:
        numbers = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(
            numbers,
            lambda k: F.struct(
                (F.length(_without_marks(F.array_join(F.slice(parts, F.lit(1), k), ""))) + 1).alias("col"),
                _without_marks(F.substring_index(parts[k], _CLOSE, 1)).alias("match"),
                F.lit(rule.kind).alias("type"),
            ),
        )

    return let(F.split(marked, _OPEN, -1), found)


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``(path, content)`` to one row per finding, columns 1-based in characters.

    Rules are a fixed list and become part of the expression; there is no join.
    Documents and then lines without any of the rules' words are dropped first.
    """
    lines = (
        docs.filter(_may_match(F.col("content"), rules))
        .select(F.col("path").alias("file_path"), F.posexplode(lines_of(F.col("content"))).alias("n", "text"))
        .filter(_may_match(F.col("text"), rules))
    )
    findings = F.concat(*[_findings(F.col("text"), rule) for rule in rules])
    return lines.select("file_path", (F.col("n") + 1).alias("line"), F.explode(findings).alias("f")).select(
        "file_path", "line", "f.col", "f.match", "f.type"
    )


def redacted(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    def apply(rule: Rule, t: Column) -> Column:
        if rule.kind == "private-key":
            return F.regexp_replace(t, _KEY_BODY, f"$1{REDACTION}")
        return F.regexp_replace(t, rule.pattern, f"$1{REDACTION}$3")

    def all_rules(t: Column) -> Column:
        for rule in rules:
            t = apply(rule, t)
        return t

    return F.when(_may_match(text, rules), all_rules(text)).otherwise(text)


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Replace every secret in ``content``; line numbers do not change."""
    return docs.withColumn("content", redacted(F.col("content"), rules))
