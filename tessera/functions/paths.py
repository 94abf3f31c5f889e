"""Column helpers for slash-separated paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def extension(path: Column) -> Column:
    """Suffix from the last dot of the base name, lower-cased; empty if none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def parent(path: Column) -> Column:
    """Folder of a path; empty for a bare name."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def prefixes(path: Column, include_self: bool) -> Column:
    """All leading parts of a relative path, from ``''`` downwards.

    ``a/b/c`` gives ``['', 'a', 'a/b']`` and, with ``include_self``, ``a/b/c``.
    """
    parts = F.split(path, "/", -1)
    n = F.when(path == "", F.lit(0)).otherwise(F.size(parts))
    top = n if include_self else F.greatest(n - 1, F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), top), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )
