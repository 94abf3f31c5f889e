"""Registered queries over the benchmark tables, each with its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    from tessera.plans.catalog import changes, chunking, detection, filters, index, jobs, search

    out: dict[str, Query] = {}
    for module in (filters, detection, chunking, changes, index, search, jobs):
        out.update(module.QUERIES)
    return out


def all_sql() -> dict[str, str]:
    from tessera.plans.catalog import changes, chunking, detection, filters, index, jobs, search

    out: dict[str, str] = {}
    for module in (filters, detection, chunking, changes, index, search, jobs):
        out.update(module.SQL)
    return out
