"""Run registered queries beside their SQL and compare row multisets.

``python tests/compare.py [scale] [name-prefix ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


_KINDS = {
    "int": ("INTEGER", "NUMBER"),
    "bigint": ("BIGINT", "NUMBER"),
    "double": ("DOUBLE", "NUMBER"),
    "boolean": ("BOOLEAN", "BOOL"),
    "string": ("VARCHAR", "STRING"),
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def compare(spark, con, sf_dir: str, run, sql: str | None):
    """``(ok, message)``; without SQL only that the query runs and has rows."""
    started = time.time()
    df = run(spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(_plain(r[c]) for c in columns) for r in df.collect()]
    spark_time = time.time() - started
    if sql is None:
        return len(got) > 0, f"{len(got)} rows, no SQL, {spark_time:.1f}s"
    started = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in sorted(names)]
    want = [tuple(_plain(r[i]) for i in order) for r in result.fetchall()]
    sql_time = time.time() - started
    if sorted(names) != columns:
        return False, f"columns {columns} vs {sorted(names)}"
    kinds = {d[0]: str(d[1]).upper() for d in result.description}
    for field in df.schema.fields:
        wanted = _KINDS.get(field.dataType.simpleString())
        if wanted and kinds[field.name] not in wanted:
            return False, f"{field.name} is {field.dataType.simpleString()}, SQL gives {kinds[field.name]}"
    a, b = Counter(got), Counter(want)
    if a != b:
        extra, absent = list((a - b).items())[:2], list((b - a).items())[:2]
        return False, f"{len(got)} vs {len(want)} rows; extra {str(extra)[:700]}; absent {str(absent)[:700]}"
    return len(got) > 0, f"{len(got)} rows, {spark_time:.1f}s, sql {sql_time:.1f}s"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    from tessera.session import local_session

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{scale}"
    spark, con, sqls, bad = local_session(8), connect(sf_dir), oracle_sql(), 0
    for name, run in queries().items():
        if sys.argv[2:] and not name.startswith(tuple(sys.argv[2:])):
            continue
        try:
            ok, message = compare(spark, con, sf_dir, run, sqls.get(name))
        except Exception as problem:  # report and go on
            ok, message = False, f"{type(problem).__name__}: {str(problem)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, message, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
