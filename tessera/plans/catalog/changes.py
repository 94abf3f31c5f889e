"""Change-detection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.change import (
    changed_folders,
    changed_roots,
    diff_files,
    directory_hash,
    folder_digests,
    with_change_flag,
)
from tessera.plans.catalog.shapes import epoch_nanos, table


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files: the customer is the root, the date the modification time."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("/c"), F.col("o_custkey").cast("string")).alias("root"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("rel_path"),
        F.concat(F.lit("/c"), F.col("o_custkey").cast("string"), F.lit("/o"), F.col("o_orderkey").cast("string")).alias("path"),
        epoch_nanos(F.col("o_orderdate")).alias("mod_time_ns"),
        F.lit(False).alias("is_dir"),
        F.col("o_orderstatus").alias("state"),
        F.col("o_orderpriority").alias("priority"),
    )


ENTRY_SQL = "'o' || o_orderkey::VARCHAR || ':' || (epoch_us(o_orderdate) * 1000)::VARCHAR"
HASH_SQL = f"""
SELECT '/c' || o_custkey::VARCHAR AS root, sha256(string_agg({ENTRY_SQL}, '' ORDER BY {ENTRY_SQL})) AS content_hash
FROM orders WHERE {{where}} GROUP BY o_custkey"""


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("/c"), F.col("c_custkey").cast("string")).alias("root")
    )


def _hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory_hash(order_files(spark, sf_dir), _roots(spark, sf_dir))


def _hash_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event users as roots, every one of them over the collecting bound."""
    files = table(spark, sf_dir, "events").select(
        F.concat(F.lit("/u"), F.col("user_id").cast("string")).alias("root"),
        F.concat(F.col("event_type"), F.lit("/e"), F.col("event_id").cast("string")).alias("rel_path"),
        F.concat(F.lit("/"), F.col("event_id").cast("string")).alias("path"),
        epoch_nanos(F.col("ts")).alias("mod_time_ns"),
        F.lit(False).alias("is_dir"),
    )
    return directory_hash(files)


def stored_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes taken when partly delivered orders did not exist yet."""
    return directory_hash(order_files(spark, sf_dir).filter(F.col("state") != "P"))


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed_roots(directory_hash(order_files(spark, sf_dir)), stored_metadata(spark, sf_dir))


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = with_change_flag(
        directory_hash(order_files(spark, sf_dir), _roots(spark, sf_dir)), stored_metadata(spark, sf_dir)
    )
    return flags.select("root", "has_changed")


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = order_files(spark, sf_dir)
    later = F.when(F.col("priority") == "1-URGENT", F.col("mod_time_ns") + 1).otherwise(F.col("mod_time_ns"))
    return diff_files(
        files.filter(F.col("state") != "P"),
        files.filter(F.col("state") != "O").withColumn("mod_time_ns", later),
    )


def _nested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files three folders deep: customer, status, priority."""
    files = order_files(spark, sf_dir)
    path = F.concat_ws("/", F.replace("root", F.lit("/"), F.lit("")), "state", "priority", "rel_path")
    return files.withColumns({"root": F.lit("/orders"), "rel_path": path})


def _digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folder_digests(_nested_files(spark, sf_dir))


def _subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that differ between two states of the tree: orders dropped, orders touched."""
    files = _nested_files(spark, sf_dir)
    later = F.when(F.col("mod_time_ns") % 7 == 0, F.col("mod_time_ns") + 1).otherwise(F.col("mod_time_ns"))
    now = files.filter(F.col("priority") != "5-LOW").withColumn("mod_time_ns", later)
    return changed_folders(folder_digests(now), folder_digests(files))


def _digest_ctes(name: str, files: str) -> str:
    """CTEs ending in ``<name>(folder, depth, digest)`` for ``files(c, state, priority, entry)``."""
    def level(above: str, folder: str, name_of: str, source: str) -> str:
        return f"SELECT {above}, sha256(string_agg(e, '' ORDER BY e)) AS digest FROM (SELECT {folder}, {name_of} AS e FROM {source}) GROUP BY ALL"

    return f"""
{name}_3 AS ({level("c, state, priority", "c, state, priority", "entry", f"({files})")}),
{name}_2 AS ({level("c, state", "c, state", "priority || '/:' || digest", f"{name}_3")}),
{name}_1 AS ({level("c", "c", "state || '/:' || digest", f"{name}_2")}),
{name}_0 AS (SELECT sha256(string_agg(e, '' ORDER BY e)) AS digest FROM (SELECT c || '/:' || digest AS e FROM {name}_1)),
{name} AS (
  SELECT c || '/' || state || '/' || priority AS folder, 3 AS depth, digest FROM {name}_3
  UNION ALL SELECT c || '/' || state, 2, digest FROM {name}_2
  UNION ALL SELECT c, 1, digest FROM {name}_1
  UNION ALL SELECT '', 0, digest FROM {name}_0)"""


_NESTED = "SELECT 'c' || o_custkey::VARCHAR AS c, o_orderstatus AS state, o_orderpriority AS priority, {entry} AS entry FROM orders WHERE {where}"
_NANOS = "epoch_us(o_orderdate) * 1000"
_TOUCHED = f"'o' || o_orderkey::VARCHAR || ':' || ({_NANOS} + CASE WHEN {_NANOS} % 7 = 0 THEN 1 ELSE 0 END)::VARCHAR"

QUERIES = {
    "h01_directory_hash": _hash,
    "h01_directory_hash_streamed": _hash_streamed,
    "h02_has_changed": _flags,
    "h04_folder_digests": _digests,
    "h05_changed_subtrees": _subtrees,
    "h03_file_diff": _diff,
    "f07_changed_roots": _changed,
}

_STORED = HASH_SQL.format(where="o_orderstatus <> 'P'")
_CURRENT = HASH_SQL.format(where="TRUE")

SQL = {
    "h01_directory_hash": f"""
SELECT '/c' || c_custkey::VARCHAR AS root, coalesce(content_hash, sha256('')) AS content_hash
FROM customer LEFT JOIN ({_CURRENT}) h ON h.root = '/c' || c_custkey::VARCHAR""",
    "h01_directory_hash_streamed": """
SELECT '/u' || user_id::VARCHAR AS root, sha256(string_agg(e, '' ORDER BY e)) AS content_hash
FROM (SELECT user_id, event_type || '/e' || event_id::VARCHAR || ':' || (epoch_us(ts) * 1000)::VARCHAR AS e FROM events)
GROUP BY user_id""",
    "h04_folder_digests": f"""
WITH {_digest_ctes('d', _NESTED.format(entry=ENTRY_SQL, where='TRUE'))}
SELECT '/orders' AS root, folder, depth::INTEGER AS depth, digest FROM d""",
    "h05_changed_subtrees": f"""
WITH {_digest_ctes('b', _NESTED.format(entry=ENTRY_SQL, where='TRUE'))},
{_digest_ctes('n', _NESTED.format(entry=_TOUCHED, where="o_orderpriority <> '5-LOW'"))}
SELECT '/orders' AS root, folder, CASE WHEN b.digest IS NULL THEN 'added' WHEN n.digest IS NULL THEN 'deleted' ELSE 'changed' END AS change
FROM n FULL JOIN b USING (folder) WHERE n.digest IS DISTINCT FROM b.digest""",
    "h02_has_changed": f"""
SELECT '/c' || c_custkey::VARCHAR AS root, coalesce(s.content_hash, '') <> coalesce(h.content_hash, sha256('')) AS has_changed
FROM customer LEFT JOIN ({_CURRENT}) h ON h.root = '/c' || c_custkey::VARCHAR
LEFT JOIN ({_STORED}) s ON s.root = '/c' || c_custkey::VARCHAR""",
    "h03_file_diff": """
SELECT '/c' || o_custkey::VARCHAR || '/o' || o_orderkey::VARCHAR AS path,
       CASE WHEN o_orderstatus = 'P' THEN 'added' WHEN o_orderstatus = 'O' THEN 'deleted' ELSE 'modified' END AS change
FROM orders WHERE o_orderstatus IN ('P', 'O') OR o_orderpriority = '1-URGENT'""",
    "f07_changed_roots": f"""
SELECT h.root, h.content_hash FROM ({_CURRENT}) h LEFT JOIN ({_STORED}) s ON s.root = h.root
WHERE coalesce(s.content_hash, '') <> h.content_hash""",
}
