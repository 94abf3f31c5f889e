"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import persist_table

MOST_ROUNDS = 60


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node, root`` for every node of ``edges`` (long ``a``, ``b``); root is the smallest id reachable.

    Alternates two rewritings of the edges, each moving neighbours to the smallest
    id around a node, until only stars are left; the number of rounds grows with the
    logarithm of the longest chain. Each round is written to the shared folder, so a
    lost executor repeats one round at most. Aggregates combine before the shuffle
    and the joins are plain equi-joins, so a hub's rows may be split over tasks.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = persist_table(edges.distinct(), label)
    before = None
    for _ in range(MOST_ROUNDS):
        # larger neighbours of a node move to the smallest id around it
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # and smaller ones, with the node itself, to the smallest of them
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = persist_table(
            moved.unionByName(small.withColumnRenamed("m", "b")).where("a <> b").distinct(), label
        )
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (now["n"], now["s"]) == before:
            break
        before = (now["n"], now["s"])
    else:
        raise RuntimeError(f"no stable components after {MOST_ROUNDS} rounds")
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
