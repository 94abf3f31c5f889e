"""Mixing sources to target weights by temperature, in DataFrame functions only.

A source with share p of all tokens gets the weight p^a / sum(p^a). The exponent a in
[0, 1] (0: all sources alike, 1: as they are) is found by section search: the wanted
quantity is monotone in a, every pass evaluates ``SECTIONS`` exponents in one
aggregate over the sources. The target is either an entropy of the weights (nats, the
largest a that reaches it) or a limit on repetition (the smallest a at which no source
is shown more often than ``limit`` times).

A source's budget of tokens is realised in whole passes over its documents and a last
partial one. Its documents are dealt to blocks by a hash; blocks are visited in a
permuted order, within a block documents go by their hash; the partial pass ends with
the document that reaches the budget. Running sums therefore need one row per block,
and the documents of one block per source, however large a source is. A cut is a
place in that order, so documents find out by themselves how often they are shown.

Defined results: tokens are runs of other than ASCII white space; null texts are empty;
a null source is a source of its own; documents without tokens, and those of
sources without tokens, cost nothing and are shown once; repeated rows have one
place in the order and are shown alike; with no tokens at all every row is shown
once; an empty table gives no rows. Other columns may have any names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import persist_table, read_table, text_or_empty

BLOCK_TOKENS = 1 << 20
SECTIONS, PASSES = 32, 7
LIMIT = 2.0
SEED = "mix"
_HASHES = 1 << 32


def _hash(*parts: Column) -> Column:
    """32-bit hash of a text made of ``parts``; any SQL engine with md5 can compute it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *parts)), 1, 8), 16, 10).cast("long")


def _source_key(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("s:"), F.col(name).cast("string")), F.lit("n:"))


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _place(row: dict[str, Column]) -> dict[str, Column]:
    """Where a document stands: block, the block's rank, and its hash within the block."""
    block = F.floor(row["hash"] * row["blocks"] / _HASHES)
    return {"block": block, "rank": _hash(row["key"], block.cast("string"))}


def temperature(
    sources: DataFrame, limit: float | None = None, entropy: float | None = None, budget: float | None = None
) -> tuple[float, float]:
    """``(exponent, budget)`` for sources with ``tokens``; without a budget the smallest that shows all once."""
    total = sources.agg(F.sum("tokens").alias("t"), F.max("tokens").alias("m"), F.min("tokens").alias("l")).first()
    if not total["t"]:
        return 1.0, 0.0
    share = F.col("tokens") / F.lit(float(total["t"]))

    def sums(a: float) -> list[Column]:
        power = F.pow(share, F.lit(a))
        return [F.sum(power), F.sum(power * F.log(share))]

    def good(a: float, z: float, slope: float) -> bool:
        """True for exponents at or above the limit's, or at or below the entropy's."""
        if entropy is not None:
            return math.log(z) - a * slope / z >= entropy
        p, q = total["l"] / total["t"], total["m"] / total["t"]
        size = budget if budget is not None else total["t"] * z * q ** (1 - a)
        return size * p**a / z / total["l"] <= limit

    low, high = 0.0, 1.0
    for _ in range(PASSES):
        tried = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
        row = sources.agg(*[c for a in tried for c in sums(a)]).first()
        ok = [good(a, row[2 * k], row[2 * k + 1]) for k, a in enumerate(tried)]
        if entropy is not None:  # weights grow more alike as the exponent falls
            k = max([i for i, x in enumerate(ok) if x], default=0)
            low, high = tried[k], tried[min(k + 1, SECTIONS)]
        else:
            k = min([i for i, x in enumerate(ok) if x], default=SECTIONS)
            low, high = tried[max(k - 1, 0)], tried[k]
    a = round(low if entropy is not None else high, 9)
    z = sources.agg(F.sum(F.pow(share, F.lit(a)))).first()[0]
    return a, float(budget if budget is not None else total["t"] * z * (total["m"] / total["t"]) ** (1 - a))


def plan_sources(rows: DataFrame, **target: float) -> DataFrame:
    """Per source with tokens: weight, budget, whole passes and the cut of the partial one.

    ``rows`` has ``key, id, tokens``; the result has a row per source.
    """
    sources = persist_table(
        rows.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")).where("tokens > 0"),
        "mixing-sources",
    )
    a, budget = temperature(sources, **target)
    total = sources.agg(F.sum("tokens").alias("all_tokens")).first()["all_tokens"] or 1
    power = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a))
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    shown = F.round(power / F.lit(z) * F.lit(budget) / F.col("tokens"), 9)
    planned = sources.select(
        "key",
        "tokens",
        "documents",
        F.round(power / F.lit(z), 9).alias("weight"),
        F.floor(shown).alias("passes"),
        F.floor((shown - F.floor(shown)) * F.col("tokens")).alias("rest"),
        F.ceil(F.col("tokens") / BLOCK_TOKENS).alias("blocks"),
    )
    placed = rows.where("tokens > 0").join(planned.select("key", "rest", "blocks").where("rest > 0"), "key")
    placed = placed.withColumn("hash", _hash(F.col("id")))
    placed = placed.withColumns(_place({c: F.col(c) for c in ("key", "hash", "blocks")}))
    sums = placed.groupBy("key", "rest", "block", "rank").agg(F.sum("tokens").alias("tokens"))
    so_far = F.sum("tokens").over(Window.partitionBy("key").orderBy("rank", "block"))
    cross = (
        sums.withColumn("end", so_far)
        .where("end >= rest AND end - tokens < rest")
        .select("key", "block", F.col("rank").alias("cut_rank"), (F.col("rest") - F.col("end") + F.col("tokens")).alias("left"))
    )
    # of the block that the budget ends in, documents up to the one that reaches it
    inside = placed.select("key", "block", "hash", "id", "tokens").join(cross, ["key", "block"])
    inside = inside.groupBy("key", "block", "cut_rank", "left", "hash", "id").agg(F.sum("tokens").alias("tokens"))
    run = F.sum("tokens").over(Window.partitionBy("key").orderBy("hash", "id"))
    cut = (
        inside.withColumn("end", run)
        .where(F.col("end") - F.col("tokens") < F.col("left"))
        .groupBy("key")
        .agg(F.max(F.struct("cut_rank", "block", "hash", "id")).alias("cut"))
    )
    return persist_table(planned.join(cut, "key", "left"), "mixing-plan")


def copies_of(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (``key, id, tokens`` and others) with ``weight`` of their source and ``copies``, how often each is shown."""
    held = rows.join(plan.select("key", "weight", "passes", "blocks", "cut"), "key", "left")
    held = held.withColumn("hash", _hash(F.col("id")))
    held = held.withColumns(_place({c: F.col(c) for c in ("key", "hash", "blocks")}))
    here = F.struct(F.col("rank").alias("cut_rank"), F.col("block"), F.col("hash"), F.col("id"))
    partial = F.coalesce((here <= F.col("cut")).cast("long"), F.lit(0).cast("long"))
    costs = (F.col("tokens") > 0) & F.col("passes").isNotNull()
    copies = F.when(costs, F.col("passes") + partial).otherwise(F.lit(1).cast("long"))
    return held.select(
        *rows.columns, F.coalesce("weight", F.lit(0.0)).alias("weight"), copies.alias("copies"), "rank", "hash"
    )


def _rows(docs: DataFrame, id_col: str, text: Column, source_col: str, *keep: Column) -> DataFrame:
    identity = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return docs.select(_source_key(source_col).alias("key"), identity.alias("id"), count_tokens(text).alias("tokens"), *keep)


def mixed(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """All rows of ``docs``, each as often as the mixture shows it and at least once.

    The budget is the smallest that shows every document; no source is shown more
    than ``limit`` times. Rows come in no order; ``copies_of`` has each one's place.
    """
    held = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"))
    rows = _rows(held, "mix_id", text_or_empty("doc.text"), "mix_source", F.col("doc"))
    plan = plan_sources(persist_table(rows.select("key", "id", "tokens"), "mixing-rows"), limit=limit)
    shown = copies_of(rows, plan).select("doc", "copies")
    return shown.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies per document when the corpus' own number of tokens is dealt out, no source shown over twice."""
    docs = read_table(spark, sf_dir, "documents")
    rows = persist_table(_rows(docs, "doc_id", text_or_empty(), "source", F.col("doc_id"), F.col("source")), "mixing-rows")
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    plan = plan_sources(rows.select("key", "id", "tokens"), limit=LIMIT, budget=float(total))
    return copies_of(rows, plan).select(
        "doc_id", "source", F.col("tokens").alias("n_tokens"), "weight", "copies", F.col("rank").alias("block_rank"), "hash"
    )
