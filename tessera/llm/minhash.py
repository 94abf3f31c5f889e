"""Near-duplicate documents by b-bit MinHash.

1. Every text becomes its set of word shingles, a set fingerprint, ``bands`` hashes
   of ``ROWS`` minima each, and the low four bits of all minima, packed.
2. Texts of equal sets are one class, represented by its smallest id.
3. Representatives that share a band hash are candidates of each other. A bucket is
   linked to its smallest member only, and connected buckets are a family: whatever
   may be linked is in one family.
4. A family is cut into chunks of bounded size; a task gets two chunks, compares
   packed signatures by bit counts, corrects for chance agreement of the kept bits,
   and confirms on the full sets what the estimate leaves possible. It emits a
   spanning forest of the links, so a family of n gives at most n rows per task.
5. Components of the confirmed links, taken back to all members of each class.

A link of similarity at the threshold is missed by all bands with probability
1e-6 at most; the estimate may err by six standard deviations before a link is lost.

Defined results: null texts, and texts without words, have an empty set and are
linked with nothing; a text with fewer words than a shingle is one shingle; equal
sets are linked; a document is known by its id, so rows with the same id are
one document, reachable from each other; a row with a null id is linked with nothing,
has a null component and is kept; an empty table gives no rows. Other columns are
not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import persist_table, read_table, slices_of, spread_rows, text_or_empty
from tessera.llm.graph import components
from tessera.llm.shingles import mix, shingle_sets

ROWS = 6
MISS = 1e-6
BITS = 4
CHUNK_SHINGLES = 1_000_000
SLICE_CHARS = 1 << 19
_U = np.uint64


def band_count(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Fewest bands that overlook a pair at the threshold with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def _minima(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """Minimum of each hash function (row) over each non-empty set (column)."""
    seeds = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 32, (hashes, 2), dtype=np.uint64)
    flat = (np.concatenate(sets) >> _U(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((hashes, len(sets)), np.uint32)
    for k, (a, b) in enumerate(seeds.astype(np.uint32)):
        out[k] = np.minimum.reduceat(flat * (a | np.uint32(1)) + b, starts)
    return out


def _bands(minima: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash per band (row) and set (column)."""
    out = np.empty((len(minima) // rows, minima.shape[1]), np.uint64)
    for band in range(len(out)):
        value = np.full(minima.shape[1], band, np.uint64)
        for k in range(rows):
            value = mix(value * _U(0x100000001B3) + minima[band * rows + k])
        out[band] = value
    return out


def _packed(minima: np.ndarray) -> np.ndarray:
    """Low four bits of all minima of a set as one row of bytes, a multiple of eight long."""
    low = (minima & ((1 << BITS) - 1)).astype(np.uint8).T
    low = np.pad(low, ((0, 0), (0, -low.shape[1] % 16)))
    return np.ascontiguousarray(low[:, ::2] << 4 | low[:, 1::2])


def estimates(one: np.ndarray, many: np.ndarray, hashes: int) -> np.ndarray:
    """Collision-corrected similarity of a packed signature to each row of others (64-bit words)."""
    differ = one ^ many
    differ |= differ >> _U(1)
    differ |= differ >> _U(2)
    unequal = np.bitwise_count(differ & _U(0x1111111111111111)).sum(axis=1)
    chance = 2.0**-BITS
    return (1 - unequal / hashes - chance) / (1 - chance)


def _profile(docs: DataFrame, width: int, bands: int) -> DataFrame:
    """Per row: id, set size, set fingerprint, band hashes, packed low bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"]
            for a, b in slices_of(texts.str.len(), SLICE_CHARS):
                sets = shingle_sets([t.encode("utf-8", "replace") for t in texts[a:b]], width)
                full = [i for i, s in enumerate(sets) if len(s)]
                blank = np.zeros(0, np.int64)
                hashed, packed = [blank] * (b - a), [b""] * (b - a)
                prints = np.zeros((b - a, 2), np.uint64)
                if full:
                    minima = _minima([sets[i] for i in full], bands * ROWS)
                    keys, signs = _bands(minima, ROWS).T.astype(np.int64), _packed(minima)
                    for k, i in enumerate(full):
                        hashed[i], packed[i] = keys[k], signs[k].tobytes()
                        prints[i] = mix(sets[i]).sum(), mix(sets[i] ^ _U(0x5555555555555555)).sum()
                yield pd.DataFrame(
                    {
                        "id": batch["id"][a:b].array,
                        "n": [len(s) for s in sets],
                        "print_a": prints[:, 0].astype(np.int64),
                        "print_b": prints[:, 1].astype(np.int64),
                        "bands": hashed,
                        "signature": packed,
                    }
                )

    kind = "id long, n long, print_a long, print_b long, bands array<long>, signature binary"
    return docs.mapInPandas(run, kind)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """``id, shingles`` (sorted 64-bit integers as bytes) per row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"]
            for a, b in slices_of(texts.str.len(), SLICE_CHARS):
                sets = shingle_sets([t.encode("utf-8", "replace") for t in texts[a:b]], width)
                yield pd.DataFrame({"id": batch["id"][a:b].array, "shingles": [s.tobytes() for s in sets]})

    return docs.mapInPandas(run, "id long, shingles binary")


def confirmed_links(
    ids: np.ndarray, sets: list[np.ndarray], signatures: np.ndarray, percent: int, hashes: int
) -> list[tuple[int, int]]:
    """Links of a spanning forest over all pairs whose sets are similar enough.

    Grows one component at a time: each member met is compared with what no component
    has yet. ``signatures`` are rows of 64-bit words.
    """
    sizes = np.array([len(s) for s in sets])
    values, dense = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    least = percent / 100 - 6 * math.sqrt(0.25 / hashes)
    mark = np.zeros(len(values), bool)
    free = np.arange(len(ids))
    links = []
    while len(free):
        queue, free = [free[0]], free[1:]
        while queue and len(free):
            i = queue.pop()
            n = sizes[i]
            able = free[(sizes[free] * 100 >= percent * n) & (n * 100 >= percent * sizes[free])]
            able = able[estimates(signatures[i], signatures[able], hashes) >= least]
            if not len(able):
                continue
            mark[dense[cuts[i] : cuts[i + 1]]] = True
            held = [dense[cuts[j] : cuts[j + 1]] for j in able]
            shared = np.add.reduceat(mark[np.concatenate(held)], np.cumsum([0, *map(len, held[:-1])]), dtype=np.int64)
            mark[dense[cuts[i] : cuts[i + 1]]] = False
            found = able[100 * shared >= percent * (n + sizes[able] - shared)]
            links += [(int(ids[i]), int(ids[j])) for j in found]
            queue += list(found)
            free = np.setdiff1d(free, found, assume_unique=True)
    return links


def near_components(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, n_shingles, component`` per row of ``docs``; links join sets of at least ``percent`` similarity."""
    bands = band_count(percent / 100)
    hashes = bands * ROWS
    rows = spread_rows(docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")))
    profile = persist_table(_profile(rows, width, bands), "minhash-profile")
    linked = profile.where("id IS NOT NULL AND n > 0")
    prints = ["print_a", "print_b"]
    classes = linked.groupBy(*prints).agg(F.min("id").alias("rep"))
    member = persist_table(
        linked.select("id", *prints).join(classes, prints).select("id", "rep").distinct(), "minhash-members"
    )
    heads = linked.join(classes, prints).where("id = rep")
    keyed = heads.select("rep", F.explode("bands").alias("band")).distinct()
    buckets = keyed.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last")
    paths = keyed.join(buckets, "band").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    family = persist_table(components(paths, "minhash-families"), "minhash-family")
    links = _links(rows, heads, family, width, percent, hashes)
    # rows that repeat an id with another text tie their classes together
    same = member.join(member.groupBy("id").agg(F.min("rep").alias("least")), "id").where("rep <> least")
    ties = links.unionByName(same.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    roots = components(ties, "minhash-links")
    named = (
        member.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .groupBy("id")
        .agg(F.min(F.coalesce("root", "rep")).alias("component"))
    )
    return profile.select("id", F.col("n").alias("n_shingles")).join(named, "id", "left").select(
        "id", "n_shingles", F.coalesce("component", "id").alias("component")
    )


def _links(rows: DataFrame, heads: DataFrame, family: DataFrame, width: int, percent: int, hashes: int) -> DataFrame:
    """Confirmed links ``a, b`` between representatives of the same family."""
    sized = heads.select("rep", "n", "signature").join(family.withColumnRenamed("node", "rep"), "rep")
    chunks = sized.groupBy("root").agg(F.ceil(F.sum("n") / CHUNK_SHINGLES).alias("chunks"))
    placed = persist_table(
        sized.join(chunks, "root").select(
            "root",
            F.col("rep").alias("id"),
            "signature",
            "chunks",
            F.pmod(F.xxhash64("rep"), F.col("chunks")).alias("chunk"),
        ),
        "minhash-placed",
    )
    # A chunk meets every chunk of its family once. The ids grow with the table, so they are never broadcast.
    paired = (
        placed.join(_sets(rows.join(placed.select("id").hint("merge"), "id", "left_semi"), width), "id")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .select(
            "root", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"),
            "id", "signature", "shingles",
        )
    )

    def confirm(group: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
        signatures = np.frombuffer(b"".join(group["signature"]), np.uint64).reshape(len(sets), -1)
        found = confirmed_links(group["id"].to_numpy(), sets, signatures, percent, hashes)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return persist_table(paired.groupBy("root", "low", "high").applyInPandas(confirm, "a long, b long"), "minhash-confirmed")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs``, all columns, that are the smallest id of their component (or have no id)."""
    found = near_components(docs, width, percent)
    dropped = found.where("id <> component").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(read_table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )
