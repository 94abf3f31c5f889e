"""Document fingerprints by winnowing, in DataFrame functions only.

Hashes of all ``GRAM``-character grams are taken; of every ``WINDOW`` consecutive
ones the smallest is selected, the rightmost of equal ones. Two texts that share a
run of ``GRAM + WINDOW - 1`` characters share a selected hash. A hash and its
position are one number, ``hash << 32 | (2**31 - 1 - position)``, so the rightmost
of equal hashes is the smallest number; minima of windows come from doubling.

A fingerprint is written as ``hash:position`` in hexadecimal, in order of position.
Likeness is the share of distinct hashes two fingerprints have in common.

Defined results: null texts are empty and have the empty fingerprint; a text shorter
than a gram is one gram; a text with fewer grams than a window is one window; two
empty fingerprints are alike (1), an empty one and another are not (0). Rows without
id come first; rows that share an id follow each other in the order of their texts;
a single row is its own neighbour; an empty table gives no rows. Other columns are
not looked at. Positions are exact up to 2**31 characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import let
from tessera.llm.common import read_table, text_or_empty

GRAM, WINDOW = 12, 32
BUCKET_ROWS, MOST_BUCKETS, STEP = 4_000, 1 << 18, 64
NO_ID = -(1 << 63)
_LAST = (1 << 31) - 1


def _from(values: Column, start: Column | int) -> Column:
    """The array without its first ``start`` elements."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.slice(values, start + 1, F.greatest(F.size(values) - start, F.lit(0)))


def _doubled(reach: int):
    """Minima of windows of twice the length, from those of ``reach`` neighbours."""
    return lambda k: F.zip_with(k, _from(k, reach), lambda a, b: F.least(a, b))


def gram_keys(text: Column, offset: Column | None = None) -> Column:
    """Hash and position of every gram of ``text``, whose first character stands at ``offset``."""
    grams = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))."), F.lit(1))
    short = (F.length(text) < GRAM) & (F.length(text) > 0)
    if offset is not None:
        short &= offset == 0
    grams = F.when(short, F.array(text)).otherwise(grams)
    last = F.lit(_LAST) if offset is None else F.lit(_LAST) - offset
    return F.transform(
        grams,
        lambda g, i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(g), 33), 32).bitwiseOR((last - i).cast("long")),
    )


def selected(keys: Column) -> Column:
    """The distinct minima of all windows of ``keys``, in order of position."""

    def minima(keys: Column) -> Column:
        out, reach = keys, 1
        while reach < WINDOW:
            out, reach = let(out, _doubled(reach)), 2 * reach
        return F.array_distinct(F.slice(out, 1, F.greatest(F.size(keys) - WINDOW + 1, F.lit(1))))

    return let(keys, lambda k: F.when(F.size(k) > 0, minima(k)).otherwise(k))


def fingerprint(text: Column) -> Column:
    """Selected numbers of a text."""
    return selected(gram_keys(text))


def position(key: Column) -> Column:
    return F.lit(_LAST) - key.bitwiseAND(F.lit(_LAST)).cast("int")


def with_new_tail(own: Column, kept: Column, whole: Column) -> Column:
    """Fingerprint of ``whole``, which begins with the ``kept`` characters that ``own`` was made from too.

    Windows of grams inside the common part select what they selected before; only
    those that reach past it, and a window's length before them, are taken anew.
    """
    same = F.greatest(kept - (GRAM + WINDOW - 2), F.lit(0))  # windows inside the common part
    start = F.greatest(same - WINDOW, F.lit(0))

    def renewed(ends: Column) -> Column:
        old = F.filter(own, lambda k: position(k) < ends["same"])
        tail = F.substring(whole, ends["start"] + 1, F.length(whole))
        return F.array_distinct(F.concat(old, selected(gram_keys(tail, ends["start"]))))

    return let(F.struct(same.alias("same"), start.alias("start")), renewed)


def as_text(keys: Column) -> Column:
    return F.array_join(
        F.transform(keys, lambda k: F.concat(F.hex(F.shiftright(k, 32)), F.lit(":"), F.hex(position(k)))), ","
    )


def likeness(a: Column, b: Column) -> Column:
    """Common share of the distinct hashes of two fingerprints."""

    def hashes(keys: Column) -> Column:
        return F.array_distinct(F.transform(keys, lambda k: F.shiftright(k, 32)))

    def share(s: Column) -> Column:
        common = F.size(F.array_intersect(s["a"], s["b"]))
        union = F.size(s["a"]) + F.size(s["b"]) - common
        return F.when(union > 0, common / union).otherwise(F.lit(1.0))

    return let(F.struct(hashes(a).alias("a"), hashes(b).alias("b")), share)


def with_next(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` (``key``, ``text`` and others) with ``next_<column>`` of the following row, the last followed by the first.

    Rows are dealt to ranges of keys whose bounds are keys themselves, so the row that
    starts a range is known by its key; a copy of it closes the range before. One
    exchange, no join, and no task holds more than a range: ``BUCKET_ROWS`` rows, or a
    ``MOST_BUCKETS``-th of a table of over a billion. A row finds its range in two steps.
    """
    count = rows.count()
    wanted = min(MOST_BUCKETS, count // BUCKET_ROWS + 1)
    shares = [i / wanted for i in range(wanted)]
    cuts = F.percentile_approx("key", shares, max(10_000, 10 * wanted))
    ends = rows.agg(cuts.alias("cuts"), F.min("key").alias("least")).first()  # as many keys as ranges
    bounds = sorted({*(ends["cuts"] or []), ends["least"] if count else 0})
    table, coarse = F.lit(bounds), F.lit(bounds[::STEP])
    start = (F.size(F.filter(coarse, lambda b: b <= F.col("key"))) - 1) * STEP
    bucket = start + F.size(F.filter(F.slice(table, start + 1, F.lit(STEP)), lambda b: b <= F.col("key"))) - 1
    before = F.when(F.col("bucket") > 0, F.col("bucket") - 1).otherwise(F.lit(len(bounds) - 1))
    dealt = rows.withColumn("bucket", bucket)
    first = F.col("key") == F.get(table, F.col("bucket"))
    copies = F.when(
        first,
        F.array(
            F.struct(F.col("bucket").alias("to"), F.lit(False).alias("closing")),
            F.struct(before.alias("to"), F.lit(True).alias("closing")),
        ),
    ).otherwise(F.array(F.struct(F.col("bucket").alias("to"), F.lit(False).alias("closing"))))
    order = Window.partitionBy("to").orderBy("closing", "key", "text")
    return (
        dealt.withColumn("copy", F.explode(copies))
        .select(*rows.columns, "copy.to", "copy.closing")
        .select(*rows.columns, "closing", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
        .where("NOT closing")
        .drop("closing")
    )


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select(key.alias("key"), text_or_empty().alias("text"))
    dealt = with_next(rows.withColumn("own", fingerprint(F.col("text"))), "text", "own")
    n = F.length("text")
    kept = n - F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), kept), F.substring(F.col("next_text"), F.lit(1), n - kept))
    done = dealt.select(
        "key", n.cast("long").alias("n_chars"), kept.alias("n_kept"), edited.alias("edited"), "own", "next_own"
    ).withColumn("renewed", with_new_tail(F.col("own"), F.col("n_kept"), F.col("edited")))
    return done.select(
        F.nullif("key", F.lit(NO_ID)).alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("renewed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("renewed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
