"""Shards that all match the mixture of sources, by stratified interleaving.

Rows of each source are ranked in a seeded random order; row r of n gets the fraction
(2r - 1) / 2n. Sorted by fraction, every stretch of the table holds the sources in their
proportions, so equal cuts of the order are shards that do.

Neither ranking puts a whole source or the whole table in one place: rows are sorted by
Spark's range partitioning on the whole sort key, which splits ties of one part of the key by
the others, and numbered inside partitions. A row's rank is its number plus the rows of its
stratum in the partitions before; those counts are one row per partition and stratum in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.llm.scratch import stored

_PART_BITS = 33  # monotonically_increasing_id keeps the partition above so many bits


def _ranked(rows: DataFrame, strata: list[str], order: list[Column | str], purpose: str) -> DataFrame:
    """Add ``rank`` (from 1) and ``total`` of each row's stratum in the given order.

    The numbered rows are written, so a task that runs again sees the same numbers.
    """
    numbered = rows.orderBy(*strata, *order).withColumn("_row", F.monotonically_increasing_id())
    numbered = stored(numbered, purpose).withColumn("_part", F.shiftright("_row", _PART_BITS))
    keys = [*strata, "_part"]
    sizes = numbered.groupBy(*keys).agg(F.count("*").alias("_size"), F.min("_row").alias("_first"))
    whole = Window.partitionBy(*strata)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *keys,
        (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        F.sum("_size").over(whole).alias("total"),
    )
    return (
        numbered.join(sizes, keys).withColumn("rank", F.col("_row") + F.col("_shift"))
        .drop("_row", "_part", "_shift")
    )


def interleaved_shards(docs: DataFrame, shards: int = 24, seed: int = 8) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, text_crc32, shard, slot.

    ``size`` is the UTF-8 length plus 8, ``text_crc32`` unsigned; a null text counts as
    empty, a null source is a source of its own, a null doc_id sorts as the text 'null'.
    Shards differ by one row at most; ``slot`` counts from 0 in each. The random order is
    that of md5(seed:doc_id); ties go by doc_id, size and checksum, so only rows equal in
    all of them can trade places. Further columns are ignored; no rows give no rows.
    """
    count = docs.count()
    text = F.coalesce("text", F.lit(""))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("_stratum"),
        key.alias("_key"),
    )
    ties = ["doc_id", "size", "text_crc32"]
    ranked = _ranked(rows, ["_stratum"], ["_key", *ties], "strata")
    placed = ranked.withColumn("_at", (2 * F.col("rank") - 1) / (2 * F.col("total"))).drop("rank", "total")
    ordered = _ranked(placed, [], ["_at", "_stratum", "_key", *ties], "interleaved")
    position = F.col("rank") - 1
    shard = F.expr(f"(rank - 1) * {shards} div {max(count, 1)}")
    first = F.expr(f"(_shard * {count} + {shards - 1}) div {shards}")
    return ordered.withColumn("_shard", shard).select(
        "doc_id", "source", "size", "text_crc32",
        F.col("_shard").cast("int").alias("shard"), (position - first).alias("slot"),
    )
