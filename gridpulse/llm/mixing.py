"""A training mix of sources by a time-varying curriculum.

Each source has a base weight and a schedule, its relative rate over training time 0 to 1.
Base weights fix how many words a source gives (its target); the integral of its schedule
says how many of them are due by any time. Documents of a source stand in a seeded order and
are read as often as the target asks; inverting the integral at a document's first word gives
its training position, and a range sort by position is the training order.

Nothing is ordered in one place. Equal rows are one row with a count; rows are bucketed by
the leading digits of their order key, summed per bucket and moved up by the buckets before,
so a source with any share of the table is spread over about sqrt(rows) buckets. Sources are
numbered per range of names and moved up in the same way.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.llm.scratch import stored

WEIGHTS = (5, 2, 1)  # by the source's place in code-point order, repeating; null last
MOST_READS = 3
# (time, relative rate) knots by place as above; the rate is linear between knots.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.25), (0.5, 0.75), (1.0, 2.25)),
)

_LEADING = 16**8
_WORD = r"[^\x20\x09-\x0D]+"
_EXACT = "decimal(38,0)"


def _numbered(sources: DataFrame) -> DataFrame:
    """Add ``place`` (from 0) in code-point order, null last."""
    absent = F.col("source").isNull()
    parts = stored(
        sources.repartitionByRange(absent, F.col("source")).withColumn("_part", F.spark_partition_id()),
        "sources",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(absent, "source")
    numbered = parts.withColumn("_row", F.row_number().over(inside) - 1).join(sizes, "_part")
    return numbered.withColumn("place", F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def targets(sources: DataFrame) -> DataFrame:
    """Add ``place``, ``tier`` and ``target`` to rows of (source, source_size), one a source.

    Targets share the sum of all sizes by weight, no target above ``MOST_READS`` times its
    source. The share per weight only rises while capped sources drop out, so a few rounds
    over the table of sources settle it; the driver sees three sums a round.
    """
    tier = F.expr(f"cast(place % {len(WEIGHTS)} as int)")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("tier") + 1)
    table = _numbered(sources).withColumn("tier", tier).withColumn("_weight", weight)
    table = stored(table.withColumn("_cap", MOST_READS * F.col("source_size")), "targets")
    whole = table.agg(F.sum("source_size")).first()[0] or 0
    rest, share = whole, 0  # of sources that are not capped: words left, sum of weights

    def capped() -> Column:
        words = F.lit(rest).cast(_EXACT)
        return F.col("_cap").cast(_EXACT) * share < F.col("_weight") * words

    state = None
    while True:
        full = F.lit(False) if state is None else capped()
        row = table.agg(
            F.sum(F.when(full, F.col("_cap")).otherwise(0)).alias("given"),
            F.sum(F.when(full, 0).otherwise(F.col("_weight"))).alias("share"),
        ).first()
        now = whole - (row["given"] or 0), row["share"] or 0
        if now == state:
            break
        state = rest, share = now
    even = F.try_divide(F.col("_weight") * F.lit(rest).cast("double"), F.lit(share).cast("double"))
    target = F.when(capped(), F.col("_cap").cast("double")).otherwise(F.coalesce(even, F.lit(0.0)))
    return table.withColumn("target", target).drop("_weight", "_cap")


def _knots(schedule: tuple) -> list[tuple[float, float, float, float]]:
    """(time, rate, slope, share of the integral before it) of each piece of a schedule."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:])]
    whole, before, pieces = sum(area), 0.0, []
    for (a, b), part in zip(zip(schedule, schedule[1:]), area):
        pieces.append((a[0], a[1] / whole, (b[1] - a[1]) / (b[0] - a[0]) / whole, before))
        before += part / whole
    return pieces


def due_time(share: Column, schedule: tuple) -> Column:
    """The time at which a schedule has given ``share`` (0 to 1) of its integral."""
    time, later = None, None
    for start, rate, slope, before in reversed(_knots(schedule)):
        more = share - before
        root = F.sqrt(F.greatest(F.lit(rate * rate) + more * (2 * slope), F.lit(0.0)))
        piece = F.coalesce(F.try_divide(more * 2, root + rate), F.lit(0.0)) + start
        time = piece if time is None else F.when(share >= F.lit(later), time).otherwise(piece)
        later = before
    return time


def scheduled(docs: DataFrame, seed: int = 13) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, reads,
    position, positions.

    ``size`` counts the words of the text (null: 0). A source gives its target, rounded to
    whole words: its documents in seeded order, read again from the start up to
    ``MOST_READS`` times; the last one is cut where the target is met. ``taken`` is the
    number of words read from the document over all ``reads``; ``positions`` are the times
    (0 to 1) at which its reads begin and ``position`` the first of them, null if it is not
    read. The order is that of md5(seed:doc_id:text) and then doc_id and size, so rows of
    one doc_id with different texts have own places and only equal rows can trade theirs.
    A null source is a source of its own, a null doc_id counts as 'null'. Very long texts
    are counted whole. Further columns are ignored; an empty table gives no rows, texts
    without words targets of 0.
    """
    count = docs.count()
    buckets = max(1, isqrt(count))
    key = F.md5(F.concat(
        F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
        F.lit(":"), F.coalesce("text", F.lit("")),
    ))
    leading = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    rows = docs.select(
        "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("_key"),
    )
    rows = rows.groupBy("doc_id", "source", "size", "_key").agg(F.count("*").alias("_copies"))
    rows = rows.withColumns({
        "_bucket": F.floor(leading * buckets / F.lit(_LEADING)),
        "_stratum": F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")),
        "_words": F.col("size") * F.col("_copies"),
    })
    rows = stored(rows, "mixed")

    keys = ["_stratum", "_bucket"]
    sums = rows.groupBy(*keys).agg(F.sum("_words").alias("_sum"), F.first("source").alias("source"))
    sums = stored(sums, "mixed-sums")
    sources = sums.groupBy("_stratum", "source").agg(F.sum("_sum").alias("source_size"))
    aims = targets(sources).drop("source")
    before = Window.partitionBy("_stratum").orderBy("_bucket")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    sums = sums.join(aims, "_stratum")

    inside = Window.partitionBy(*keys).orderBy("_key", "doc_id", "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_start", F.coalesce(F.sum("_words").over(inside), F.lit(0)))
    placed = placed.join(sums, keys).withColumn(
        "_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1))
    )
    placed = placed.withColumn("_start", F.col("_before") + F.col("_start") + F.col("_copy") * F.col("size"))
    wanted = F.floor(F.col("target") + 0.5)
    reads = F.array(*[
        F.greatest(F.least(wanted - F.col("_start") - F.col("source_size") * read, "size"), F.lit(0))
        for read in range(MOST_READS)
    ])
    shares = [
        F.try_divide((F.col("_start") + F.col("source_size") * read).cast("double"), F.col("target"))
        for read in range(MOST_READS)
    ]
    times = F.array(*[
        F.coalesce(*[
            F.when(F.col("tier") == tier, due_time(share, schedule))
            for tier, schedule in enumerate(SCHEDULES)
        ])
        for share in shares
    ])
    placed = placed.withColumn("_reads", reads).withColumn("_n", F.size(F.filter("_reads", lambda n: n > 0)))
    placed = placed.withColumn("positions", F.slice(times, F.lit(1), F.col("_n")))
    return placed.select(
        "doc_id", "source", "size", "source_size", "target",
        F.aggregate("_reads", F.lit(0).cast("long"), lambda a, n: a + n).alias("taken"),
        F.col("_n").alias("reads"),
        F.try_element_at("positions", F.lit(1)).alias("position"),
        "positions",
    )


def in_training_order(mix: DataFrame) -> DataFrame:
    """Documents of ``scheduled`` range-sorted by their first training position.

    Documents that are not read come last; partitions are ranges of positions. Ties go by
    doc_id and size.
    """
    unread = F.col("position").isNull()
    order = [unread, F.col("position"), F.col("doc_id"), F.col("size")]
    return mix.repartitionByRange(*order).sortWithinPartitions(*order)
