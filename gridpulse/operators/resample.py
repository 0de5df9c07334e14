"""Regular time grid: binning, bounded gap filling, row positions (survey C5, E1-E4).

A bin is kept as ``bin_no``, its number counted from the epoch; ``bin`` is its start.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.config import PipelineConfig
from gridpulse.functions.columns import epoch_micros, floor_div, from_epoch_micros
from gridpulse.operators.blocks import with_halo
from gridpulse.operators.clean import numeric_columns


def with_bin_start(df: DataFrame, config: PipelineConfig) -> DataFrame:
    return df.withColumn("bin", from_epoch_micros(f"bin_no * {config.interval_micros}L"))


def resample_mean(
    df: DataFrame, config: PipelineConfig, columns: Sequence[str] | None = None
) -> DataFrame:
    """Mean of every numeric column per machine and bin; missing values are ignored."""
    columns = list(columns or numeric_columns(df))
    bin_no = floor_div(epoch_micros("timestamp"), config.interval_micros)
    return (
        df.filter(F.col("timestamp").isNotNull() & F.col("machine_id").isNotNull())
        .groupBy("machine_id", bin_no.alias("bin_no"))
        .agg(*[F.avg(c).alias(c) for c in columns])
    )


def gap_spine(bins: DataFrame, config: PipelineConfig) -> DataFrame:
    """Every bin between a machine's first and last one, empty ones with NULLs.

    Ranges come from an aggregate and unfold in two steps of at most a block, so
    no row ever carries a whole range; the join key (machine, bin) is unique.
    """
    size = config.block_rows
    spans = bins.groupBy("machine_id").agg(
        F.min("bin_no").alias("first_bin"), F.max("bin_no").alias("last_bin")
    )
    blocks = spans.withColumn(
        "block",
        F.explode(
            F.sequence(floor_div(F.col("first_bin"), size), floor_div(F.col("last_bin"), size))
        ),
    )
    spine = blocks.select(
        "machine_id",
        F.explode(
            F.sequence(
                F.greatest(F.col("first_bin"), F.col("block") * size),
                F.least(F.col("last_bin"), F.col("block") * size + (size - 1)),
            )
        ).alias("bin_no"),
    )
    return spine.join(bins, ["machine_id", "bin_no"], "left")


def fill_gaps(
    bins: DataFrame,
    config: PipelineConfig,
    columns: Sequence[str] | None = None,
    drop_incomplete: bool = True,
) -> DataFrame:
    """Bounded forward fill, gap removal and row positions in one pass.

    Each column carries its last value over at most ``ffill_limit`` missing bins;
    bins where any column is still missing are dropped (or kept, for inspection,
    with ``drop_incomplete=False``; bins farther than the limit from the last
    occupied one have nothing to fill and never appear). Adds ``rn``, the 0-based
    position in the machine's series, and ``n``, the length of that series.

    No empty bins are built first: an occupied bin emits itself and the filled bins
    behind it, so at most ``ffill_limit + 1`` rows whatever the time range. Values are
    looked up in the ``ffill_limit`` occupied bins before it, in the one sort of one
    exchange on (machine, block). Positions come from per-block counts, a table smaller
    by the block size, whose running sums are joined back on the same key.
    """
    columns = list(columns or numeric_columns(bins, exclude=("machine_id", "bin_no")))
    size, limit = config.block_rows, config.ffill_limit
    order = "PARTITION BY machine_id, block ORDER BY bin_no"

    halo = with_halo(
        bins.select("machine_id", "bin_no", *columns), "bin_no", size, back=limit, ahead=0
    )
    neighbours = [f"lead(bin_no) OVER ({order}) AS next_bin"]
    for i in range(1, limit + 1):
        neighbours.append(f"bin_no - lag(bin_no, {i}) OVER ({order}) AS age__{i}")
        neighbours += [f"lag(`{c}`, {i}) OVER ({order}) AS `{c}__{i}`" for c in columns]
    around = halo.selectExpr("*", *neighbours)

    def last_known(column: str, here: str, before: str) -> str:
        """SQL over the occupied bins in reach, nearest first; NULL if all are missing."""
        cases = [f"WHEN `{column}` IS NOT NULL THEN {here}"]
        cases += [
            f"WHEN age__{i} <= {limit} AND `{column}__{i}` IS NOT NULL THEN {before % i}"
            for i in range(1, limit + 1)
        ]
        return f"CASE {' '.join(cases)} END"

    known = around.selectExpr(
        "machine_id",
        "block",
        "bin_no",
        "next_bin",
        *[f"{last_known(c, f'`{c}`', f'`{c}__%d`')} AS `{c}`" for c in columns],
        *[f"{last_known(c, '0L', 'age__%d')} AS `{c}__age`" for c in columns],
    )

    # A bin emits itself and the bins d behind it for d in [first_d, last_d]: up to the
    # next occupied bin, the end of the block, and the age at which a value expires.
    ends = [f"(block + 1) * {size} - 1 - bin_no", f"{limit}L", "next_bin - 1 - bin_no"]
    last_d = f"least({', '.join(ends)})"
    if drop_incomplete:
        complete = " AND ".join(f"`{c}__age` IS NOT NULL" for c in columns)
        oldest = ", ".join(["0L", "0L", *[f"`{c}__age`" for c in columns]])
        last_d = f"CASE WHEN {complete} THEN least({last_d}, {limit} - greatest({oldest})) ELSE -1L END"
    else:
        # Ages are never negative, so this adds zero; it keeps the columns in both branches.
        last_d += f" + least(0L, {', '.join(f'`{c}__age`' for c in columns)})"
    emitting = known.selectExpr(
        "*", f"greatest(0L, block * {size} - bin_no) AS first_d", f"{last_d} AS last_d"
    ).selectExpr("*", "greatest(0L, last_d - first_d + 1) AS row_count")

    # Filled bins with nothing behind them in their block are real only if the machine
    # goes on in a later block.
    counts = emitting.groupBy("machine_id", "block").agg(
        F.expr("sum(row_count) AS all_rows"),
        F.expr(
            "sum(CASE WHEN next_bin IS NULL THEN greatest(0L, last_d - greatest(first_d, 1L) + 1)"
            " ELSE 0L END) AS trailing_rows"
        ),
        F.expr(f"max(CASE WHEN bin_no >= block * {size} THEN block END) AS own_block"),
    )
    offsets = (
        counts.selectExpr(
            "*",
            "coalesce(block < max(own_block) OVER (PARTITION BY machine_id), false) AS goes_on",
        )
        .selectExpr(
            "*", "all_rows - CASE WHEN goes_on THEN 0L ELSE trailing_rows END AS block_total"
        )
        .selectExpr(
            "machine_id",
            "block",
            "goes_on",
            "coalesce(sum(block_total) OVER (PARTITION BY machine_id ORDER BY block"
            " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS offset",
            "sum(block_total) OVER (PARTITION BY machine_id) AS n",
        )
    )

    placed = (
        emitting.selectExpr(
            "*",
            f"coalesce(sum(row_count) OVER ({order}"
            " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS preceding",
        )
        # Merge join: this side is already hash-partitioned and sorted by the key, and
        # must never be the one that is broadcast, whatever its estimated size.
        .hint("merge")
        .join(offsets, ["machine_id", "block"])
        .withColumn(
            "last_d",
            F.expr("CASE WHEN next_bin IS NULL AND NOT goes_on THEN least(last_d, 0L) ELSE last_d END"),
        )
        .filter("first_d <= last_d")
        .selectExpr("*", "explode(sequence(first_d, last_d)) AS d")
    )
    values = [
        f"`{c}`" if drop_incomplete else f"CASE WHEN `{c}__age` + d <= {limit} THEN `{c}` END AS `{c}`"
        for c in columns
    ]
    series = placed.selectExpr(
        "machine_id",
        "bin_no + d AS bin_no",
        *values,
        "offset + preceding + d - first_d AS rn",
        "n",
    )
    # Always true, and more than the optimizer can know: it keeps the columns of positions
    # alive for callers that drop them, so that both branches read one exchange.
    return with_bin_start(series.filter("rn < n"), config)


def forward_fill(
    bins: DataFrame, config: PipelineConfig, columns: Sequence[str] | None = None
) -> DataFrame:
    """Occupied bins and the bins within the fill limit behind them, still with NULLs."""
    return fill_gaps(bins, config, columns, drop_incomplete=False).drop("rn", "n")


def regular_series(
    rolled: DataFrame, config: PipelineConfig, columns: Sequence[str] | None = None
) -> DataFrame:
    """Rolled-up telemetry to the gap-filled, numbered series of every machine."""
    return fill_gaps(resample_mean(rolled, config, columns), config, columns)
