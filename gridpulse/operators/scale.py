"""Per-machine min-max scaling (survey C6-C7, D1, F1-F5).

Scalers are a long table (machine_id, column, data_min, data_max). It has one row
per machine and column, so it grows with the fleet and is never force-broadcast:
the optimizer broadcasts it when it is small and shuffles it otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse import messages
from gridpulse.config import PipelineConfig
from gridpulse.operators.blocks import blocked_lookup


def wide_scalers(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Min and max of each column per machine, one row per machine.

    Partial aggregation leaves one row per machine and map task to shuffle.
    """
    return rows.groupBy("machine_id").agg(
        *[F.min(c).alias(f"{c}__min") for c in columns],
        *[F.max(c).alias(f"{c}__max") for c in columns],
    )


def long_scalers(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"{c}__min").alias("data_min"),
            F.col(f"{c}__max").alias("data_max"),
        )
        for c in columns
    ]
    return wide.select("machine_id", F.inline(F.array(*entries)))


def widen_scalers(scalers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long scaler table back to one row per machine."""
    aggregates = []
    for c in columns:
        aggregates.append(F.max(F.when(F.col("column") == c, F.col("data_min"))).alias(f"{c}__min"))
        aggregates.append(F.max(F.when(F.col("column") == c, F.col("data_max"))).alias(f"{c}__max"))
    return scalers.groupBy("machine_id").agg(*aggregates)


def training_rows(series: DataFrame, config: PipelineConfig) -> DataFrame:
    """The first ``int(n * train_ratio)`` rows of each series (DOUBLE arithmetic)."""
    return series.filter(F.col("rn") < F.floor(F.col("n") * F.lit(float(config.train_ratio))))


def fit_minmax(series: DataFrame, columns: Sequence[str], config: PipelineConfig) -> DataFrame:
    """Scalers from the training rows only."""
    return long_scalers(wide_scalers(training_rows(series, config), columns), columns)


def fit_minmax_all(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scalers from all rows."""
    return long_scalers(wide_scalers(rows, columns), columns)


def with_scaler(
    df: DataFrame, scalers: DataFrame, columns: Sequence[str], few_rows: bool = False
) -> DataFrame:
    """Attach ``<column>__min`` and ``<column>__max``; NULL for a machine without scaler.

    The join is by (machine, block), so a busy machine is spread; ``few_rows`` says that no
    machine has more than a window of rows, which a plain join on the machine serves.
    """
    wide = widen_scalers(scalers, columns)
    return df.join(wide, "machine_id", "left") if few_rows else blocked_lookup(df, wide)


def scaled(value: Column, low: Column, high: Column) -> Column:
    """(x - min) / (max - min), not clipped; a constant column maps to 0."""
    return (value - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low)


def unscaled(value: Column, low: Column, high: Column) -> Column:
    """Inverse of ``scaled``; without a scaler the value is returned unchanged."""
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return F.coalesce(value * span + low, value)


def _bounds(column: str) -> tuple[Column, Column]:
    return F.col(f"{column}__min"), F.col(f"{column}__max")


def apply_scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale columns of a table that already carries its bounds."""
    return df.withColumns({c: scaled(F.col(c), *_bounds(c)) for c in columns})


def apply_unscaled(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Unscale value columns, given as value column -> scaler column."""
    return df.withColumns({v: unscaled(F.col(v), *_bounds(c)) for v, c in names.items()})


def _without_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*[f"{c}__{side}" for c in columns for side in ("min", "max")])


def minmax_transform(
    df: DataFrame, scalers: DataFrame, columns: Sequence[str], few_rows: bool = False
) -> DataFrame:
    joined = with_scaler(df, scalers, columns, few_rows)
    return _without_bounds(apply_scaled(joined, columns), columns)


def inverse_features(df: DataFrame, scalers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Back to real units; ``unscaled_warning`` tells rows that had no scaler."""
    joined = with_scaler(df, scalers, columns)
    missing = F.col(f"{columns[0]}__min").isNull()
    flagged = joined.withColumn(
        "unscaled_warning",
        F.when(missing, F.format_string(messages.NO_SCALER, F.col("machine_id"))),
    )
    return _without_bounds(apply_unscaled(flagged, {c: c for c in columns}), columns)


def inverse_targets(
    df: DataFrame, scalers: DataFrame, targets: Sequence[str], few_rows: bool = False
) -> DataFrame:
    """Forecast columns back to real units. Bounds are looked up by column name."""
    joined = with_scaler(df, scalers, targets, few_rows)
    return _without_bounds(apply_unscaled(joined, {c: c for c in targets}), targets)


def inverse_upload(
    df: DataFrame, scalers: DataFrame, features: Sequence[str], targets: Sequence[str]
) -> tuple[DataFrame, list[str]]:
    """Inverse for uploaded telemetry; targets outside the features stay scaled."""
    known = [c for c in targets if c in features]
    if not known:
        return df, [messages.TARGETS_NOT_FEATURES]
    return inverse_targets(df, scalers, known, few_rows=True), []


def constant_columns(scalers: DataFrame) -> DataFrame:
    """Machines with a constant column, with the warning text."""
    return (
        scalers.groupBy("machine_id")
        .agg(F.max(F.col("data_min") == F.col("data_max")).alias("constant"))
        .select(
            "machine_id",
            F.when(F.col("constant"), F.lit(messages.CONSTANT_COLUMNS)).alias("warning"),
        )
    )
