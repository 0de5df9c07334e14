"""Projection, filtering, cleaning and schema resolution (survey B1-B13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse import messages
from gridpulse.config import PipelineConfig
from gridpulse.functions.columns import (
    clip,
    from_epoch_micros,
    is_numeric,
    nan_to_null,
    present,
    to_number,
)

# Raw-to-standard names, percent columns and the kept columns.
USAGE_NAMES = {
    "avg_cpu": "cpu_usage",
    "avg_memory": "memory_usage",
    "max_cpu": "max_cpu_usage",
    "max_memory": "max_memory_usage",
}
PERCENT_COLUMNS = ("cpu_usage", "memory_usage", "max_cpu_usage", "max_memory_usage")
KEPT_COLUMNS = (
    "timestamp", "machine_id", "collection_id", "cpu_usage", "memory_usage",
    "max_cpu_usage", "max_memory_usage", "assigned_memory", "cycles_per_instruction",
)
REQUIRED_USAGE = ("cpu_usage", "memory_usage", "machine_id")
REQUIRED_TELEMETRY = ("cpu_usage", "memory_usage")
DEFAULT_MACHINE = "uploaded"


def decode_timestamp(df: DataFrame, source: str = "start_time") -> DataFrame:
    """Microseconds since trace start, as a timestamp counted from the epoch."""
    return df.withColumn("timestamp", from_epoch_micros(f"`{source}`"))


def rename_usage(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(USAGE_NAMES)


def to_percent(df: DataFrame, columns: Sequence[str] = PERCENT_COLUMNS) -> DataFrame:
    """Fractions to percent, clipped to 0-100."""
    return df.withColumns(
        {c: clip(nan_to_null(F.col(c)) * 100.0, 0.0, 100.0) for c in present(df, columns)}
    )


def drop_incomplete(df: DataFrame, required: Sequence[str] = REQUIRED_USAGE) -> DataFrame:
    return df.dropna(subset=list(required))


def keep_columns(df: DataFrame, columns: Sequence[str] = KEPT_COLUMNS) -> DataFrame:
    return df.select(*present(df, columns))


def sort_by_time(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Global time order for output; no later operator relies on it."""
    return df.orderBy(F.col(column).asc_nulls_last())


def clean_usage(df: DataFrame) -> DataFrame:
    """Raw usage rows to cleaned usage rows (one narrow stage, no shuffle)."""
    return (
        df.transform(decode_timestamp)
        .transform(rename_usage)
        .transform(to_percent)
        .transform(drop_incomplete)
        .transform(keep_columns)
    )


def profile(df: DataFrame) -> DataFrame:
    """Row count, number of machines and time range."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.countDistinct("machine_id").alias("machine_count"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
    )


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ("machine_id",)) -> list[str]:
    return [
        f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude
    ]


def require_columns(df: DataFrame, required: Sequence[str] = REQUIRED_TELEMETRY) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(messages.MISSING_COLUMNS % (missing, list(required)))
    return df


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Feature columns as DOUBLE; text that is no number becomes NULL."""
    types = dict(df.dtypes)
    return df.withColumns(
        {
            c: to_number(F.col(c))
            if types[c] == "string"
            else nan_to_null(F.col(c).cast("double"))
            for c in present(df, columns)
        }
    )


def default_machine(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Name the one machine of a table without ids; drop rows whose id is missing."""
    if "machine_id" in df.columns:
        named = df.withColumn("machine_id", F.col("machine_id").cast("string"))
        return named.filter(F.col("machine_id").isNotNull()), []
    named = df.withColumn("machine_id", F.lit(DEFAULT_MACHINE))
    return named, [messages.NO_MACHINE_COLUMN]


def resolve_features(
    df: DataFrame, config: PipelineConfig, expected_dim: int | None
) -> tuple[DataFrame, list[str], list[str]]:
    """Feature columns for a model of ``expected_dim`` inputs.

    Returns the table (absent features padded with 0.0), the feature names in
    configured order, and warnings.
    """
    have = len(present(df, config.features))
    wanted = have if expected_dim is None else expected_dim
    chosen, surplus, padding = [], [], []
    for name in config.features:
        if name in df.columns:
            (chosen if len(chosen) - len(padding) < wanted else surplus).append(name)
        elif have + len(padding) < wanted:
            padding.append(name)
            chosen.append(name)
    warnings = [messages.EXTRA_FEATURES % (wanted, surplus)] if surplus else []
    warnings += [messages.PADDED_COLUMN % name for name in padding]
    return df.withColumns({name: F.lit(0.0) for name in padding}), chosen, warnings


def select_features(
    columns: Sequence[str], config: PipelineConfig
) -> tuple[list[str], list[str], list[str]]:
    """Configured features and targets among ``columns``, and their ordered union."""
    features = [c for c in config.features if c in columns]
    targets = [c for c in config.targets if c in columns]
    if not features or not targets:
        raise ValueError(f"Missing columns. Features: {features}, targets: {targets}")
    return features, targets, features + [c for c in targets if c not in features]
