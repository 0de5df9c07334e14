"""Forecasts for user-supplied telemetry (survey G11, J15), all machines in one job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse import messages
from gridpulse.config import PipelineConfig
from gridpulse.operators.clean import (
    DEFAULT_MACHINE,
    REQUIRED_TELEMETRY,
    coerce_numeric,
    default_machine,
    require_columns,
    resolve_features,
)
from gridpulse.operators.forecast import Forecaster, MovingAverage, score
from gridpulse.operators.scale import apply_unscaled, scaled
from gridpulse.operators.windows import last_rows, short_warning


@dataclass(frozen=True)
class UploadForecast:
    """``machines`` (id, rows, warnings), ``points`` (history and forecast), warnings."""

    model: str
    machines: DataFrame
    points: DataFrame
    features: list[str]
    targets: list[str]
    warnings: list[str]


def _ordered_window(features: Sequence[str]):
    rows = F.collect_list(F.struct("back", F.array(*features).alias("row")))
    return F.transform(F.sort_array(rows, asc=False), lambda entry: entry["row"])


def forecast_upload(
    telemetry: DataFrame,
    config: PipelineConfig,
    model: Forecaster | None = None,
    order_by: str = "row_order",
) -> UploadForecast:
    """Forecast each machine from its last S usable rows in file order.

    Scalers are fitted on all usable rows of a machine, in the same aggregate that
    counts them; only the last S rows per machine are shuffled for the window.
    """
    model = model or MovingAverage(config.horizon)
    require_columns(telemetry)
    if order_by not in telemetry.columns:
        raise ValueError(f"order column {order_by!r} is missing; rows have no order without it")
    s = config.sequence_length
    typed = coerce_numeric(telemetry, config.features)
    padded, features, warnings = resolve_features(typed, config, model.input_dim)
    named, id_warnings = default_machine(padded)
    warnings = [*warnings, *id_warnings]
    targets = list(config.targets)
    known = [t for t in targets if t in features]

    usable = F.lit(True)
    for c in REQUIRED_TELEMETRY:
        usable &= F.col(c).isNotNull()
    flagged = named.select("machine_id", order_by, *features, usable.alias("usable"))
    valid = [F.when(F.col("usable"), F.col(c)) for c in features]
    stats = flagged.groupBy("machine_id").agg(
        F.count_if("usable").alias("num_input_rows"),
        *[F.min(v).alias(f"{c}__min") for c, v in zip(features, valid)],
        *[F.max(v).alias(f"{c}__max") for c, v in zip(features, valid)],
    )
    constant = F.lit(False)
    for c in features:
        constant |= F.col(f"{c}__min") == F.col(f"{c}__max")
    enough = F.col("num_input_rows") >= s
    notes = [
        short_warning(F.col("num_input_rows"), config),
        F.when(enough & constant, F.lit(messages.CONSTANT_COLUMNS)),
        F.when(enough, F.lit(messages.TARGETS_NOT_FEATURES)) if not known else F.lit(None).cast("string"),
    ]
    machines = stats.select(
        "machine_id", "num_input_rows", F.array_compact(F.array(*notes)).alias("warnings")
    )

    valid_rows = flagged.filter("usable")
    if "machine_id" in telemetry.columns:
        tail = last_rows(valid_rows, s, order_by)
    else:
        tail = last_rows(valid_rows.drop("machine_id"), s, order_by).withColumn(
            "machine_id", F.lit(DEFAULT_MACHINE)
        )
    # A full window is told by its own size, so the counts need not be joined.
    windows = (
        tail.groupBy("machine_id")
        .agg(_ordered_window(features).alias("raw"))
        .filter(F.size("raw") == s)
    )
    past = windows.select(
        "machine_id", F.posexplode("raw").alias("step", "row")
    ).select(
        "machine_id", F.lit("history").alias("kind"), "step",
        *[F.col("row")[i].alias(c) for i, c in enumerate(features)],
    )

    if isinstance(model, MovingAverage) and features[: len(targets)] == targets:
        # The mean commutes with scaling: no scaler needed.
        scored = model.forecast(windows.withColumnRenamed("raw", "x"))
        long = scored.select("machine_id", F.posexplode("forecast").alias("step", "row")).select(
            "machine_id", "step", *[F.col("row")[i].alias(t) for i, t in enumerate(targets)]
        )
    else:
        bounded = windows.join(stats, "machine_id").withColumn(
            "x", F.transform("raw", lambda row: F.array(*_scaled_row(row, features)))
        )
        scored = score(bounded.drop("raw"), model)
        bounds = [f"{t}__{side}" for t in known for side in ("min", "max")]
        long = scored.select(
            "machine_id", *bounds, F.posexplode("forecast").alias("step", "row")
        ).select(
            "machine_id", "step", *bounds,
            *[F.col("row")[i].alias(t) for i, t in enumerate(targets)],
        )
        long = apply_unscaled(long, {t: t for t in known}).drop(*bounds)

    columns = features + [t for t in targets if t not in features]
    null = F.lit(None).cast("double")
    ahead = long.select(
        "machine_id", F.lit("forecast").alias("kind"), "step",
        *[F.col(c) if c in targets else null.alias(c) for c in columns],
    )
    return UploadForecast(
        model=model.name,
        machines=machines,
        points=past.withColumns({c: null for c in columns if c not in features}).unionByName(ahead),
        features=features,
        targets=targets,
        warnings=warnings,
    )


def _scaled_row(row, features: Sequence[str]):
    return [
        scaled(row[i], F.col(f"{c}__min"), F.col(f"{c}__max")) for i, c in enumerate(features)
    ]
