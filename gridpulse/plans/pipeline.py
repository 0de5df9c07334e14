"""From usage rows to series, windows and forecasts of all machines (survey E8, G10)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.config import PipelineConfig
from gridpulse.operators.clean import clean_usage, numeric_columns, select_features
from gridpulse.operators.forecast import Forecaster, MovingAverage, moving_average, score
from gridpulse.operators.resample import regular_series
from gridpulse.operators.rollup import clip_rollup, restrict_to, rollup_machine
from gridpulse.operators.scale import (
    fit_minmax,
    inverse_targets,
    minmax_transform,
)
from gridpulse.operators.windows import (
    array_windows,
    latest_stored,
    latest_window,
    reject_short,
    scaled_blocks,
    skipped_machines,
    sliding_windows,
)


def fleet_series(
    usage: DataFrame, config: PipelineConfig, top_n: int | None = None, count_jobs: bool = False
) -> DataFrame:
    """Raw usage rows to the numbered regular series of every machine.

    The job count is missing exactly where cpu is, so leaving it out by default
    keeps the same bins and saves the shuffle of its distinct aggregate.
    """
    rolled = clip_rollup(rollup_machine(clean_usage(usage), count_jobs))
    if top_n is not None:
        rolled = restrict_to(rolled, top_n)
    return regular_series(rolled, config)


def telemetry_series(telemetry: DataFrame, config: PipelineConfig) -> DataFrame:
    """Numbered series of telemetry that is already one row per machine and time."""
    return regular_series(telemetry, config)


@dataclass(frozen=True)
class Prepared:
    """Lazy results of ``prepare``; all of them share the series' shuffles."""

    series: DataFrame
    scaled: DataFrame
    windows: DataFrame
    scalers: DataFrame
    skipped: DataFrame
    features: list[str]
    targets: list[str]
    config: PipelineConfig

    def arrays(self, split: str | None = None) -> DataFrame:
        """Windows of one split (or all) as arrays: x in features, y in targets, scaled."""
        config, columns = self.config, list(dict.fromkeys([*self.features, *self.targets]))
        blocks = scaled_blocks(
            self.series, columns, config, config.sequence_length - 1, config.horizon, split
        )
        made = array_windows(blocks, self.features, self.targets, config)
        return made if split is None else made.filter(F.col("split") == split)


def prepare(telemetry: DataFrame, config: PipelineConfig) -> Prepared:
    """Resample, scale by the training rows, window and split all machines at once.

    Machines too short for a window keep their scalers if they have a training row.
    """
    features, targets, columns = select_features(numeric_columns(telemetry), config)
    series = regular_series(telemetry, config)
    scalers = fit_minmax(series, columns, config)
    scaled = scaled_blocks(series, columns, config, back=0, ahead=0, keep=["bin"]).drop("block")
    return Prepared(
        series=series,
        scaled=scaled,
        windows=sliding_windows(scaled, config),
        scalers=scalers,
        skipped=skipped_machines(series, config, telemetry.select("machine_id").distinct()),
        features=features,
        targets=targets,
        config=config,
    )


def latest_arrays(
    series: DataFrame, config: PipelineConfig, features: Sequence[str]
) -> DataFrame:
    """Latest window of each machine as ``x``, scaled; at most S rows per group."""
    scalers = fit_minmax(reject_short(series, config), features, config)
    latest = minmax_transform(latest_window(series, config), scalers, features, few_rows=True)
    ordered = F.sort_array(F.collect_list(F.struct("step", F.array(*features).alias("row"))))
    return latest.groupBy("machine_id").agg(
        F.transform(ordered, lambda entry: entry["row"]).alias("x")
    )


def forecast_fleet(
    series: DataFrame,
    config: PipelineConfig,
    features: Sequence[str],
    targets: Sequence[str],
    model: Forecaster | None = None,
) -> DataFrame:
    """Forecast of every machine in real units: machine_id, step from 0, targets."""
    model = model or MovingAverage(config.horizon)
    if isinstance(model, MovingAverage):
        return moving_average(latest_window(series, config), config, targets, model.window)
    scalers = fit_minmax(reject_short(series, config), targets, config)
    return _unscaled_forecast(latest_arrays(series, config, features), scalers, targets, model)


def forecast_stored(
    stored: DataFrame, scalers: DataFrame, targets: Sequence[str], model: Forecaster
) -> DataFrame:
    """Forecast of every machine from its stored windows ``x`` and scalers."""
    latest = latest_stored(stored).select("machine_id", "x")
    return _unscaled_forecast(latest, scalers, targets, model)


def _unscaled_forecast(
    latest: DataFrame, scalers: DataFrame, targets: Sequence[str], model: Forecaster
) -> DataFrame:
    scored = score(latest, model)
    long = scored.select("machine_id", F.posexplode("forecast").alias("step", "row")).select(
        "machine_id", "step", *[F.col("row")[i].alias(t) for i, t in enumerate(targets)]
    )
    return inverse_targets(long, scalers, targets, few_rows=True)


def forecast_with_history(
    series: DataFrame,
    config: PipelineConfig,
    features: Sequence[str],
    targets: Sequence[str],
    model: Forecaster | None = None,
) -> DataFrame:
    """History and forecast of every machine: ``kind``, ``step`` and real-unit values.

    History carries all features; a forecast carries the targets, the rest is NULL.
    """
    model = model or MovingAverage(config.horizon)
    if isinstance(model, MovingAverage):
        return _average_with_history(series, config, features, targets, model.window)
    past = latest_window(series, config).select(
        "machine_id", F.lit("history").alias("kind"), "step", *features
    )
    ahead = forecast_fleet(series, config, features, targets, model)
    values = [
        F.col(c) if c in targets else F.lit(None).cast("double").alias(c) for c in features
    ]
    return past.unionByName(
        ahead.select("machine_id", F.lit("forecast").alias("kind"), "step", *values)
    )


def _average_with_history(
    series: DataFrame,
    config: PipelineConfig,
    features: Sequence[str],
    targets: Sequence[str],
    window: int,
) -> DataFrame:
    """Moving-average points in one pass over the series.

    Only latest windows are shuffled, at most S rows per machine; the last row of each
    emits the forecast behind itself.
    """
    last = config.sequence_length - 1
    latest = latest_window(series, config).selectExpr(
        "machine_id",
        "step",
        *[f"`{c}`" for c in features],
        *[
            f"avg(CASE WHEN step > {last - window} THEN `{t}` END)"
            f" OVER (PARTITION BY machine_id) AS `{t}__mean`"
            for t in targets
        ],
    )
    emitted = latest.selectExpr(
        "*",
        f"explode(CASE WHEN step = {last} THEN sequence(-1, {config.horizon - 1})"
        " ELSE array(-1) END) AS ahead",
    )
    return emitted.selectExpr(
        "machine_id",
        "CASE WHEN ahead < 0 THEN 'history' ELSE 'forecast' END AS kind",
        "CASE WHEN ahead < 0 THEN step ELSE ahead END AS step",
        *[
            f"CASE WHEN ahead < 0 THEN `{c}` {f'ELSE `{c}__mean`' if c in targets else ''} END"
            f" AS `{c}`"
            for c in features
        ],
    )
