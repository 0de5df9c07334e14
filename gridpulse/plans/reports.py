"""Report queries for fleet views (survey J1-J4, J9-J13, C8-C10, D2).

Each report covers all machines in one job; filter the result for one machine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse import messages
from gridpulse.config import PipelineConfig
from gridpulse.functions.derive import (
    augment,
    jobs,
    power,
    risk_band,
    status,
    step_label,
    temperature,
    workload_distribution,
)
from gridpulse.operators.scale import fit_minmax, minmax_transform
from gridpulse.operators.windows import history, latest_window, reject_short
from gridpulse.plans.pipeline import forecast_with_history

# Forecast steps of the summary and the overload alert level.
SUMMARY_STEPS = (1, 3, 6, 12)
OVERLOAD_ALERT_ABOVE = 30.0


def known_machines(series: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested ids, each with whether the fleet has it."""
    fleet = series.filter(F.col("rn") == 0).select("machine_id", F.lit(True).alias("known"))
    return requested.join(fleet, "machine_id", "left").withColumn(
        "known", F.coalesce("known", F.lit(False))
    )


def require_machine(series: DataFrame, machine_id: str) -> DataFrame:
    """Series of one machine; an unknown id is an error."""
    one = series.filter(F.col("machine_id") == machine_id)
    if one.isEmpty():
        raise LookupError(messages.MACHINE_NOT_FOUND % machine_id)
    return one


def machine_states(
    series: DataFrame, config: PipelineConfig, machines: DataFrame | None = None
) -> DataFrame:
    """Latest state of every machine, in no order, for further aggregation.

    ``machines`` adds ids without any window; their values are NULL.
    """
    cpu = F.col("latest_cpu")
    last = latest_window(series, config).filter(F.col("step") == config.sequence_length - 1)
    latest = last.select(
        "machine_id",
        F.col("cpu_usage").alias("latest_cpu"),
        F.col("memory_usage").alias("latest_memory"),
        window_total(config).alias("num_windows"),
    )
    if machines is not None:
        ids = machines.select("machine_id").distinct()
        latest = ids.join(latest, "machine_id", "left")
    return latest.select(
        F.col("machine_id").cast("string").alias("id"),
        F.coalesce(F.col("num_windows"), F.lit(0)).alias("num_windows"),
        "latest_cpu",
        "latest_memory",
        temperature(cpu).alias("latest_temperature"),
        power(cpu).alias("latest_power"),
        jobs(cpu).alias("latest_jobs"),
        status(cpu).alias("status"),
    )


def machine_overview(
    series: DataFrame, config: PipelineConfig, machines: DataFrame | None = None
) -> DataFrame:
    """Latest state of every machine, ids as text in text order."""
    return machine_states(series, config, machines).orderBy("id")


def window_total(config: PipelineConfig) -> Column:
    """Number of test windows of the row's machine."""
    total = F.col("n") - (config.window_length - 1)
    train = F.floor(total * F.lit(float(config.train_ratio)))
    val = F.floor(total * F.lit(float(config.val_ratio)))
    return total - train - val


def cluster_average(states: DataFrame) -> DataFrame:
    """Mean latest cpu over the machines; 0.0 when there is none."""
    return states.agg(F.coalesce(F.avg("latest_cpu"), F.lit(0.0)).alias("avg_cluster_cpu"))


def workload(states: DataFrame) -> DataFrame:
    return workload_distribution(cluster_average(states))


def fleet_kpis(states: DataFrame, selected: str | None = None) -> DataFrame:
    """Cluster utilisation, total power and temperatures in one aggregate.

    ``selected_temperature`` is the selected machine's, 0 when there is none;
    ``avg_temperature`` is the mean over the fleet.
    """
    chosen = F.lit(False) if selected is None else F.col("id") == selected
    cpu, watts = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("latest_cpu", "latest_power"))
    return states.agg(
        F.coalesce(F.avg(cpu), F.lit(0.0)).alias("cluster_utilization"),
        (F.coalesce(F.sum(watts), F.lit(0.0)) / 1000.0).alias("total_power_kw"),
        F.coalesce(F.max(F.when(chosen, F.col("latest_temperature"))), F.lit(0.0)).alias(
            "selected_temperature"
        ),
        F.avg("latest_temperature").alias("avg_temperature"),
    )


def overload_risk(points: DataFrame) -> DataFrame:
    """Highest forecast cpu per machine, not below 0, and whether it is an alert."""
    ahead = points.filter(F.col("kind") == "forecast")
    peak = F.greatest(F.lit(0.0), F.max(F.coalesce(F.col("cpu_usage"), F.lit(0.0))))
    return ahead.groupBy("machine_id").agg(peak.alias("overload_pct")).withColumn(
        "alert", F.col("overload_pct") > OVERLOAD_ALERT_ABOVE
    )


def machine_history(
    series: DataFrame,
    config: PipelineConfig,
    features: Sequence[str],
    steps: int = 60,
    denormalized: bool = True,
) -> DataFrame:
    """Recent input rows, in real units with derived values, or scaled without them."""
    rows = history(series, config, steps).select("machine_id", "step", *features)
    if denormalized:
        return augment(rows)
    scalers = fit_minmax(reject_short(series, config), features, config)
    return minmax_transform(rows, scalers, features)


def machine_forecast(
    series: DataFrame,
    config: PipelineConfig,
    features: Sequence[str],
    targets: Sequence[str],
    model=None,
) -> DataFrame:
    """History and forecast points with derived operational values."""
    return augment(forecast_with_history(series, config, features, targets, model))


def as_points(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fold value columns into one map per point, leaving out missing values."""
    names = F.array(*[F.lit(c) for c in columns])
    values = F.map_from_arrays(names, F.array(*[F.col(c) for c in columns]))
    return df.select(
        *[c for c in df.columns if c not in columns],
        F.map_filter(values, lambda _, value: value.isNotNull()).alias("values"),
    )


def _zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0.0))


def _history_offset() -> Column:
    """Steps before now; windows are of one length, the largest step is now."""
    last = F.max("step").over(Window.partitionBy("machine_id"))
    return F.col("step") - last


def utilization_series(points: DataFrame) -> DataFrame:
    """Chart rows of cpu: history values, then the forecast joined by an anchor row.

    ``position`` orders the rows of a machine.
    """
    by_machine = "OVER (PARTITION BY machine_id)"
    placed = points.selectExpr(
        "machine_id",
        "kind = 'forecast' AS ahead",
        "coalesce(cpu_usage, 0D) AS cpu",
        # A machine has one window of history: its largest step is now.
        "CASE WHEN kind = 'forecast' THEN step + 1"
        f" ELSE step - max(CASE WHEN kind = 'history' THEN step END) {by_machine} END AS position",
        f"bool_or(kind = 'forecast') {by_machine} AS has_forecast",
    )
    rows = placed.selectExpr(
        "machine_id",
        "position",
        "cpu",
        "explode(CASE WHEN ahead THEN array(1)"
        " WHEN position = 0 AND has_forecast THEN array(0, 1) ELSE array(0) END) AS part",
    )
    return rows.select(
        "machine_id",
        "position",
        step_label(F.col("position")).alias("time"),
        F.expr("CASE WHEN part = 0 THEN cpu END").alias("value"),
        F.expr("CASE WHEN part = 1 THEN cpu END").alias("forecast"),
        "part",
    )


def memory_series(points: DataFrame) -> DataFrame:
    past = points.filter(F.col("kind") == "history").withColumn("offset", _history_offset())
    return past.select(
        "machine_id", F.col("offset").alias("position"), step_label(F.col("offset")).alias("time"),
        _zero("memory_usage").alias("value"),
    )


def multi_horizon(points: DataFrame) -> DataFrame:
    return points.filter(F.col("kind") == "forecast").select(
        "machine_id", (F.col("step") + 1).alias("position"),
        step_label(F.col("step") + 1).alias("time"),
        _zero("cpu_usage").alias("cpu_usage"), _zero("memory_usage").alias("memory_usage"),
    )


def forecast_summary(points: DataFrame) -> DataFrame:
    """Forecast cpu at the summary steps; a step beyond the horizon reads 0."""
    at = {step: F.max(F.when(F.col("step") == step - 1, F.col("cpu_usage"))) for step in SUMMARY_STEPS}
    entries = [
        F.struct(F.lit(step).alias("step"), F.col(f"cpu_{step}").alias("cpu"))
        for step in SUMMARY_STEPS
    ]
    return (
        points.filter(F.col("kind") == "forecast")
        .groupBy("machine_id")
        .agg(*[F.coalesce(cpu, F.lit(0.0)).alias(f"cpu_{step}") for step, cpu in at.items()])
        .select("machine_id", F.inline(F.array(*entries)))
        .select(
            "machine_id", "step", step_label(F.col("step")).alias("label"), "cpu",
            risk_band(F.col("cpu")).alias("band"),
        )
    )


def cluster_heatmap(states: DataFrame) -> DataFrame:
    cpu = _zero("latest_cpu")
    return states.select(
        "id",
        cpu.alias("cpu"),
        _zero("latest_memory").alias("memory"),
        F.coalesce(F.col("latest_jobs"), F.lit(0)).alias("jobs"),
        _zero("latest_temperature").alias("temperature"),
        _zero("latest_power").alias("power"),
        F.upper(status(cpu)).alias("band"),
    )
