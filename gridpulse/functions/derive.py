"""Operational values derived from cpu utilisation (percent).

All functions give NULL for a missing input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.functions.columns import clip, round_tenth

# Coefficients and bands of the derived metrics.
TEMPERATURE_BASE, TEMPERATURE_PER_CPU = 40.0, 0.4
POWER_BASE, POWER_PER_CPU = 80.0, 2.5
CPU_PER_JOB, MAX_JOBS = 25.0, 10.0
HIGH_ABOVE, MEDIUM_ABOVE, NORMAL_ABOVE = 80.0, 60.0, 30.0
WORKLOAD_SHARES = (("Training", 55.0), ("Inference", 25.0), ("Data Proc", 15.0))
IDLE_NAME = "Idle"
MINUTES_PER_STEP = 5


def temperature(cpu: Column) -> Column:
    return round_tenth(F.lit(TEMPERATURE_BASE) + cpu * TEMPERATURE_PER_CPU)


def power(cpu: Column) -> Column:
    return round_tenth(F.lit(POWER_BASE) + cpu * POWER_PER_CPU)


def jobs(cpu: Column) -> Column:
    return clip(cpu / CPU_PER_JOB, 0.0, MAX_JOBS).cast("int")


def _band(cpu: Column, *levels: tuple[float, str], otherwise: str) -> Column:
    column = F.when(cpu.isNull(), F.lit(None).cast("string"))
    for above, name in levels:
        column = column.when(cpu > above, name)
    return column.otherwise(otherwise)


def status(cpu: Column) -> Column:
    return _band(
        cpu, (HIGH_ABOVE, "high"), (MEDIUM_ABOVE, "medium"), (NORMAL_ABOVE, "normal"),
        otherwise="low",
    )


def risk_band(cpu: Column) -> Column:
    return _band(cpu, (HIGH_ABOVE, "danger"), (MEDIUM_ABOVE, "warn"), otherwise="ok")


def step_label(offset: Column) -> Column:
    """Text for an offset in steps from now: ``now``, ``+5m``, ``-10m``."""
    minutes = offset * MINUTES_PER_STEP
    return (
        F.when(minutes == 0, "now")
        .when(minutes > 0, F.concat(F.lit("+"), minutes.cast("string"), F.lit("m")))
        .when(minutes < 0, F.concat(minutes.cast("string"), F.lit("m")))
    )


def workload_distribution(averages: DataFrame, avg_column: str = "avg_cluster_cpu") -> DataFrame:
    """Split each average utilisation into workload categories that sum to 100."""
    activity = clip(F.col(avg_column) / 100.0, 0.0, 1.0)
    shares = {name: round_tenth(activity * share) for name, share in WORKLOAD_SHARES}
    rest = F.lit(100.0)
    for name in shares:
        rest = rest - F.col(name)
    # Step by step: each column is used several times by the next.
    staged = (
        averages.withColumns(shares)
        .withColumn("rest", F.greatest(F.lit(0.0), rest))
        .withColumn(IDLE_NAME, round_tenth(F.col("rest")))
    )
    entries = [
        F.struct(F.lit(name).alias("name"), F.col(name).alias("percent"))
        for name in (*shares, IDLE_NAME)
    ]
    return staged.select(
        round_tenth(F.col(avg_column)).alias("avg_cluster_cpu"), F.inline(F.array(*entries))
    )


def augment(df: DataFrame) -> DataFrame:
    """Add temperature, power draw and job count when cpu is there."""
    if "cpu_usage" not in df.columns:
        return df
    cpu = F.col("cpu_usage")
    return df.withColumns(
        {
            "temperature": temperature(cpu),
            "power_draw": power(cpu),
            "jobs_count": jobs(cpu).cast("double"),
        }
    )
