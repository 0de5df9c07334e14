"""Per-machine rollup and machine selection (survey C1-C4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.functions.columns import clip, present

# How each usage column is rolled up over the instances of a machine.
SUMMED = ("cpu_usage", "memory_usage", "assigned_memory")
MAXIMA = ("max_cpu_usage", "max_memory_usage")
JOB_COLUMN, JOB_COUNT = "collection_id", "running_jobs_count"


def rollup_machine(usage: DataFrame, count_jobs: bool = True) -> DataFrame:
    """One row per (timestamp, machine).

    The key holds the timestamp, so a busy machine spreads over many reducers, and
    partial aggregation merges its rows before the shuffle. ``count_jobs=False``
    leaves out the distinct job count, and with it the extra shuffle a distinct
    aggregate costs, for callers that only follow the usage columns.
    """
    aggregates = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in present(usage, SUMMED)]
    aggregates += [F.max(c).alias(c) for c in present(usage, MAXIMA)]
    if count_jobs and JOB_COLUMN in usage.columns:
        aggregates.append(F.countDistinct(JOB_COLUMN).alias(JOB_COUNT))
    return (
        usage.filter(F.col("timestamp").isNotNull() & F.col("machine_id").isNotNull())
        .groupBy("timestamp", "machine_id")
        .agg(*aggregates)
    )


def clip_rollup(rolled: DataFrame) -> DataFrame:
    """Limit the summed percentages to 0-100."""
    return rolled.withColumns(
        {c: clip(F.col(c), 0.0, 100.0) for c in present(rolled, ("cpu_usage", "memory_usage"))}
    )


def top_machines(rolled: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` machines with most records; ties go to the smaller id."""
    return (
        rolled.groupBy("machine_id")
        .agg(F.count(F.lit(1)).alias("record_count"))
        .orderBy(F.desc("record_count"), F.asc("machine_id"))
        .limit(n)
    )


def restrict_to(rolled: DataFrame, n: int = 8) -> DataFrame:
    """Rows of the ``n`` busiest machines; ties go to the smaller id.

    The ranking sums up whole rows, so it needs the same columns as the result and both read
    one rollup: without the checksum the optimizer would compute a narrower one for it. The
    optimizer picks the join by the measured size of the list.
    """
    ranked = rolled.groupBy("machine_id").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.max(F.xxhash64(*rolled.columns)).alias("checksum"),
    )
    top = ranked.orderBy(F.desc("record_count"), F.asc("machine_id"), "checksum").limit(n)
    # An inner join: a semi join would be moved below the rollup, to a second scan.
    return rolled.join(top.select("machine_id"), "machine_id").select(*rolled.columns)
