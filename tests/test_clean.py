"""Cleaning, schema resolution and the scalar functions."""

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from gridpulse.config import PipelineConfig
from gridpulse.functions import derive
from gridpulse.functions.columns import round_nearest, to_number
from gridpulse.operators import clean, rollup

USAGE = (
    "start_time bigint, machine_id string, collection_id bigint, avg_cpu double, "
    "avg_memory double, max_cpu double, max_memory double, assigned_memory double, "
    "cycles_per_instruction double, sample_rate double"
)


def usage(spark, *rows):
    return spark.createDataFrame(list(rows), USAGE)


def row(start=0, machine="1", job=1, cpu=0.5, memory=0.25, assigned=0.1):
    return (start, machine, job, cpu, memory, cpu, memory, assigned, 1.5, 1.0)


def test_clean_usage_scales_clips_and_drops(spark):
    cleaned = clean.clean_usage(
        usage(
            spark,
            row(cpu=1.7), row(cpu=-0.2), row(cpu=None), row(memory=None), row(machine=None),
            row(cpu=float("nan")),
        )
    )
    assert cleaned.columns == list(clean.KEPT_COLUMNS)
    assert sorted(r.cpu_usage for r in cleaned.collect()) == [0.0, 100.0]


def test_timestamp_counts_microseconds_from_the_epoch(spark):
    decoded = clean.decode_timestamp(usage(spark, row(start=300_000_000), row(start=None)))
    assert [r.timestamp for r in decoded.orderBy("start_time").collect()] == [
        None, dt.datetime(1970, 1, 1, 0, 5),
    ]


def test_sort_puts_missing_times_last(spark):
    cleaned = clean.clean_usage(usage(spark, row(start=None), row(start=9), row(start=3)))
    times = [r.timestamp for r in clean.sort_by_time(cleaned).collect()]
    assert times[2] is None and times[0] < times[1]


def test_profile(spark):
    cleaned = clean.clean_usage(usage(spark, row(start=0), row(start=5, machine="2")))
    got = clean.profile(cleaned).first()
    assert (got.row_count, got.machine_count) == (2, 2)


def test_rollup_sums_instances_and_counts_jobs(spark):
    cleaned = clean.clean_usage(
        usage(
            spark,
            row(job=1, cpu=0.7), row(job=1, cpu=0.6), row(job=2, cpu=0.1),
            row(start=9, job=3, assigned=None), row(start=None),
        )
    )
    rolled = rollup.rollup_machine(cleaned).orderBy("timestamp").collect()
    assert len(rolled) == 2
    assert rolled[0].cpu_usage == pytest.approx(140.0)
    assert rolled[0].max_cpu_usage == 70.0
    assert rolled[0].running_jobs_count == 2
    assert rolled[1].assigned_memory == 0.0
    clipped = rollup.clip_rollup(rollup.rollup_machine(cleaned)).orderBy("timestamp").first()
    assert clipped.cpu_usage == 100.0
    assert "running_jobs_count" not in rollup.rollup_machine(cleaned, count_jobs=False).columns


def test_top_machines_breaks_ties_by_id(spark):
    rows = [row(start=i, machine=m) for m in ("10", "2", "3") for i in range(2 if m == "3" else 4)]
    cleaned = clean.clean_usage(usage(spark, *rows))
    rolled = rollup.rollup_machine(cleaned)
    assert [r.machine_id for r in rollup.top_machines(rolled, 2).collect()] == ["10", "2"]
    assert rollup.restrict_to(rolled, 1).select("machine_id").distinct().first()[0] == "10"


def test_required_columns_are_named(spark):
    df = spark.createDataFrame([(1.0,)], "cpu_usage double")
    with pytest.raises(ValueError, match="memory_usage"):
        clean.require_columns(df)


@pytest.mark.parametrize(
    "text,number",
    [
        (" 12.5 ", 12.5), ("1e3", 1000.0), ("-.5", -0.5), ("7.", 7.0), ("abc", None), (" ", None),
        ("1d", None), ("NaN", None), ("", None), (None, None),
    ],
)
def test_number_text(spark, text, number):
    df = spark.createDataFrame([(text,)], "t string").select(to_number(F.col("t")).alias("n"))
    assert df.first().n == number


def test_resolve_features_pads_trims_and_warns(spark):
    config = PipelineConfig()
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "memory_usage double, cpu_usage double, extra double")
    same, names, warnings = clean.resolve_features(df, config, None)
    assert (names, warnings) == (["cpu_usage", "memory_usage"], [])
    padded, names, warnings = clean.resolve_features(df, config, 3)
    assert names == ["cpu_usage", "memory_usage", "assigned_memory"]
    assert padded.first().assigned_memory == 0.0
    assert warnings == ["Column 'assigned_memory' missing; filled with 0."]
    four, names, warnings = clean.resolve_features(padded, config, 2)
    assert names == ["cpu_usage", "memory_usage"]
    assert warnings == ["Model expects 2 features; ignoring extras: ['assigned_memory']."]


def test_select_features():
    config = PipelineConfig()
    assert clean.select_features(["memory_usage", "cpu_usage", "x"], config) == (
        ["cpu_usage", "memory_usage"], ["cpu_usage", "memory_usage"], ["cpu_usage", "memory_usage"],
    )
    with pytest.raises(ValueError):
        clean.select_features(["x"], config)


def test_interval_must_divide_a_day():
    with pytest.raises(ValueError):
        PipelineConfig(interval_seconds=420)


@pytest.mark.parametrize("digits", [1, 4])
def test_rounding_follows_the_binary_value(spark, digits):
    values = [2.25, 0.35, 2.45, 446.04999999999995, 0.05, -0.25, 44.65, 1e9 + 0.25, 38.37875, 0.03125]
    values += [i * 0.4 + 40 for i in range(500)] + [80 + i * 0.01 * 2.5 for i in range(2000)]
    values += [-i * 0.00005 for i in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", round_nearest(F.col("v"), digits).alias("r")).collect()
    assert all(r.r == round(r.v, digits) for r in got)
    away = df.select("v", round_nearest(F.col("v"), digits, ties_to_even=False).alias("r"))
    for r in away.collect():
        exact = Decimal(r.v).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)
        assert r.r == float(exact)


def test_derived_values(spark):
    cpus = [-1.0, 0.0, 24.9, 25.0, 30.0, 30.1, 60.0, 60.1, 80.0, 80.1, 99.9, 100.0, 300.0, None]
    df = spark.createDataFrame([(c,) for c in cpus], "cpu double")
    cpu = F.col("cpu")
    got = df.select(
        "cpu", derive.jobs(cpu).alias("jobs"), derive.status(cpu).alias("status"),
        derive.risk_band(cpu).alias("band"), derive.temperature(cpu).alias("t"),
    ).collect()
    for r in got:
        if r.cpu is None:
            assert (r.jobs, r.status, r.band, r.t) == (None, None, None, None)
            continue
        assert r.jobs == int(min(10, max(0, r.cpu / 25)))
        assert r.t == round(40 + 0.4 * r.cpu, 1)
        expected = [s for s, above in (("high", 80), ("medium", 60), ("normal", 30)) if r.cpu > above]
        assert r.status == (expected + ["low"])[0]
        assert r.band == ("danger" if r.cpu > 80 else "warn" if r.cpu > 60 else "ok")


def test_step_labels(spark):
    df = spark.createDataFrame([(0,), (1,), (-2,)], "o int")
    assert [r[0] for r in df.select(derive.step_label(F.col("o"))).collect()] == ["now", "+5m", "-10m"]


def test_workload_sums_to_100(spark):
    averages = spark.createDataFrame([(v,) for v in (0.0, 12.34, 50.0, 99.9, 150.0)], "avg_cluster_cpu double")
    got = derive.workload_distribution(averages).groupBy("avg_cluster_cpu").agg(F.sum("percent").alias("p"))
    assert all(r.p == pytest.approx(100.0, abs=0.5) for r in got.collect())
    assert derive.workload_distribution(averages).count() == 20


def test_augment_needs_cpu(spark):
    df = spark.createDataFrame([(1.0,)], "memory_usage double")
    assert derive.augment(df).columns == ["memory_usage"]
