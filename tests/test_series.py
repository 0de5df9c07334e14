"""Resampling, gap filling, windows and splits, against pandas and by hand."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridpulse import messages
from gridpulse.config import PipelineConfig
from gridpulse.operators import resample, scale, windows
from gridpulse.plans import pipeline

SMALL = PipelineConfig(sequence_length=30, horizon=6, block_rows=40)


def filled(df, config=SMALL):
    return resample.regular_series(df, config)


def bins_of(df):
    return [r.rn for r in df.orderBy("rn").collect()]


def test_gap_of_three_is_filled_of_four_is_not(regular):
    points = [("a", t, 1.0, 1.0) for t in (0, 4, 9)]
    got = filled(regular(points)).orderBy("bin_no").toPandas()
    start = got.bin_no.min()
    assert (got.bin_no - start).tolist() == [0, 1, 2, 3, 4, 5, 6, 7, 9]
    assert got.rn.tolist() == list(range(9)) and set(got.n) == {9}


def test_one_missing_column_drops_the_bin_after_the_limit(regular):
    points = [("a", t, 1.0 * t, 5.0 if t == 0 else None) for t in range(6)]
    got = filled(regular(points)).orderBy("rn").toPandas()
    assert got.cpu_usage.tolist() == [0.0, 1.0, 2.0, 3.0]
    assert set(got["memory_usage"]) == {5.0}


def test_mean_ignores_missing_values(regular, spark):
    df = regular([("a", 0, 1.0, 1.0), ("a", 0, None, 3.0), ("a", 0, 5.0, None)])
    got = resample.resample_mean(df, SMALL).first()
    assert (got.cpu_usage, got.memory_usage) == (3.0, 2.0)


def _random_points(seed, machines=4, count=300):
    rng = random.Random(seed)
    points = []
    for m in range(machines):
        at = rng.randrange(0, 90)
        for _ in range(count):
            at += rng.choice([1, 1, 1, 2, 3, 4, 5, 6, 45, 300])
            values = [rng.gauss(0, 1) if rng.random() > 0.2 else None for _ in range(2)]
            points.append((f"m{m}", at, *values))
    return points


@pytest.mark.parametrize("block_rows", [37, 64, 4000])
def test_gap_filling_equals_pandas_for_any_block_size(regular, block_rows):
    config = PipelineConfig(sequence_length=30, horizon=6, block_rows=block_rows)
    points = _random_points(block_rows)
    got = filled(regular(points), config).toPandas().sort_values(["machine_id", "bin"])
    frames = []
    raw = pd.DataFrame(points, columns=["machine_id", "at", "cpu_usage", "memory_usage"])
    raw["bin"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(raw["at"] * 5, unit="min")
    for machine, group in raw.groupby("machine_id"):
        series = group.set_index("bin")[["cpu_usage", "memory_usage"]].astype(float)
        series = series.resample("5min").mean().ffill(limit=3).dropna().reset_index()
        frames.append(series.assign(machine_id=machine, rn=range(len(series)), n=len(series)))
    expected = pd.concat(frames)
    for c in ("machine_id", "bin", "cpu_usage", "memory_usage", "rn", "n"):
        assert got[c].tolist() == expected[c].tolist(), c


def test_spine_and_fill_keep_empty_bins(regular):
    bins = resample.resample_mean(regular([("a", 0, 1.0, 1.0), ("a", 100, 2.0, 2.0)]), SMALL)
    assert resample.gap_spine(bins, SMALL).count() == 101
    reached = resample.forward_fill(bins, SMALL).orderBy("bin_no").toPandas()
    assert (reached.bin_no - reached.bin_no.min()).tolist() == [0, 1, 2, 3, 100]


def _ramp(machine, n):
    return [(machine, t, float(t), float(t % 7)) for t in range(n)]


def test_window_counts_and_splits(regular):
    config = PipelineConfig(sequence_length=30, horizon=6, block_rows=100)
    made = windows.sliding_windows(filled(regular(_ramp("a", 500)), config), config)
    counts = {r.split: r["count"] for r in made.groupBy("split").count().collect()}
    assert counts == {"train": 325, "val": 69, "test": 71}
    assert [r.window_idx for r in made.orderBy("rn").collect()] == list(range(465))
    order = made.groupBy("split").agg(F.min("window_idx").alias("a"), F.max("window_idx").alias("b"))
    spans = {r.split: (r.a, r.b) for r in order.collect()}
    assert spans == {"train": (0, 324), "val": (325, 393), "test": (394, 464)}
    same = windows.window_counts(filled(regular(_ramp("a", 500)), config), config).first()
    assert (same.train_windows, same.val_windows, same.test_windows) == (325, 69, 71)


def test_short_series_are_skipped_with_a_reason(regular):
    config = PipelineConfig()
    df = regular(_ramp("short", 71) + _ramp("exact", 72) + [("empty", 0, 1.0, None)])
    ready = pipeline.prepare(df, config)
    rows = ready.windows.collect()
    assert [(r.machine_id, r.window_idx, r.split) for r in rows] == [("exact", 0, "test")]
    skipped = {r.machine_id: r.n for r in ready.skipped.collect()}
    assert skipped == {"short": 71, "empty": 0}
    # A machine too short for a window keeps its scaler; one without training rows has none.
    assert {r.machine_id for r in ready.scalers.collect()} == {"exact", "short"}


def test_training_prefix_uses_double_arithmetic(regular):
    series = filled(regular(_ramp("a", 90)), PipelineConfig())
    assert scale.training_rows(series, PipelineConfig()).count() == int(90 * 0.7) == 62


def test_latest_window_ends_a_horizon_early(regular):
    config = PipelineConfig()
    series = filled(regular(_ramp("a", 100)), config)
    latest = windows.latest_window(series, config).orderBy("step").toPandas()
    assert latest.step.tolist() == list(range(60))
    assert latest.cpu_usage.tolist() == [float(v) for v in range(28, 88)]
    recent = windows.history(series, config, steps=5).orderBy("step").toPandas()
    assert recent.step.tolist() == list(range(5)) and recent.cpu_usage.tolist()[-1] == 87.0
    assert windows.history(series, config, steps=1000).count() == 60
    for steps in (0, 1001):
        with pytest.raises(ValueError):
            windows.history(series, config, steps=steps)


@pytest.mark.parametrize("split", [None, "train", "val", "test"])
def test_array_windows_hold_the_right_rows(regular, split):
    config = PipelineConfig(sequence_length=6, horizon=3, block_rows=11)
    series = filled(regular(_ramp("a", 60) + _ramp("b", 37)), config)
    blocks = windows.raw_blocks(
        series, ["cpu_usage", "memory_usage"], config, back=5, ahead=3, split=split
    )
    made = windows.array_windows(blocks, ["cpu_usage", "memory_usage"], ["cpu_usage"], config)
    if split:
        made = made.filter(F.col("split") == split)
    for r in made.collect():
        i = r.window_idx
        assert r.x == [[float(t), float(t % 7)] for t in range(i, i + 6)]
        assert r.y == [[float(t)] for t in range(i + 6, i + 9)]
    expected = {"train": 36 + 20, "val": 7 + 4, "test": 9 + 5}
    assert made.count() == (expected[split] if split else 52 + 29)


def test_scaling_round_trip_constant_and_unknown_machine(spark):
    config = PipelineConfig(sequence_length=2, horizon=1)
    rows = [("a", i, 10, float(i), 5.0) for i in range(10)]
    series = spark.createDataFrame(rows, "machine_id string, rn long, n long, x double, c double")
    scalers = scale.fit_minmax(series, ["x", "c"], config)
    bounds = {r.column: (r.data_min, r.data_max) for r in scalers.collect()}
    assert bounds == {"x": (0.0, 6.0), "c": (5.0, 5.0)}
    scaled = scale.minmax_transform(series, scalers, ["x", "c"])
    assert [r.x for r in scaled.orderBy("rn").collect()][-1] == 1.5  # not clipped
    assert {r.c for r in scaled.collect()} == {0.0}
    back = scale.inverse_features(scaled, scalers, ["x", "c"]).orderBy("rn").collect()
    assert [r.x for r in back] == pytest.approx([float(i) for i in range(10)])
    assert {r.unscaled_warning for r in back} == {None}
    other = scale.inverse_features(scaled.withColumn("machine_id", F.lit("z")), scalers, ["x"])
    assert "No scaler" in other.first().unscaled_warning
    assert scale.constant_columns(scalers).first().warning == messages.CONSTANT_COLUMNS
    same, warnings = scale.inverse_upload(scaled, scalers, ["c"], ["x"])
    assert same is scaled and warnings == [messages.TARGETS_NOT_FEATURES]


def test_blocks_scale_like_the_plain_join(regular):
    config = PipelineConfig(sequence_length=30, horizon=6, block_rows=37)
    series = filled(regular(_random_points(5)), config)
    usable = windows.reject_short(series, config)
    scalers = scale.fit_minmax(usable, ["cpu_usage", "memory_usage"], config)
    plain = scale.minmax_transform(usable, scalers, ["cpu_usage", "memory_usage"])
    blocks = windows.scaled_blocks(series, ["cpu_usage", "memory_usage"], config, 0, 0)
    key = ["machine_id", "rn", "cpu_usage", "memory_usage"]
    assert sorted(map(tuple, blocks.select(key).collect())) == sorted(
        map(tuple, plain.select(key).collect())
    )


@pytest.mark.parametrize("block", [10, 13, 4000])
@pytest.mark.parametrize("max_gap", [0, 2, 10_000])
def test_windows_stop_at_long_gaps(spark, regular, block, max_gap):
    config = PipelineConfig(sequence_length=4, horizon=2, ffill_limit=0, block_rows=block)
    at = [0, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 14, 15, 16, 17, 18, 19, 20, 500, 501, 502, 503, 504, 505, 506, 900]
    points = [("a", i, 1.0, 2.0) for i in at] + [("b", i, 1.0, 2.0) for i in range(30)]
    series = resample.regular_series(regular(points), config)
    got = windows.windows_within_gaps(series, config, max_gap).collect()
    expected = [
        k for k in range(3, len(at) - 2)
        if all(at[j + 1] - at[j] - 1 <= max_gap for j in range(k - 3, k + 2))
    ]
    rows = sorted((r.window_idx, r.rn, r.split) for r in got if r.machine_id == "a")
    assert [rn for _, rn, _ in rows] == expected
    assert [i for i, _, _ in rows] == list(range(len(expected)))
    train, val = int(len(expected) * 0.7), int(len(expected) * 0.15)
    assert [s for _, _, s in rows] == ["train"] * train + ["val"] * val + ["test"] * (len(expected) - train - val)
    whole = windows.sliding_windows(series, config).filter("machine_id = 'b'").collect()
    key = lambda r: (r.window_idx, r.rn, r.split)
    assert sorted(map(key, whole)) == sorted(key(r) for r in got if r.machine_id == "b")
