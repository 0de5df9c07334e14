"""Files in and out."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridpulse.config import PipelineConfig
from gridpulse.operators import forecast, resample, rollup, windows
from gridpulse.plans import models
from gridpulse.sources import tables, usage


def _line(start, machine, cpu="0.5", memory="0.25", assigned="0.1"):
    return f"{start},9,7,0,{machine},,{cpu},{memory},0.6,0.3,,,{assigned},1.2,,1.0"


def test_shards_plain_and_gzip_with_missing_words(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join([_line(1, "5"), _line(2, "5", cpu=" "), _line(" ", "6")]))
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("\n".join([_line(3, "null", memory="NaN"), _line(4, " 7 ", assigned="abc")]))
    df = usage.read_usage(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv.gz")])
    assert df.columns == [name for name, _ in usage.USAGE_COLUMNS]
    rows = sorted(df.collect(), key=lambda r: (r.start_time or 99))
    assert [r.start_time for r in rows] == [1, 2, 3, 4, None]
    assert [r.avg_cpu for r in rows] == [0.5, None, 0.5, 0.5, 0.5]
    assert [r.avg_memory for r in rows] == [0.25, 0.25, None, 0.25, 0.25]
    assert [r.machine_id for r in rows] == ["5", "5", None, "7", "6"]
    assert rows[3].assigned_memory is None and rows[0].alloc_collection_id is None


def test_unreadable_shard_is_skipped(spark, tmp_path):
    (tmp_path / "good.csv").write_text(_line(1, "5"))
    (tmp_path / "bad.csv.gz").write_bytes(b"\x1f\x8b this is no gzip stream")
    assert usage.read_usage(spark, str(tmp_path)).count() == 1


def test_no_shards_is_an_error(spark):
    with pytest.raises(FileNotFoundError):
        usage.read_usage(spark, [])


@pytest.mark.parametrize("split_bytes", [None, 2000])
def test_limit_keeps_the_first_rows_of_each_file(spark, tmp_path, split_bytes):
    for name, count in (("a", 300), ("b", 40), ("c", 3)):
        lines = [_line(i, name) for i in range(count)]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines))
    if split_bytes:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
        spark.conf.set("spark.sql.files.openCostInBytes", 100)
    try:
        df = usage.read_usage(spark, str(tmp_path), limit_per_file=70)
        got = df.groupBy("machine_id").agg(F.count("*").alias("n"), F.max("start_time").alias("last"))
        assert {r.machine_id: (r.n, r["last"]) for r in got.collect()} == {
            "a": (70, 69), "b": (40, 39), "c": (3, 2),
        }
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_telemetry_keeps_file_order(spark, tmp_path):
    lines = ["machine_id,cpu_usage,memory_usage"] + [f"m,{i},{i}" for i in range(2000)]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 3000)
    spark.conf.set("spark.sql.files.openCostInBytes", 100)
    try:
        df = usage.read_telemetry_csv(spark, str(tmp_path / "t.csv"))
        assert df.rdd.getNumPartitions() > 2
        values = [int(r.cpu_usage) for r in df.orderBy("row_order").collect()]
        assert values == list(range(2000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_empty_telemetry_is_an_error(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError):
        usage.read_telemetry_csv(spark, str(tmp_path / "empty.csv"))


def test_windows_are_pruned_by_split_and_machine(spark, tmp_path):
    rows = [(m, i, s, float(i)) for m in ("a", "b") for i, s in enumerate(("train", "val", "test"))]
    made = spark.createDataFrame(rows, "machine_id string, window_idx long, split string, v double")
    path = str(tmp_path / "w")
    tables.write_windows(made, path)
    assert tables.read_windows(spark, path).count() == 6
    one = tables.read_windows(spark, path, "val", ["b"])
    assert [(r.machine_id, r.window_idx) for r in one.collect()] == [("b", 1)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "EqualTo(machine_id,b)" in plan
    with pytest.raises(ValueError):
        tables.read_windows(spark, path, "other")


def test_sidecar_documents(spark, tmp_path):
    (tmp_path / "lin_best_metrics.json").write_text("{}")
    document = {
        "overall": {"mae": 0.1, "rmse": 0.2, "mape": 5.0},
        "per_target": {"cpu_usage": {"mae": 0.1, "rmse": 0.2, "mape": 5.0},
                       "memory_usage": {"mae": 0.3, "rmse": 0.4, "mape": 6.0}},
        "per_horizon": [{"step": 1, "mae": 0.1, "rmse": 0.2}, {"step": 2, "mae": 0.2, "rmse": 0.3}],
        "overload": {"cpu_usage": {"precision": 1.0, "recall": 0.5, "f1": 0.6667, "accuracy": 0.9,
                                   "total_overload_events": 4, "predicted_overload_events": 2}},
    }
    (tmp_path / "lin_metrics.json").write_text(json.dumps(document, indent=1))
    metrics = tables.read_metrics_json(spark, str(tmp_path / "*_metrics.json"))
    rows = {(r.scope, r.target, r.step): r for r in metrics.collect()}
    assert len(rows) == 5 and {r.model for r in rows.values()} == {"lin"}
    assert rows["per_target", "cpu_usage", None].total_overload_events == 4
    assert rows["per_target", "memory_usage", None].precision is None
    assert rows["per_horizon", None, 2].rmse == 0.3

    curve = {"train_loss": [0.123456, 0.1, 0.05], "val_loss": [0.2, 0.15], "lr": [0.001] * 3}
    (tmp_path / "lin_history.json").write_text(json.dumps(curve))
    history = tables.read_history(spark, str(tmp_path / "*_history.json"))
    assert history.first().name == "lin"
    shown = [(r.epoch, r.train, r.val) for r in models.training_history(history).orderBy("epoch").collect()]
    assert shown == [(1, 0.1235, 0.2), (2, 0.1, 0.15), (3, 0.05, 0.0)]

    loaded = models.models_table(spark, [forecast.MovingAverage()])
    listed = {r.name: r for r in models.list_models(loaded, metrics).collect()}
    assert not listed["lin"].invokable and listed["lin"].has_metrics and listed["lin"].config == {}
    assert listed["moving_avg_12"].invokable and not listed["moving_avg_12"].has_metrics
    compared = {r.name: r.mae for r in models.compare_models(loaded, metrics).collect()}
    assert compared == {"lin": 0.1, "moving_avg_12": None}
    flags = {r.name: (r.loaded, r.has_metrics, r.has_history)
             for r in models.model_sidecars(loaded, metrics, history).collect()}
    assert flags == {"lin": (False, True, True), "moving_avg_12": (True, False, False)}
    assert models.model_metrics(loaded, metrics, "moving_avg_12").count() == 0
    assert models.model_metrics(loaded, metrics, "lin").count() == 5
    with pytest.raises(forecast.UnknownModelError):
        models.model_metrics(loaded, metrics, "nobody")


def test_metrics_of_an_absent_model_are_no_rows(spark, tmp_path):
    rows = [("m", "overall", None, None, 0.1, 0.2, 3.0, None, None, None, None, None, None)]
    schema = "model string, scope string, target string, step int, mae double, rmse double, mape double, precision double, recall double, f1 double, accuracy double, total_overload_events long, predicted_overload_events long"
    path = str(tmp_path / "metrics")
    tables.write_metrics(spark.createDataFrame(rows, schema), path)
    assert tables.read_metrics(spark, path, "m").first().mae == 0.1
    assert tables.read_metrics(spark, path, "other").count() == 0


def test_models_round_trip(spark, tmp_path):
    linear = forecast.Linear(2, 1, 3, 2, np.arange(12.0).reshape(6, 2), np.array([1.0, 2.0]))
    path = str(tmp_path / "models")
    tables.write_models(spark, [forecast.MovingAverage(window=4), linear], path)
    back = tables.read_models(spark, path)
    assert list(back) == ["linear_baseline", "moving_avg_4"]
    assert np.array_equal(back["linear_baseline"].weights, linear.weights)
    assert back["moving_avg_4"] == forecast.MovingAverage(window=4)


def test_inventory_lists_names_or_nothing(spark):
    loaded = models.models_table(spark, [forecast.MovingAverage()])
    machines = spark.createDataFrame([("10",), ("2",)], "machine_id string")
    got = [(r.kind, r.name) for r in models.inventory(loaded, machines).collect()]
    assert got == [("machine", "10"), ("machine", "2"), ("model", "moving_avg_12")]
    assert models.inventory(loaded.filter("false"), machines.filter("false")).count() == 0


def _lines(count, start=0):
    return "".join(f"{i},,{i},{i},m,,0.5,0.5,,,,,,,,\n" for i in range(start, start + count))


def _starts(df):
    return sorted(r["start_time"] for r in df.select("start_time").collect())


@pytest.mark.parametrize("limit", [1, 700, 1500, 2999, 3000, 10_000])
def test_limit_per_file_over_several_splits(spark, tmp_path, limit):
    (tmp_path / "a.csv").write_text(_lines(3000))
    (tmp_path / "b.csv").write_text(_lines(40, 100_000))
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write(_lines(2000, 200_000))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        df = usage.read_usage(spark, str(tmp_path / "*"), limit_per_file=limit)
        assert df.rdd.getNumPartitions() > 5
        expected = [*range(min(limit, 3000)), *range(100_000, 100_000 + min(limit, 40)),
                    *range(200_000, 200_000 + min(limit, 2000))]
        assert _starts(df) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_limit_per_file_moves_no_data_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text(_lines(30))
    df = usage.read_usage(spark, str(tmp_path / "a.csv"), limit_per_file=500_000)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    joined = next(i for i, line in enumerate(plan.splitlines()) if "BroadcastHashJoin" in line)
    # Everything that is exchanged stands below the join's broadcast side.
    stream = [x for x in plan.splitlines()[joined + 1 :] if "Scan csv" in x or "Exchange" in x]
    assert sum("Scan csv" in x for x in stream) == 2
    assert "machine_id" not in "".join(x for x in stream if "Exchange" in x)


@pytest.mark.parametrize("damage", ["cut", "flipped", "no header"])
def test_a_damaged_gzip_shard_gives_no_row(spark, tmp_path, damage):
    (tmp_path / "good.csv").write_text(_lines(5))
    data = bytearray(gzip.compress(_lines(50_000, 1000).encode(), 1))
    if damage == "cut":
        data = data[: len(data) * 3 // 4]
    elif damage == "flipped":
        data[-6] ^= 1  # in the checksum, so that all rows come before the damage is seen
    else:
        data = b"plain text"
    (tmp_path / "bad.csv.gz").write_bytes(data)
    (tmp_path / "two.csv.gz").write_bytes(gzip.compress(_lines(3, 10).encode()) + gzip.compress(_lines(4, 20).encode()))
    shards = usage.read_shards(spark, str(tmp_path / "*"))
    assert _starts(shards.usage) == [*range(5), 10, 11, 12, 20, 21, 22, 23]
    ledger = {r["shard"].rsplit("/", 1)[1]: r for r in shards.ledger.collect()}
    assert ledger["good.csv"]["rows_read"] == 5 and ledger["good.csv"]["reason"] is None
    assert ledger["two.csv.gz"]["rows_read"] == 7 and ledger["two.csv.gz"]["reason"] is None
    assert ledger["bad.csv.gz"]["rows_read"] == 0 and "gzip data" in ledger["bad.csv.gz"]["reason"]
    with pytest.raises(ValueError, match="No shard could be read"):
        usage.read_usage(spark, str(tmp_path / "bad.csv.gz"))


def test_written_windows_are_not_shuffled_and_latest_ones_are_pruned(spark, regular, tmp_path):
    config = PipelineConfig(sequence_length=6, horizon=3, block_rows=40)
    points = [(m, i, float(i % 7), 1.0) for m, n in (("a", 100), ("b", 12), ("c", 9), ("d", 5)) for i in range(n)]
    series = resample.regular_series(regular(points), config)
    cut = windows.scaled_blocks(series, ["cpu_usage"], config, back=5, ahead=3)
    made = windows.array_windows(cut, ["cpu_usage"], ["cpu_usage"], config)
    for frame, name in ((made, "marked"), (made.drop("latest"), "found")):
        path = str(tmp_path / name)
        tables.write_windows(frame, path)
        stored = tables.read_windows(spark, path)
        assert stored.columns.count("latest") == 0 and stored.count() == 92 + 4 + 1
        latest = tables.read_windows(spark, path, latest_only=True)
        assert sorted((r.machine_id, r.window_idx) for r in latest.collect()) == [("a", 91), ("b", 3), ("c", 0)]
        read = {f.rsplit("latest=", 1)[1][0] for f in latest.inputFiles()}
        plan = latest._jdf.queryExecution().executedPlan().toString()
        assert "latest" in plan.split("PartitionFilters: [")[1].split("]")[0] and read
    # What write_windows does to marked arrays: a sort in place, above the array window.
    plan = made.withColumn("latest", F.col("latest").cast("int")).sortWithinPartitions(
        "split", "latest", "machine_id", "window_idx"
    )._jdf.queryExecution().sparkPlan().toString()
    assert "Exchange" not in plan.split("Window [")[0]


def test_top_machines_and_their_rows_share_one_rollup(spark, regular):
    rows = regular([(m, i, 1.0, 2.0) for m, n in (("a", 5), ("b", 9), ("c", 9), ("d", 2)) for i in range(n)])
    rolled = rollup.rollup_machine(rows.withColumn("collection_id", F.lit(1)))
    kept = rollup.restrict_to(rolled, 2)
    assert {r.machine_id for r in kept.collect()} == {"b", "c"} and kept.count() == 18
    kept = rollup.restrict_to(rolled, 2)
    kept.collect()
    final = kept._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") >= 1


def test_windows_come_in_the_order_they_are_written_in(spark, regular, tmp_path):
    config = PipelineConfig(sequence_length=6, horizon=3, block_rows=10)
    lengths = {"a": 100, "b": 12, "c": 9, "d": 5, "e": 10, "f": 11}
    points = [(m, i, float(i), 1.0) for m, n in lengths.items() for i in range(n)]
    series = resample.regular_series(regular(points), config)
    cut = windows.raw_blocks(series, ["cpu_usage"], config, back=5, ahead=3)
    made = windows.array_windows(cut, ["cpu_usage"], ["cpu_usage"], config)
    got = sorted((r.machine_id, r.window_idx, r.split, r.latest, [v for v, in r.x], [v for v, in r.y]) for r in made.collect())
    want = []
    for m, n in lengths.items():
        total = max(n - 8, 0)
        train, val = int(total * 0.7), int(total * 0.7) + int(total * 0.15)
        for i in range(total):
            split = "train" if i < train else "val" if i < val else "test"
            x, y = [float(v) for v in range(i, i + 6)], [float(v) for v in range(i + 6, i + 9)]
            want.append((m, i, split, int(i == total - 1), x, y))
    assert got == sorted(want)
    # What write_windows asks for: no sort is left above the window that makes the arrays.
    ordered = made.withColumn("latest", F.col("latest").cast("int")).sortWithinPartitions("split", "latest")
    ordered.collect()
    plan = ordered._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Sort [" not in plan.split("Window [")[0]


def _stored_windows(spark, regular, path):
    """Scaled windows of three machines."""
    config = PipelineConfig(sequence_length=6, horizon=3, block_rows=40)
    points = [(m, i, float(i % 7), 1.0) for m, n in (("a", 100), ("b", 40), ("c", 30)) for i in range(n)]
    series = resample.regular_series(regular(points), config)
    cut = windows.scaled_blocks(series, ["cpu_usage"], config, back=5, ahead=3)
    tables.write_windows(windows.array_windows(cut, ["cpu_usage"], ["cpu_usage"], config), str(path))


def _damage(folder, how):
    """The largest file of a folder: its data, its footer or its second half are lost."""
    file = max(folder.glob("*.parquet"), key=lambda f: f.stat().st_size)
    file.with_name(f".{file.name}.crc").unlink()  # as in a store without Hadoop's checksum files
    data = file.read_bytes()
    footer = len(data) - 8 - int.from_bytes(data[-8:-4], "little")
    if how == "data":
        data = data[:4] + b"\xff" * (footer - 4) + data[footer:]
    elif how == "footer":
        data = data[:footer] + b"\xff" * (len(data) - footer)
    else:
        data = data[: len(data) // 2]
    file.write_bytes(data)


@pytest.mark.parametrize("how", ["data", "footer", "half"])
def test_a_damaged_file_of_windows_is_an_error(spark, regular, tmp_path, how):
    _stored_windows(spark, regular, tmp_path / "w")
    assert len(tables.read_windows(spark, str(tmp_path / "w")).collect()) == 92 + 32 + 22
    _damage(tmp_path / "w" / "split=train" / "latest=0", how)
    with pytest.raises(Exception, match="split=train/latest=0"):
        parts = [tables.read_windows(spark, str(tmp_path / "w"), split) for split in tables.SPLITS]
        parts[0].unionByName(parts[1]).unionByName(parts[2]).collect()


def test_a_damaged_file_of_the_split_asked_for_is_an_error(spark, regular, tmp_path):
    _stored_windows(spark, regular, tmp_path / "w")
    _damage(tmp_path / "w" / "split=val" / "latest=0", "data")
    some = ["a", "b", "c"]
    with pytest.raises(Exception, match="split=val/latest=0"):
        tables.read_windows(spark, str(tmp_path / "w"), "val", some).collect()
    # The files of the other splits are whole, and only those are read.
    assert len(tables.read_windows(spark, str(tmp_path / "w"), "train", some).collect()) == 64 + 22 + 15


def test_a_damaged_file_of_latest_windows_is_an_error(spark, regular, tmp_path):
    _stored_windows(spark, regular, tmp_path / "w")
    assert len(tables.read_windows(spark, str(tmp_path / "w"), latest_only=True).collect()) == 3
    _damage(tmp_path / "w" / "split=test" / "latest=1", "data")
    with pytest.raises(Exception, match="split=test/latest=1"):
        tables.read_windows(spark, str(tmp_path / "w"), latest_only=True).collect()
