"""Forecasters, evaluation and uploaded telemetry."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridpulse import messages
from gridpulse.config import PipelineConfig
from gridpulse.operators import blocks, evaluate, forecast, resample, training, windows
from gridpulse.plans import models, pipeline, upload

CONFIG = PipelineConfig(sequence_length=6, horizon=3, block_rows=50)
TARGETS = ["cpu_usage", "memory_usage"]


@pytest.fixture(scope="module")
def series(regular):
    rng = np.random.default_rng(3)
    points = [
        (m, t, float(50 + 20 * math.sin(t / 7 + k) + rng.normal()), float(30 + t % 11 + rng.normal()))
        for k, m in enumerate(("a", "b", "c"))
        for t in range(160)
    ]
    return resample.regular_series(regular(points), CONFIG).cache()


def _arrays(series):
    """Scaled rows of each machine, as numpy would hold them."""
    out = {}
    for m, group in series.toPandas().sort_values("rn").groupby("machine_id"):
        values = group[TARGETS].to_numpy()
        prefix = values[: int(len(values) * 0.7)]
        out[m] = (values - prefix.min(0)) / (prefix.max(0) - prefix.min(0))
    return out


def test_moving_average_of_the_latest_window(series):
    config = PipelineConfig(sequence_length=20, horizon=3, block_rows=50)
    latest = windows.latest_window(series, config)
    got = forecast.moving_average(latest, config, TARGETS, window=12).filter("machine_id = 'a'")
    rows = got.orderBy("step").collect()
    assert [r.step for r in rows] == [0, 1, 2]
    values = series.filter("machine_id = 'a'").orderBy("rn").toPandas()["cpu_usage"]
    assert rows[0].cpu_usage == rows[2].cpu_usage == pytest.approx(values[145:157].mean())


@pytest.mark.parametrize("split", [None, "test"])
def test_moving_average_predictions_match_numpy(series, split):
    got = forecast.moving_average_predictions(series, CONFIG, TARGETS, (4, 6), split=split)
    total, cut = 160 - 9 + 1, int(152 * 0.7) + int(152 * 0.15)
    first = 0 if split is None else cut
    assert got.count() == 3 * (total - first) * 3 * 2 * 2
    arrays = _arrays(series)
    for r in got.filter("step IN (1, 3) AND machine_id = 'b'").collect():
        t, width = TARGETS.index(r.target), int(r.model.rsplit("_", 1)[1])
        end = r.window_idx + 6
        assert r.y_true == pytest.approx(arrays["b"][end + r.step - 1, t])
        assert r.y_pred == pytest.approx(arrays["b"][end - width : end, t].mean())


def test_linear_fit_equals_direct_solution(series):
    model = forecast.linear_fit(series, CONFIG, TARGETS, TARGETS, train_on="all")
    x, y = [], []
    for values in _arrays(series).values():
        count = int((len(values) - 8) * 0.7)
        x += [values[i : i + 6].ravel() for i in range(count)]
        y += [values[i + 6 : i + 9].ravel() for i in range(count)]
    x, y = np.column_stack([np.array(x), np.ones(len(x))]), np.array(y)
    penalty = np.full(13, len(x) * 6 * 1e-5 / 2)
    penalty[-1] = 0
    expected = np.linalg.solve(x.T @ x + np.diag(penalty), x.T @ y)
    assert np.allclose(model.weights, expected[:-1], atol=1e-6)
    assert np.allclose(model.bias, expected[-1], atol=1e-6)
    assert model.num_params() == 12 * 6 + 6


def test_linear_training_set_and_prediction(series):
    one = forecast.linear_fit(series, CONFIG, TARGETS, TARGETS, train_on=None)
    named = forecast.linear_fit(series, CONFIG, TARGETS, TARGETS, train_on=["a"])
    assert np.allclose(one.weights, named.weights)
    got = forecast.model_predictions(series, CONFIG, TARGETS, TARGETS, one, split="test")
    arrays = _arrays(series)
    rows = got.filter("machine_id = 'c'").collect()
    assert len(rows) == 24 * 3 * 2
    for r in rows:
        x = arrays["c"][r.window_idx : r.window_idx + 6].ravel()
        guess = (x @ one.weights + one.bias).reshape(3, 2)
        at = TARGETS.index(r.target)
        assert r.y_pred == pytest.approx(guess[r.step - 1, at])
        assert r.y_true == pytest.approx(arrays["c"][r.window_idx + 5 + r.step, at])
    better = evaluate.mae(got).first().mae
    assert 0 < better < 0.2


def test_model_forecast_in_real_units_agrees_with_moving_average(series):
    config = PipelineConfig(sequence_length=12, horizon=3, block_rows=50)

    def mean(x):
        return np.repeat(x.mean(axis=1, keepdims=True), 3, axis=1)

    plug = forecast.NumpyForecaster("mean_of_all", mean)
    got = pipeline.forecast_fleet(series, config, TARGETS, TARGETS, plug)
    native = pipeline.forecast_fleet(series, config, TARGETS, TARGETS, forecast.MovingAverage(3, 12))
    left = {(r.machine_id, r.step): (r.cpu_usage, r.memory_usage) for r in got.collect()}
    right = {(r.machine_id, r.step): (r.cpu_usage, r.memory_usage) for r in native.collect()}
    assert left.keys() == right.keys() and len(left) == 9
    for key, value in left.items():
        assert value == pytest.approx(right[key])


def test_score_single_and_batch(spark):
    model = forecast.MovingAverage(horizon=4, window=2)
    one = forecast.score_one(spark, [[1.0, 5.0, 9.0], [3.0, 7.0, 9.0]], model).first()
    assert one.forecast == [[2.0, 6.0]] * 4
    shorter = forecast.score_one(spark, [[1.0, 5.0]], model).first()
    assert shorter.forecast == [[1.0, 5.0]] * 4
    with pytest.raises(ValueError, match="2D"):
        forecast.score_one(spark, [1.0, 2.0], model)
    flat = spark.createDataFrame([([1.0],)], "x array<double>")
    with pytest.raises(ValueError, match="3D"):
        forecast.score(flat, model)
    linear = forecast.Linear(1, 1, 2, 2, np.array([[1.0, 2.0], [10.0, 20.0]]), np.array([0.5, 0.0]))
    got = forecast.score_one(spark, [[1.0], [2.0]], linear).first()
    assert got.forecast == [[21.5], [42.0]]


def test_registry_lookup():
    average = forecast.MovingAverage()
    assert forecast.resolve_model({"moving_avg_12": average}) is average
    with pytest.raises(forecast.NoModelsError):
        forecast.resolve_model({})
    with pytest.raises(forecast.UnknownModelError):
        forecast.resolve_model({"moving_avg_12": average}, "other")
    assert models.rebuild("moving_avg_12", average.config()) == average
    with pytest.raises(forecast.UnknownModelError):
        models.rebuild("unheard_of", {})
    assert isinstance(average, forecast.Forecaster)


def _pairs(spark, truth, guess, target="cpu_usage"):
    rows = [("m", "test", 1, target, float(y), float(p)) for y, p in zip(truth, guess)]
    return spark.createDataFrame(
        rows, "model string, split string, step int, target string, y_true double, y_pred double"
    )


def test_evaluation_of_equal_input(spark):
    values = [0.5, 0.9, 0.3, 0.85, 0.1]
    df = _pairs(spark, values, values)
    assert evaluate.mae(df).first().mae == evaluate.rmse(df).first().rmse == 0
    found = evaluate.overload(df).first()
    assert (found.accuracy, found.f1, found.total_overload_events) == (1.0, 1.0, 2)


def test_evaluation_values(spark):
    y, p = np.array([0.0, 0.8, 1.0, 0.9, 0.2]), np.array([0.1, 0.9, 0.7, 0.9, 0.2])
    df = _pairs(spark, y, p).unionByName(_pairs(spark, y, y, "memory_usage"))
    rows = {(r.scope, r.target, r.step): r for r in evaluate.evaluate_all(df).collect()}
    assert set(rows) == {
        ("overall", None, None), ("per_target", "cpu_usage", None),
        ("per_target", "memory_usage", None), ("per_horizon", None, 1),
    }
    cpu, step = rows["per_target", "cpu_usage", None], rows["per_horizon", None, 1]
    assert cpu.mae == pytest.approx(np.abs(y - p).mean())
    assert cpu.rmse == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert cpu.mape == pytest.approx((np.abs(y - p) / np.maximum(np.abs(y), 1e-8)).mean() * 100)
    assert rows["overall", None, None].mae == pytest.approx(cpu.mae / 2)
    # 0.8 is not above the threshold: one hit, one miss, one false alarm.
    assert (cpu.precision, cpu.recall, cpu.f1, cpu.accuracy) == (0.5, 0.5, 0.5, 0.6)
    assert (cpu.total_overload_events, cpu.predicted_overload_events) == (2, 2)
    assert rows["per_target", "memory_usage", None].precision is None
    assert step.mae == round(np.abs(y - p).mean() / 2, 4) and step.mape is None


def test_no_overload_at_all(spark):
    found = evaluate.overload(_pairs(spark, [0.1], [0.2])).first()
    assert (found.precision, found.recall, found.f1, found.accuracy) == (0.0, 0.0, 0.0, 1.0)


def test_split_is_a_key_or_a_filter(spark):
    df = _pairs(spark, [1.0], [0.5]).unionByName(
        _pairs(spark, [1.0], [1.0]).withColumn("split", F.lit("val"))
    )
    assert evaluate.evaluate_by_split(df).filter("scope = 'overall'").first().mae == 0.5
    both = evaluate.evaluate_by_split(df, split=None).filter("scope = 'overall'")
    assert {r.split: r.mae for r in both.collect()} == {"test": 0.5, "val": 0.0}


# ---------------------------------------------------------------- uploads

UPLOAD = PipelineConfig()


def _telemetry(spark, machines, extra=()):
    """machines: id -> number of rows; values rise with the row."""
    rows, order = [], 0
    for machine, count in machines.items():
        for i in range(count):
            rows.append((machine, str(i + 0.5), str(2 * i), *[str(e) for e in extra], order))
            order += 1
    names = ["assigned_memory", "cycles_per_instruction"][: len(extra)]
    columns = ["machine_id", "cpu_usage", "memory_usage", *names]
    schema = ", ".join(f"{c} string" for c in columns) + ", row_order long"
    return spark.createDataFrame(rows, schema)


def test_upload_of_two_machines(spark):
    got = upload.forecast_upload(_telemetry(spark, {"a": 70, "b": 60}), UPLOAD)
    assert got.model == "moving_avg_12" and got.warnings == []
    assert got.features == ["cpu_usage", "memory_usage"]
    counts = {(r.machine_id, r.kind): r["count"] for r in got.points.groupBy("machine_id", "kind").count().collect()}
    assert counts == {("a", "history"): 60, ("a", "forecast"): 12, ("b", "history"): 60, ("b", "forecast"): 12}
    past = got.points.filter("machine_id = 'a' AND kind = 'history'").orderBy("step").collect()
    assert (past[0].cpu_usage, past[-1].cpu_usage) == (10.5, 69.5)
    ahead = got.points.filter("machine_id = 'a' AND kind = 'forecast'").orderBy("step").first()
    assert ahead.cpu_usage == pytest.approx(np.mean([i + 0.5 for i in range(58, 70)]))
    assert {r.machine_id: r.num_input_rows for r in got.machines.collect()} == {"a": 70, "b": 60}


def test_upload_without_ids_and_too_few_rows(spark):
    telemetry = _telemetry(spark, {"x": 40}).drop("machine_id")
    got = upload.forecast_upload(telemetry, UPLOAD)
    assert got.warnings == ["No 'machine_id' column; treating all rows as one machine."]
    only = got.machines.first()
    assert only.machine_id == "uploaded" and only.num_input_rows == 40
    assert only.warnings == ["Not enough rows: 40 available, 60 required for a forecast."]
    assert got.points.count() == 0


def test_upload_of_one_unnamed_machine(spark):
    got = upload.forecast_upload(_telemetry(spark, {"x": 65}).drop("machine_id"), UPLOAD)
    past = got.points.filter("kind = 'history'").orderBy("step").collect()
    assert len(past) == 60 and past[-1].cpu_usage == 64.5
    assert {r.machine_id for r in got.points.collect()} == {"uploaded"}


def test_upload_drops_text_and_missing_ids(spark):
    telemetry = _telemetry(spark, {"a": 61, None: 70})
    spoiled = telemetry.withColumn(
        "cpu_usage", F.when(F.col("row_order") == 3, "oops").otherwise(F.col("cpu_usage"))
    )
    got = upload.forecast_upload(spoiled, UPLOAD)
    rows = got.machines.collect()
    assert [(r.machine_id, r.num_input_rows) for r in rows] == [("a", 60)]
    assert got.points.filter("kind = 'history'").agg(F.min("cpu_usage")).first()[0] == 0.5


def test_upload_needs_columns_and_an_order(spark):
    telemetry = _telemetry(spark, {"a": 60})
    with pytest.raises(ValueError, match="memory_usage"):
        upload.forecast_upload(telemetry.drop("memory_usage"), UPLOAD)
    with pytest.raises(ValueError, match="order"):
        upload.forecast_upload(telemetry.drop("row_order"), UPLOAD)


def test_upload_fits_the_model_inputs(spark):
    def copy_last(x):
        return np.repeat(x[:, -1:, :2], 12, axis=1)

    two = forecast.NumpyForecaster("last", copy_last, input_dim=2)
    telemetry = _telemetry(spark, {"a": 60}, extra=(7, 1.5))
    got = upload.forecast_upload(telemetry, UPLOAD, two)
    assert got.features == ["cpu_usage", "memory_usage"] and len(got.warnings) == 1
    ahead = got.points.filter("kind = 'forecast'").collect()
    assert len(ahead) == 12
    for r in ahead:
        assert (r.cpu_usage, r.memory_usage) == pytest.approx((59.5, 118.0))

    three = forecast.NumpyForecaster("last", copy_last, input_dim=3)
    got = upload.forecast_upload(_telemetry(spark, {"a": 60}), UPLOAD, three)
    assert got.warnings == ["Column 'assigned_memory' missing; filled with 0."]
    assert got.machines.first().warnings == [messages.CONSTANT_COLUMNS]
    assert got.points.filter("kind = 'history'").first().assigned_memory == 0.0


@pytest.mark.parametrize("sizes", [[5], [4, 30, 7, 0, 100], [12] * 700])
def test_lagged_gram_equals_the_product_of_all_windows(sizes):
    length, columns = 4, 3
    rng = np.random.default_rng(3)
    halves = [forecast.LaggedGram(length, columns) for _ in range(2)]
    windows = []
    for i, size in enumerate(sizes):
        rows = rng.normal(size=(size, columns))
        halves[i % 2].add(rows)
        windows += [rows[k : k + length] for k in range(max(0, size - length + 1))]
    entries = halves[0].entries() + halves[1].entries()
    count, sums, products = forecast.LaggedGram.whole(entries, length, columns)
    whole = np.array(windows)
    assert count == len(whole)
    np.testing.assert_allclose(sums, whole.sum(axis=0), atol=1e-9)
    flat = whole.reshape(count, -1)
    np.testing.assert_allclose(products.reshape(12, 12), flat.T @ flat, atol=1e-8)


@pytest.mark.parametrize("constant", [True, False])
def test_array_sums_equal_long_sums(spark, constant):
    rng = np.random.default_rng(5)
    width = 1 if constant else 3
    rows = []
    for i in range(40):
        truth, guess = rng.random(6).round(2).tolist(), rng.random(4 * width).round(2).tolist()
        if i % 7 == 0:
            truth[i % 6] = None
        if i % 11 == 0:
            guess[i % (4 * width)] = None
        rows.append(("m", i, ["train", "val", "test"][i % 3], truth, guess))
    wide = spark.createDataFrame(
        rows, "machine_id string, window_idx long, split string, truth array<double>, guess array<double>"
    )
    predictions = forecast.WindowPredictions(wide, ("a", "b"), ("cpu", "memory"), 3, constant)
    keys = ["split", "model", "target", "step"]
    for threshold in (0.5, 0.8):
        got = {tuple(r[:4]): r[4:] for r in evaluate.error_sums(predictions, keys, threshold).collect()}
        want = {tuple(r[:4]): r[4:] for r in evaluate.error_sums(predictions.long(), keys, threshold).collect()}
        assert got.keys() == want.keys() and len(got) == 36
        for key, values in want.items():
            assert got[key] == pytest.approx(values)
    one = evaluate.evaluate_by_split(predictions, "test").collect()
    assert len(one) == len(evaluate.evaluate_by_split(predictions.long(), "test").collect()) == 12


def test_no_windows_give_no_sums(spark):
    wide = spark.createDataFrame(
        [], "machine_id string, window_idx long, split string, truth array<double>, guess array<double>"
    )
    predictions = forecast.WindowPredictions(wide, ("a",), ("cpu",), 3, True)
    assert evaluate.error_sums(predictions, ["model"]).collect() == []


class MeanOfLastRow:
    """A trainer with states that must be merged right: sums and a count."""

    name = "last"

    def partial(self, x, y):
        return np.array([len(x), x[:, -1].sum(), y.sum()])

    def merge(self, states):
        return states.sum(axis=0)

    def finish(self, state):
        return np.array([state[2] / state[0] / 12])

    def predictor(self, parameters):
        return lambda x: np.full((len(x), 12, 1), parameters[0])


def test_one_model_and_one_each(spark, regular):
    points = [("a", i, float(i % 5), 1.0) for i in range(200)] + [("b", i, float(i % 3), 1.0) for i in range(100)]
    points += [("short", i, 1.0, 1.0) for i in range(40)]
    trainer = MeanOfLastRow()
    small = PipelineConfig(block_rows=80)
    series = resample.regular_series(regular(points), small)
    args = (series, small, ["cpu_usage"], ["cpu_usage"], trainer)
    each = {r["machine_id"]: r for r in training.fit_each(*args).collect()}
    assert set(each) == {"a", "b"}
    windows_a, windows_b = int((200 - 71) * 0.7), int((100 - 71) * 0.7)
    assert (each["a"]["windows"], each["b"]["windows"]) == (windows_a, windows_b)
    pooled = training.fit(*args, train_on="all")
    expected = (windows_a * each["a"]["parameters"][0] + windows_b * each["b"]["parameters"][0]) / (windows_a + windows_b)
    x = np.zeros((2, 60, 1))
    assert pooled.predictor()(x)[0, 0, 0] == pytest.approx(expected)
    first = training.fit(*args)
    assert first.predictor()(x)[0, 0, 0] == pytest.approx(each["a"]["parameters"][0])
    with pytest.raises(ValueError, match="no training window"):
        training.fit(*args, train_on=["short"])
    models = training.fit_each(*args)
    rows = [("a", 0, [[0.0]] * 60), ("none", 1, [[0.0]] * 60), (None, 2, [[0.0]] * 60)]
    wins = spark.createDataFrame(rows, "machine_id string, window_idx long, x array<array<double>>")
    got = {r["machine_id"]: r["forecast"] for r in training.score_each(wins, models, trainer).collect()}
    assert got["none"] is None and got[None] is None
    assert got["a"][11][0] == pytest.approx(each["a"]["parameters"][0])


def test_lookup_joins_by_machine_and_block(spark):
    rows = spark.range(0, 20_000).selectExpr(
        "CASE WHEN id < 19000 THEN 'hot' WHEN id < 19990 THEN concat('m', id % 7) END AS machine_id", "id AS rn"
    )
    table = spark.createDataFrame([("hot", 1.0), ("m1", 2.0)], "machine_id string, low double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = blocks.blocked_lookup(rows, table)
        assert joined.count() == 20_000 and joined.filter("low = 1").count() == 19_000
        assert joined.filter("machine_id = 'm1'").filter("low = 2").count() == joined.filter("machine_id = 'm1'").count()
        plan = joined._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin [machine_id" in plan and "_block" in plan.split("SortMergeJoin")[1].split("]")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
