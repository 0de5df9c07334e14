"""Report queries, plan shapes and skew."""

import re

import pytest
from pyspark.sql import functions as F

from checks.adapters import EVENTS, LINES, events_usage, line_usage
from checks.queries import QUERIES
from gridpulse.config import PipelineConfig
from gridpulse.operators import forecast, resample, windows
from gridpulse.plans import pipeline, reports
from gridpulse.sources import tables

CONFIG = PipelineConfig(sequence_length=6, horizon=12, block_rows=50)
TARGETS = ["cpu_usage", "memory_usage"]
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def series(regular):
    points = [(m, t, float(t), 10.0) for m in ("10", "2") for t in range(40 if m == "2" else 30)]
    return resample.regular_series(regular(points), CONFIG).cache()


@pytest.fixture(scope="module")
def points(series):
    model = forecast.MovingAverage(12, 2)
    return pipeline.forecast_with_history(series, CONFIG, TARGETS, TARGETS, model).cache()


def test_overview_in_text_order_with_empty_machines(series, spark):
    machines = spark.createDataFrame([("10",), ("2",), ("x",)], "machine_id string")
    rows = reports.machine_overview(series, CONFIG, machines).collect()
    assert [r.id for r in rows] == ["10", "2", "x"]
    assert [r.latest_cpu for r in rows] == [17.0, 27.0, None]
    assert rows[2].num_windows == 0 and rows[2].status is None
    # 40 rows give 23 windows: 16 train, 3 val, 4 test.
    assert rows[1].num_windows == 4
    heat = {r.id: (r.cpu, r.band) for r in reports.cluster_heatmap(reports.machine_overview(series, CONFIG, machines)).collect()}
    assert heat == {"10": (17.0, "LOW"), "2": (27.0, "LOW"), "x": (0.0, "LOW")}


def test_cluster_numbers(series):
    overview = reports.machine_overview(series, CONFIG)
    assert reports.cluster_average(overview).first()[0] == 22.0
    assert reports.cluster_average(overview.filter("false")).first()[0] == 0.0
    kpis = reports.fleet_kpis(overview, selected="2").first()
    assert kpis.selected_temperature == round(40 + 27 * 0.4, 1)
    assert kpis.total_power_kw == pytest.approx((122.5 + 147.5) / 1000)
    assert reports.fleet_kpis(overview).first().selected_temperature == 0.0


def test_chart_rows_join_at_the_anchor(points):
    rows = reports.utilization_series(points).filter("machine_id = '2'").orderBy("position", "part").collect()
    assert len(rows) == 6 + 1 + 12
    assert [r.time for r in rows[:6]] == ["-25m", "-20m", "-15m", "-10m", "-5m", "now"]
    assert (rows[5].value, rows[5].forecast) == (27.0, None)
    assert (rows[6].time, rows[6].value, rows[6].forecast) == ("now", None, 27.0)
    assert (rows[7].time, rows[7].forecast) == ("+5m", 26.5)
    assert reports.memory_series(points).count() == 12
    assert reports.multi_horizon(points).filter("machine_id = '2'").count() == 12


def test_summary_and_risk(points):
    rows = reports.forecast_summary(points).filter("machine_id = '2'").orderBy("step").collect()
    assert [(r.step, r.label, r.cpu, r.band) for r in rows] == [
        (s, f"+{5 * s}m", 26.5, "ok") for s in (1, 3, 6, 12)
    ]
    short = points.filter("kind = 'history' OR step < 4")
    cut = reports.forecast_summary(short).filter("machine_id = '2'").orderBy("step").collect()
    assert [r.cpu for r in cut] == [26.5, 26.5, 0.0, 0.0]
    risk = {r.machine_id: (r.overload_pct, r.alert) for r in reports.overload_risk(points).collect()}
    assert risk == {"10": (16.5, False), "2": (26.5, False)}


def test_history_and_points(series):
    rows = reports.machine_history(series, CONFIG, TARGETS, steps=2).filter("machine_id = '2'")
    assert [(r.step, r.cpu_usage, r.jobs_count) for r in rows.orderBy("step").collect()] == [
        (0, 26.0, 1.0), (1, 27.0, 1.0),
    ]
    folded = reports.as_points(rows, ["cpu_usage", "temperature"]).orderBy("step").first()
    assert folded["values"] == {"cpu_usage": 26.0, "temperature": 50.4}
    scaled = reports.machine_history(series, CONFIG, TARGETS, denormalized=False)
    assert "temperature" not in scaled.columns
    last = scaled.filter("machine_id = '2' AND step = 5").first()
    assert last.cpu_usage == pytest.approx(1.0) and last.memory_usage == 0.0


def test_unknown_machine(series, spark):
    with pytest.raises(LookupError):
        reports.require_machine(series, "99")
    asked = spark.createDataFrame([("2",), ("99",)], "machine_id string")
    known = {r.machine_id: r.known for r in reports.known_machines(series, asked).collect()}
    assert known == {"2": True, "99": False}


# ---------------------------------------------------------------- plans


def _final_plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def _scans(plan):
    return re.findall(r"ReadSchema: struct<([^>]*)>", plan)


def test_series_shares_its_shuffles_and_reads_few_columns(spark):
    series = pipeline.fleet_series(line_usage(spark, DATA), LINES)
    plan = _final_plan(series.agg(F.count("*"), F.sum("rn"), F.sum("cpu_usage")))
    assert len(_scans(plan)) == 1
    assert sorted(c.split(":")[0] for c in _scans(plan)[0].split(",")) == [
        "l_discount", "l_quantity", "l_shipdate", "l_suppkey",
    ]
    assert "ReusedExchange" in plan and "SortMergeJoin" in plan
    assert "PushedFilters: [IsNotNull(" in plan


@pytest.mark.parametrize("name", ["predictions", "overview", "prepare"])
def test_one_scan_and_no_product_joins(spark, name):
    series = pipeline.fleet_series(events_usage(spark, DATA), EVENTS)
    df = {
        "predictions": lambda: forecast.moving_average_predictions(series, EVENTS, TARGETS),
        "overview": lambda: reports.machine_overview(series, EVENTS),
        "prepare": lambda: windows.scaled_blocks(series, TARGETS, EVENTS, 0, 0),
    }[name]()
    plan = _final_plan(df.agg(F.count("*"), *[F.max(c) for c in df.columns]))
    assert len(_scans(plan)) == 1
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "Python" not in plan


@pytest.mark.parametrize(
    "name",
    [
        "d1_with_scaler", "e2_ffill", "f1_minmax_transform", "f2_inverse_features",
        "f5_constant_column_warning", "g9_training_set",
    ],
)
def test_one_scan_when_positions_are_not_selected(spark, name):
    df = QUERIES[name](spark, DATA)
    plan = _final_plan(df.agg(F.count("*"), *[F.max(c) for c in df.columns]))
    assert len(_scans(plan)) == 1
    assert "ReusedExchange" in plan


def test_reports_on_a_stored_series_read_the_tail_only(spark, tmp_path):
    path = str(tmp_path / "series")
    series = pipeline.fleet_series(events_usage(spark, DATA), EVENTS)
    tables.write_series(series, path)
    tail = tables.read_series(spark, path, tail_only=True)
    overview = reports.machine_overview(tail, EVENTS)
    plan = overview._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*tail", plan)
    files = [r[0] for r in tail.select(F.input_file_name()).distinct().collect()]
    assert files and all("tail=1" in f for f in files)
    assert overview.collect() == reports.machine_overview(series, EVENTS).collect()


def test_last_rows_are_limited_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("string(id % 2) AS machine_id", "id AS row_order")
    plan = windows.last_rows(df, 60)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    single = windows.last_rows(df.drop("machine_id"), 60)
    assert "TakeOrderedAndProject" in single._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.row_order for r in single.collect()) == list(range(940, 1000))


def test_a_machine_with_most_rows_is_cut_into_blocks(spark, regular):
    """A hot machine spreads over tasks: no block holds more than its own rows and halo."""
    config = PipelineConfig(sequence_length=6, horizon=3, block_rows=40)
    hot = [("hot", t, float(t), 1.0) for t in range(2000)]
    cold = [(f"c{i}", t, float(t), 1.0) for i in range(3) for t in range(20)]
    series = resample.regular_series(regular(hot + cold), config)
    blocks = windows.scaled_blocks(series, TARGETS, config, back=5, ahead=3)
    sizes = blocks.groupBy("machine_id", "block").count()
    assert sizes.agg(F.max("count")).first()[0] <= 40 + 5 + 3
    assert sizes.filter("machine_id = 'hot'").count() >= 50
    made = forecast.moving_average_predictions(series, config, TARGETS, (4,))
    assert made.count() == (2000 - 8 + 3 * (20 - 8)) * 3 * 2


def test_generated_methods_stay_small_enough_to_be_compiled(spark):
    """The JVM never compiles methods above 8,000 bytes; they would run interpreted."""
    series = pipeline.fleet_series(events_usage(spark, DATA), EVENTS)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (series, forecast.moving_average_predictions(series, EVENTS, TARGETS)):
            text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
            sizes = [int(v) for v in re.findall(r"maxMethodCodeSize:(\d+)", text)]
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
