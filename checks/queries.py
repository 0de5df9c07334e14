"""One query per operator, each over whole provided tables, with its SQL equivalent.

Floating-point results are rounded on both sides, only to hide summation order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sql as q
from checks.adapters import (
    EVENTS,
    LINES,
    USERS,
    events_usage,
    line_usage,
    pair_usage,
    table,
    text_telemetry,
    user_usage,
)
from gridpulse.config import PipelineConfig
from gridpulse.functions import derive
from gridpulse.operators import clean, evaluate, forecast, resample, rollup, scale, training, windows
from gridpulse.plans import models, pipeline, reports, upload
from gridpulse.session import scratch_folder
from gridpulse.sources import tables, usage
from gridpulse.streaming import bins as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FEATURES = ["cpu_usage", "memory_usage", "assigned_memory"]
TARGETS = ["cpu_usage", "memory_usage"]


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round DOUBLE columns; ``special`` gives other digits per column."""
    return df.select(
        *[
            F.round(c, special.get(c, digits)).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def _cleaned(spark, sf_dir):
    return clean.clean_usage(events_usage(spark, sf_dir))


def _rolled(spark, sf_dir, source=events_usage, count_jobs=True):
    return rollup.clip_rollup(
        rollup.rollup_machine(clean.clean_usage(source(spark, sf_dir)), count_jobs)
    )


def _bins(spark, sf_dir):
    return resample.resample_mean(_rolled(spark, sf_dir, count_jobs=False), EVENTS)


def _events(spark, sf_dir):
    return pipeline.fleet_series(events_usage(spark, sf_dir), EVENTS)


def _users(spark, sf_dir):
    return pipeline.fleet_series(user_usage(spark, sf_dir), USERS)


def _pairs(spark, sf_dir):
    return pipeline.fleet_series(pair_usage(spark, sf_dir), USERS)


def _lines(spark, sf_dir):
    return pipeline.fleet_series(line_usage(spark, sf_dir), LINES)


def _points(spark, sf_dir):
    return pipeline.forecast_with_history(_users(spark, sf_dir), USERS, FEATURES, TARGETS)


def _states(spark, sf_dir):
    return reports.machine_states(_users(spark, sf_dir), USERS)


def _predictions(spark, sf_dir, widths=(12,), split=None):
    return forecast.moving_average_predictions(
        _events(spark, sf_dir), EVENTS, TARGETS, widths, split=split
    )


def _window_predictions(spark, sf_dir, split=None):
    return forecast.moving_average_windows(_events(spark, sf_dir), EVENTS, TARGETS, split=split)


def _round_list(names, digits=6, prefix=""):
    return ", ".join(f"{q.r(prefix + c, digits)} AS {c}" for c in names)


# ---------------------------------------------------------------- sources and sinks

_RAW = ["avg_cpu", "avg_memory", "max_cpu", "max_memory", "assigned_memory", "cycles_per_instruction"]


@query(
    "a1_read_usage",
    f"""WITH usage AS ({q.USAGE['events']})
SELECT start_time, collection_id, machine_id, {_round_list(_RAW)}, event_id AS instance_index
FROM usage""",
)
def a1_read_usage(spark, sf_dir):
    """Usage written as headerless CSV shards with several missing-value words, read back."""
    word = F.element_at(
        F.array(*[F.lit(w) for w in ("", " ", "NaN", "null", "N/A")]),
        (F.col("event_id") % 5 + 1).cast("int"),
    )
    source = events_usage(spark, sf_dir).withColumn("instance_index", F.col("event_id"))
    shard = source.select(
        *[
            F.coalesce(F.col(c).cast("string"), word).alias(c)
            if c in source.columns
            else word.alias(c)
            for c, _ in usage.USAGE_COLUMNS
        ]
    )
    path = scratch_folder(spark, "usage")
    shard.write.option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    return rounded(
        usage.read_usage(spark, path).select(
            "start_time", "collection_id", "machine_id", *_RAW, "instance_index"
        )
    )


@query(
    "a3_limit_per_file",
    f"""WITH usage AS ({q.USAGE['events']})
SELECT event_id AS instance_index, machine_id, collection_id, {_round_list(['avg_cpu', 'avg_memory'])}
FROM usage QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY event_id) <= 500""",
)
def a3_limit_per_file(spark, sf_dir):
    """The first 500 rows of each shard; a shard holds one event type in event order."""
    path = scratch_folder(spark, "shards")
    source = events_usage(spark, sf_dir).withColumn("instance_index", F.col("event_id"))
    columns = [
        F.col(c).cast("string") if c in source.columns else F.lit(None).cast("string").alias(c)
        for c, _ in usage.USAGE_COLUMNS
    ]
    (
        source.repartition("machine_id").sortWithinPartitions("machine_id", "event_id")
        .select(*columns, F.col("machine_id").alias("shard"))
        .write.partitionBy("shard").csv(path)
    )
    kept = usage.read_usage(spark, f"{path}/shard=*", limit_per_file=500)
    return rounded(
        kept.select("instance_index", "machine_id", "collection_id", "avg_cpu", "avg_memory")
    )


def _renamed(spark, folder: str, new_name) -> None:
    """Give the part files of each ``key=value`` folder the name ``new_name(value)``.

    Through the Hadoop file system, whatever store the folder is in; a few sidecar files.
    """
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for part in system.listStatus(root):
        if "=" in part.getPath().getName():
            value = part.getPath().getName().split("=", 1)[1]
            for file in system.listStatus(part.getPath()):
                if file.getPath().getName().startswith("part-"):
                    system.rename(file.getPath(), jvm.org.apache.hadoop.fs.Path(folder, new_name(value)))


@query(
    "a4_unreadable_shard",
    f"""WITH usage AS ({q.USAGE['events']})
SELECT event_id AS instance_index, machine_id, {_round_list(['avg_cpu', 'avg_memory'])} FROM usage""",
)
def a4_unreadable_shard(spark, sf_dir):
    """Good shards next to one that claims to be gzip and is not: the rest is read."""
    good, bad = scratch_folder(spark, "shards"), scratch_folder(spark, "broken")
    source = events_usage(spark, sf_dir).withColumn("instance_index", F.col("event_id"))
    source.select(
        *[
            F.col(c).cast("string") if c in source.columns else F.lit(None).cast("string").alias(c)
            for c, _ in usage.USAGE_COLUMNS
        ]
    ).write.csv(good)
    spark.range(1).select(F.lit("not gzip").alias("line"), F.lit(0).alias("k")).write.partitionBy("k").text(bad)
    _renamed(spark, bad, lambda _: "shard.csv.gz")
    kept = usage.read_usage(spark, [good, f"{bad}/shard.csv.gz"])
    return rounded(kept.select("instance_index", "machine_id", "avg_cpu", "avg_memory"))


@query(
    "a3_limit_per_file_lines",
    f"""SELECT l_orderkey AS collection_id, l_linenumber::BIGINT AS instance_index, machine_id,
{q.r('avg_cpu')} AS avg_cpu FROM (
  SELECT l_orderkey, l_linenumber, l_suppkey::VARCHAR AS machine_id, l_quantity / 50 AS avg_cpu,
    row_number() OVER (PARTITION BY l_orderkey % 3 ORDER BY l_orderkey, l_linenumber) AS place
  FROM lineitem) WHERE place <= 1500""",
)
def a3_limit_per_file_lines(spark, sf_dir):
    """The first 1,500 rows of each of three shards of order lines, beyond any map-side top-k."""
    path = scratch_folder(spark, "shards")
    source = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("collection_id"), F.col("l_linenumber").alias("instance_index"),
        F.col("l_suppkey").alias("machine_id"), (F.col("l_quantity") / 50).alias("avg_cpu"),
        (F.col("l_orderkey") % 3).alias("shard"),
    )
    columns = [
        F.col(c).cast("string") if c in source.columns else F.lit(None).cast("string").alias(c)
        for c, _ in usage.USAGE_COLUMNS
    ]
    (
        source.repartition("shard").sortWithinPartitions("shard", "collection_id", "instance_index")
        .select(*columns, "shard").write.partitionBy("shard").csv(path)
    )
    kept = usage.read_usage(spark, f"{path}/shard=*", limit_per_file=1500)
    return rounded(kept.select("collection_id", "instance_index", "machine_id", "avg_cpu"))


def _gzip_shards_one_cut(spark, sf_dir):
    """Gzip shards, one per event type; of the first one only half of the bytes."""
    path = scratch_folder(spark, "shards")
    source = events_usage(spark, sf_dir).withColumn("instance_index", F.col("event_id"))
    columns = [
        F.col(c).cast("string") if c in source.columns else F.lit(None).cast("string").alias(c)
        for c, _ in usage.USAGE_COLUMNS
    ]
    (
        source.repartition("machine_id").select(*columns, F.col("machine_id").alias("shard"))
        .write.partitionBy("shard").option("compression", "gzip").csv(path)
    )
    _renamed(spark, path, lambda shard: f"{shard}.csv.gz")
    cut = source.agg(F.min("machine_id")).first()[0]
    hadoop = spark._jvm.org.apache.hadoop
    whole = hadoop.fs.Path(path, f"{cut}.csv.gz")
    system = whole.getFileSystem(spark._jsc.hadoopConfiguration())
    source, half = system.open(whole), system.create(hadoop.fs.Path(path, f"cut-{cut}.csv.gz"))
    half.write(source.readNBytes(system.getFileStatus(whole).getLen() // 2))
    half.close()
    source.close()
    system.delete(whole, False)
    return usage.read_shards(spark, f"{path}/*.csv.gz")


@query(
    "a4_truncated_gzip",
    f"""SELECT event_id AS instance_index, machine_id, {_round_list(['avg_cpu', 'avg_memory'])}
FROM ({q.USAGE['events']}) WHERE machine_id > (SELECT min(event_type) FROM events)""",
)
def a4_truncated_gzip(spark, sf_dir):
    """A shard whose gzip data end too early gives no row, not even those before the end."""
    kept = _gzip_shards_one_cut(spark, sf_dir).usage
    return rounded(kept.select("instance_index", "machine_id", "avg_cpu", "avg_memory"))


@query(
    "a4_shard_ledger",
    """SELECT CASE WHEN event_type = least THEN 'cut-' ELSE '' END || event_type || '.csv.gz' AS shard,
  CASE WHEN event_type = least THEN 0 ELSE count(*) END AS rows_read,
  CASE WHEN event_type = least THEN 'gzip data end too early' END AS reason
FROM events, (SELECT min(event_type) AS least FROM events) GROUP BY event_type, least""",
)
def a4_shard_ledger(spark, sf_dir):
    """One row per shard, with the rows read or the reason why none were."""
    ledger = _gzip_shards_one_cut(spark, sf_dir).ledger
    return ledger.select(F.element_at(F.split("shard", "/"), -1).alias("shard"), "rows_read", "reason")


@query(
    "a5_read_telemetry_csv",
    f"""SELECT machine_id, nullif(trim(cpu_usage), '') AS cpu_usage, memory_usage, assigned_memory,
row_order AS row_number FROM ({q.TEXT_TELEMETRY})""",
)
def a5_read_telemetry_csv(spark, sf_dir):
    """Telemetry written with a header row and read back as text."""
    path = scratch_folder(spark, "telemetry")
    text_telemetry(spark, sf_dir).withColumnRenamed("row_order", "row_number").write.option(
        "header", True
    ).csv(path)
    read = usage.read_telemetry_csv(spark, path)
    return read.select(
        "machine_id",
        F.expr("nullif(trim(cpu_usage), '')").alias("cpu_usage"),
        "memory_usage",
        "assigned_memory",
        F.col("row_number").cast("long").alias("row_number"),
    )


_WINDOW_DIGEST = f"""{q.series('users')}, {q.scalers(FEATURES)},
  framed AS (SELECT machine_id, rn, n, list(cpu_usage) OVER x AS xc, list(assigned_memory) OVER x AS xa,
      list(memory_usage) OVER y AS ym
    FROM (SELECT m.machine_id, rn, n, {', '.join(f'{q.scaled(c)} AS {c}' for c in FEATURES)}
      FROM marks m JOIN bounds b ON m.machine_id = b.machine_id)
    WINDOW x AS (PARTITION BY machine_id ORDER BY rn ROWS BETWEEN 59 PRECEDING AND CURRENT ROW),
      y AS (PARTITION BY machine_id ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING))
SELECT w.machine_id, w.window_idx, w.split, len(xc)::INT AS x_rows, len(ym)::INT AS y_rows,
  {q.r('xc[1]', 9)} AS x_first, {q.r('xa[60]', 9)} AS x_last, {q.r('list_sum(xc)', 9)} AS x_sum,
  {q.r('ym[1]', 9)} AS y_first, {q.r('list_sum(ym)', 9)} AS y_sum
FROM windows w JOIN framed f ON w.machine_id = f.machine_id AND w.rn = f.rn"""


def _window_digest(made: DataFrame) -> DataFrame:
    """Sizes, ends and sums of window arrays; nine digits, where short decimals cannot tie."""

    def total(column, at):
        return F.aggregate(column, F.lit(0.0), lambda acc, row: acc + row[at])

    return rounded(
        made.select(
            "machine_id", "window_idx", "split",
            F.size("x").alias("x_rows"), F.size("y").alias("y_rows"),
            F.col("x")[0][0].alias("x_first"), F.col("x")[59][2].alias("x_last"),
            total("x", 0).alias("x_sum"),
            F.col("y")[0][1].alias("y_first"), total("y", 1).alias("y_sum"),
        ),
        9,
    )


def _user_windows(spark, sf_dir):
    blocks = windows.scaled_blocks(_users(spark, sf_dir), FEATURES, USERS, back=59, ahead=12)
    return windows.array_windows(blocks, FEATURES, TARGETS, USERS)


@query("a6_a7_windows_round_trip", _WINDOW_DIGEST)
def a6_a7_windows_round_trip(spark, sf_dir):
    """Inputs and targets of all three splits, written and read back split by split."""
    path = scratch_folder(spark, "windows")
    tables.write_windows(_user_windows(spark, sf_dir), path)
    parts = [tables.read_windows(spark, path, split) for split in tables.SPLITS]
    return _window_digest(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(
    "a7_read_one_split",
    f"""{_WINDOW_DIGEST} WHERE w.split = 'val' AND w.machine_id IN ('1', '3', '5')""",
)
def a7_read_one_split(spark, sf_dir):
    """One split of three machines: a folder and a pushed filter."""
    path = scratch_folder(spark, "windows")
    tables.write_windows(_user_windows(spark, sf_dir), path)
    return _window_digest(tables.read_windows(spark, path, "val", ["1", "3", "5"]))


@query(
    "a7_series_round_trip",
    f"{q.series('users')} SELECT machine_id, bin, rn, n, {_round_list(q.columns('users'))} FROM series",
)
def a7_series_round_trip(spark, sf_dir):
    path = scratch_folder(spark, "series")
    tables.write_series(_users(spark, sf_dir), path)
    return rounded(tables.read_series(spark, path).drop("bin_no"))


_LONG_BOUNDS = " UNION ALL ".join(
    f"SELECT machine_id, '{c}' AS \"column\", {q.r(c + '_lo')} AS data_min, {q.r(c + '_hi')} AS data_max FROM bounds"
    for c in FEATURES
)


@query("a8_scalers_round_trip", f"{q.series('events')}, {q.scalers(FEATURES)} {_LONG_BOUNDS}")
def a8_scalers_round_trip(spark, sf_dir):
    path = scratch_folder(spark, "scalers")
    tables.write_scalers(scale.fit_minmax(_events(spark, sf_dir), FEATURES, EVENTS), path)
    return rounded(tables.read_scalers(spark, path))


def _metric_rows(digits_mape: int = 2) -> str:
    """Metrics table over ``predictions`` as evaluate_all gives it."""
    mae, rmse, mape = "sum(a) / sum(c)", "sqrt(sum(s) / sum(c))", "sum(q) / sum(c) * 100"
    precision = "sum(tp) / greatest(sum(tp) + sum(fp), 1)"
    recall = "sum(tp) / greatest(sum(tp) + sum(fn), 1)"
    f1 = f"2 * ({precision}) * ({recall}) / greatest({precision} + {recall}, 1e-8::DOUBLE)"
    accuracy = "(sum(tp) + sum(tn)) / greatest(sum(c), 1)"
    none = "NULL::DOUBLE AS precision, NULL::DOUBLE AS recall, NULL::DOUBLE AS f1, NULL::DOUBLE AS accuracy, NULL::BIGINT AS total_overload_events, NULL::BIGINT AS predicted_overload_events"

    def only_cpu(e, name, kind="DOUBLE"):
        return f"CASE WHEN contains(target, 'cpu') OR contains(target, 'util') THEN {e} END::{kind} AS {name}"

    return f"""
SELECT model, 'overall' AS scope, NULL::VARCHAR AS target, NULL::INT AS step,
  {q.r(mae)} AS mae, {q.r(rmse)} AS rmse, {q.r(mape, digits_mape)} AS mape, {none} FROM sums GROUP BY model
UNION ALL SELECT model, 'per_target', target, NULL, {q.r(mae)}, {q.r(rmse)}, {q.r(mape, digits_mape)},
  {only_cpu(q.four(precision), 'precision')}, {only_cpu(q.four(recall), 'recall')},
  {only_cpu(q.four(f1), 'f1')}, {only_cpu(q.four(accuracy), 'accuracy')},
  {only_cpu('sum(tp) + sum(fn)', 'total_overload_events', 'BIGINT')},
  {only_cpu('sum(tp) + sum(fp)', 'predicted_overload_events', 'BIGINT')}
FROM sums GROUP BY model, target
UNION ALL SELECT model, 'per_horizon', NULL, step, {q.nearest(mae, 4)}, {q.nearest(rmse, 4)}, NULL, {none}
FROM sums GROUP BY model, step"""


_EVALUATION = f"""{q.predictions('events')},
  tested AS (SELECT * FROM predictions WHERE split = 'test'),
  {q.errors('model, target, step', 'tested')}{_metric_rows()}"""


@query("a9_metrics_round_trip", _EVALUATION)
def a9_metrics_round_trip(spark, sf_dir):
    path = scratch_folder(spark, "metrics")
    tables.write_metrics(evaluate.evaluate_by_split(_predictions(spark, sf_dir, split="test")), path)
    return rounded(tables.read_metrics(spark, path), mape=2)


@query("a9_metrics_from_json", _EVALUATION)
def a9_metrics_from_json(spark, sf_dir):
    """Metrics as one JSON document per model, read back as rows."""
    path = scratch_folder(spark, "metrics")
    metrics = evaluate.evaluate_by_split(_predictions(spark, sf_dir, split="test"))

    def of(scope, value):
        return F.when(F.col("scope") == scope, value)

    regression = F.struct("mae", "rmse", "mape")
    events = F.struct(*[f.name for f in tables.METRICS_SCHEMA.fields[6:12]])
    metrics.groupBy("model").agg(
        F.first(of("overall", regression), ignorenulls=True).alias("overall"),
        F.map_from_entries(F.collect_list(of("per_target", F.struct("target", regression)))).alias("per_target"),
        F.collect_list(of("per_horizon", F.struct("step", "mae", "rmse"))).alias("per_horizon"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("accuracy").isNotNull(), F.struct("target", events)))
        ).alias("overload"),
    ).write.partitionBy("model").json(path)
    _renamed(spark, path, lambda model: f"{model}_metrics.json")
    return rounded(tables.read_metrics_json(spark, f"{path}/*_metrics.json"), mape=2)


# ---------------------------------------------------------------- cleaning


@query(
    "b1_decode_timestamp",
    f"WITH usage AS ({q.USAGE['events']}) SELECT event_id, make_timestamp(start_time) AS timestamp FROM usage",
)
def b1_decode_timestamp(spark, sf_dir):
    return clean.decode_timestamp(events_usage(spark, sf_dir)).select("event_id", "timestamp")


@query(
    "b2_rename_usage",
    f"""WITH usage AS ({q.USAGE['events']}) SELECT event_id, {q.r('avg_cpu')} AS cpu_usage,
{q.r('avg_memory')} AS memory_usage, {q.r('max_cpu')} AS max_cpu_usage, {q.r('max_memory')} AS max_memory_usage FROM usage""",
)
def b2_rename_usage(spark, sf_dir):
    renamed = clean.rename_usage(events_usage(spark, sf_dir))
    return rounded(renamed.select("event_id", *clean.PERCENT_COLUMNS))


def _holes(df: DataFrame) -> DataFrame:
    """Usage with missing cpu, memory and ids."""
    e = F.col("event_id")
    return df.withColumns(
        {
            "avg_cpu": F.when(e % 11 != 0, F.when(e % 17 == 0, -F.col("avg_cpu")).otherwise(F.col("avg_cpu"))),
            "avg_memory": F.when(e % 19 != 0, F.col("avg_memory")),
            "machine_id": F.when(e % 13 != 0, F.col("machine_id")),
        }
    )


_HOLES = f"""WITH whole AS ({q.USAGE['events']}),
  usage AS (SELECT * REPLACE (
    CASE WHEN event_id % 11 <> 0 THEN CASE WHEN event_id % 17 = 0 THEN -avg_cpu ELSE avg_cpu END END AS avg_cpu,
    CASE WHEN event_id % 19 <> 0 THEN avg_memory END AS avg_memory,
    CASE WHEN event_id % 13 <> 0 THEN machine_id END AS machine_id) FROM whole)"""


@query(
    "b3_to_percent",
    f"""{_HOLES} SELECT event_id, {q.r(q.clip('avg_cpu * 100'))} AS cpu_usage,
{q.r(q.clip('avg_memory * 100'))} AS memory_usage, {q.r(q.clip('max_cpu * 100'))} AS max_cpu_usage,
{q.r(q.clip('max_memory * 100'))} AS max_memory_usage FROM usage""",
)
def b3_to_percent(spark, sf_dir):
    percent = clean.to_percent(clean.rename_usage(_holes(events_usage(spark, sf_dir))))
    return rounded(percent.select("event_id", *clean.PERCENT_COLUMNS))


@query(
    "b4_drop_incomplete",
    f"""{_HOLES} SELECT event_id, machine_id, {q.r('avg_cpu')} AS cpu_usage, {q.r('avg_memory')} AS memory_usage
FROM usage WHERE avg_cpu IS NOT NULL AND avg_memory IS NOT NULL AND machine_id IS NOT NULL""",
)
def b4_drop_incomplete(spark, sf_dir):
    complete = clean.drop_incomplete(clean.rename_usage(_holes(events_usage(spark, sf_dir))))
    return rounded(complete.select("event_id", *clean.REQUIRED_USAGE))


_CLEAN_COLUMNS = [
    "cpu_usage", "memory_usage", "max_cpu_usage", "max_memory_usage", "assigned_memory",
    "cycles_per_instruction",
]


@query(
    "b5_clean_usage",
    f"""WITH {q.cleaned('events')} SELECT timestamp, machine_id, collection_id,
{_round_list(_CLEAN_COLUMNS)} FROM cleaned""",
)
def b5_clean_usage(spark, sf_dir):
    return rounded(_cleaned(spark, sf_dir))


@query(
    "b6_sort_by_time",
    f"WITH {q.cleaned('events')} SELECT timestamp, machine_id, {q.r('cpu_usage')} AS cpu_usage FROM cleaned ORDER BY timestamp NULLS LAST",
)
def b6_sort_by_time(spark, sf_dir):
    cleaned = _cleaned(spark, sf_dir).select("timestamp", "machine_id", "cpu_usage")
    return clean.sort_by_time(rounded(cleaned))


@query(
    "b7_profile",
    f"""WITH {q.cleaned('lines')} SELECT count(*) AS row_count, count(DISTINCT machine_id) AS machine_count,
min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp FROM cleaned""",
)
def b7_profile(spark, sf_dir):
    return clean.profile(clean.clean_usage(line_usage(spark, sf_dir)))


_COERCED = f"""texts AS ({q.TEXT_TELEMETRY}),
  typed AS (SELECT machine_id, TRY_CAST(trim(cpu_usage) AS DOUBLE) AS cpu_usage,
      TRY_CAST(trim(memory_usage) AS DOUBLE) AS memory_usage,
      TRY_CAST(trim(assigned_memory) AS DOUBLE) AS assigned_memory, row_order FROM texts)"""


@query(
    "b10_coerce_numeric",
    f"WITH {_COERCED} SELECT row_order, {_round_list(FEATURES)} FROM typed",
)
def b10_coerce_numeric(spark, sf_dir):
    typed = clean.coerce_numeric(text_telemetry(spark, sf_dir), EVENTS.features)
    return rounded(typed.select("row_order", *FEATURES))


@query(
    "b11_resolve_features",
    f"""WITH {_COERCED} SELECT row_order, {_round_list(FEATURES)}, 0.0::DOUBLE AS cycles_per_instruction,
'Column ''cycles_per_instruction'' missing; filled with 0.' AS warning FROM typed""",
)
def b11_resolve_features(spark, sf_dir):
    typed = clean.coerce_numeric(text_telemetry(spark, sf_dir), EVENTS.features)
    padded, names, warnings = clean.resolve_features(typed, EVENTS, 4)
    return rounded(padded.select("row_order", *names, F.lit(", ".join(warnings)).alias("warning")))


@query(
    "b12_default_machine",
    f"""WITH {_COERCED} SELECT machine_id, count(*) AS row_count FROM typed WHERE machine_id IS NOT NULL GROUP BY 1
UNION ALL SELECT 'uploaded', count(*) FROM typed""",
)
def b12_default_machine(spark, sf_dir):
    telemetry = text_telemetry(spark, sf_dir)
    named, _ = clean.default_machine(telemetry)
    single, _ = clean.default_machine(telemetry.drop("machine_id"))
    ids = named.select("machine_id").unionByName(single.select("machine_id"))
    return ids.groupBy("machine_id").agg(F.count(F.lit(1)).alias("row_count"))


# ---------------------------------------------------------------- rollup and aggregates

_ROLLED = [*FEATURES, "max_cpu_usage", "max_memory_usage"]


@query(
    "c1_rollup_machine",
    f"""WITH {q.rolled('events')} SELECT timestamp, machine_id, running_jobs_count, {_round_list(_ROLLED)} FROM summed""",
)
def c1_rollup_machine(spark, sf_dir):
    return rounded(rollup.rollup_machine(_cleaned(spark, sf_dir)))


@query(
    "c1_rollup_machine_lines",
    f"""WITH {q.rolled('lines')} SELECT timestamp, machine_id, running_jobs_count, {_round_list(TARGETS)} FROM summed""",
)
def c1_rollup_machine_lines(spark, sf_dir):
    return rounded(rollup.rollup_machine(clean.clean_usage(line_usage(spark, sf_dir))))


@query(
    "c2_clip_rollup",
    f"""WITH {q.rolled('events')} SELECT timestamp, machine_id, running_jobs_count, {_round_list(_ROLLED)} FROM rolled""",
)
def c2_clip_rollup(spark, sf_dir):
    return rounded(_rolled(spark, sf_dir))


_TOP = "top AS (SELECT machine_id, count(*) AS record_count FROM rolled GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8)"


@query("c3_top_machines", f"WITH {q.rolled('users')}, {_TOP} SELECT * FROM top")
def c3_top_machines(spark, sf_dir):
    return rollup.top_machines(_rolled(spark, sf_dir, user_usage, count_jobs=False))


@query(
    "c4_restrict_to",
    f"""WITH {q.rolled('users')}, {_TOP} SELECT timestamp, machine_id, running_jobs_count, {_round_list(_ROLLED)}
FROM rolled WHERE machine_id IN (SELECT machine_id FROM top)""",
)
def c4_restrict_to(spark, sf_dir):
    return rounded(rollup.restrict_to(_rolled(spark, sf_dir, user_usage)))


@query(
    "c5_resample_mean",
    f"""WITH {q.bins('events', q.columns('events') + ['running_jobs_count'])} SELECT machine_id, bin_no, make_timestamp(bin_no * 300000000) AS bin,
{_round_list(_ROLLED + ['running_jobs_count'])} FROM bins""",
)
def c5_resample_mean(spark, sf_dir):
    return rounded(resample.with_bin_start(resample.resample_mean(_rolled(spark, sf_dir), EVENTS), EVENTS))


def _followed(spark, sf_dir, source, config):
    """All usage rows as a stream: three sets of files in time order; the stream ends after each
    and goes on from its checkpoint."""
    raw = source(spark, sf_dir)
    low, high = raw.agg(F.min("start_time"), F.max("start_time")).first()
    third = (high - low) // 3 + 1
    folder = scratch_folder(spark, "stream")
    part = F.floor((F.coalesce("start_time", F.lit(low)) - low) / third)
    raw.withColumn("part", part).write.partitionBy("part").parquet(f"{folder}/parts")
    parts = spark.read.parquet(f"{folder}/parts")
    for at in range(3):
        parts.filter(F.col("part") == at).select(raw.columns).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(raw.schema).parquet(f"{folder}/in")
        feed, running = streams.follow(stream, f"{folder}/out", config, TARGETS)
        running.awaitTermination()
    return feed


def _closed(sql: str, config: PipelineConfig) -> str:
    """The SQL with only those bins that end at or before the newest row."""
    micros = config.interval_micros
    return sql.replace(
        "FROM rolled GROUP BY",
        f"""FROM rolled WHERE (epoch_us(timestamp) // {micros} + 1) * {micros}
      <= (SELECT epoch_us(max(timestamp)) FROM rolled) GROUP BY""",
    )


@query(
    "c5_stream_bins",
    f"""WITH {_closed(q.bins('events'), EVENTS)} SELECT machine_id, bin_no,
make_timestamp(bin_no * 300000000) AS bin, {_round_list(_ROLLED)} FROM bins""",
)
def c5_stream_bins(spark, sf_dir):
    return rounded(_followed(spark, sf_dir, events_usage, EVENTS).bins(spark))


@query(
    "g1_stream_forecast",
    f"""{_closed(q.series('users'), USERS)},
  ends AS (SELECT machine_id, max(bin_no) AS last_bin, avg(cpu_usage) AS cpu_usage, avg(memory_usage) AS memory_usage
    FROM series WHERE n >= 60 AND rn >= n - 12 GROUP BY 1),
  ahead AS (SELECT *, unnest(generate_series(0, 11))::INT AS step FROM ends)
SELECT machine_id, last_bin, step, last_bin + step + 1 AS bin_no,
  make_timestamp((last_bin + step + 1) * 3600000000) AS bin, {_round_list(TARGETS)} FROM ahead""",
)
def g1_stream_forecast(spark, sf_dir):
    return rounded(_followed(spark, sf_dir, user_usage, USERS).latest_forecasts(spark).drop("batch"))


@query("c6_fit_minmax", f"{q.series('events')}, {q.scalers(FEATURES)} {_LONG_BOUNDS}")
def c6_fit_minmax(spark, sf_dir):
    return rounded(scale.fit_minmax(_events(spark, sf_dir), FEATURES, EVENTS))


_USABLE = f"""WITH {_COERCED}, usable AS (SELECT * FROM typed
  WHERE machine_id IS NOT NULL AND cpu_usage IS NOT NULL AND memory_usage IS NOT NULL),
  bounds AS (SELECT machine_id, {', '.join(f'min({c}) AS {c}_lo, max({c}) AS {c}_hi' for c in FEATURES)},
    count(*) AS n FROM usable GROUP BY 1)"""


def _usable(spark, sf_dir):
    named, _ = clean.default_machine(
        clean.coerce_numeric(text_telemetry(spark, sf_dir), EVENTS.features)
    )
    return clean.drop_incomplete(named, clean.REQUIRED_TELEMETRY)


@query("c7_fit_minmax_all", f"{_USABLE} {_LONG_BOUNDS}")
def c7_fit_minmax_all(spark, sf_dir):
    return rounded(scale.fit_minmax_all(_usable(spark, sf_dir), FEATURES))


def _overview_sql(kind: str) -> str:
    return f"""{q.series(kind)},
  overview AS (SELECT machine_id AS id, nw - train_end - val_count AS num_windows,
      cpu_usage AS latest_cpu, memory_usage AS latest_memory,
      {q.tenth('40.0::DOUBLE + cpu_usage * 0.4::DOUBLE')} AS latest_temperature,
      {q.tenth('80.0::DOUBLE + cpu_usage * 2.5::DOUBLE')} AS latest_power,
      trunc(least(10.0::DOUBLE, greatest(0.0::DOUBLE, cpu_usage / 25)))::INT AS latest_jobs,
      CASE WHEN cpu_usage > 80 THEN 'high' WHEN cpu_usage > 60 THEN 'medium'
        WHEN cpu_usage > 30 THEN 'normal' ELSE 'low' END AS status
    FROM latest WHERE step = 59)"""


@query(
    "c8_cluster_average",
    f"{_overview_sql('users')} SELECT {q.r('coalesce(avg(latest_cpu), 0.0)')} AS avg_cluster_cpu FROM overview",
)
def c8_cluster_average(spark, sf_dir):
    return rounded(reports.cluster_average(_states(spark, sf_dir)))


@query(
    "c9_fleet_kpis",
    f"""{_overview_sql('users')} SELECT {q.r('avg(coalesce(latest_cpu, 0))')} AS cluster_utilization,
{q.r('sum(coalesce(latest_power, 0)) / 1000')} AS total_power_kw,
{q.r("coalesce(max(latest_temperature) FILTER (id = '1'), 0)")} AS selected_temperature,
{q.r('avg(latest_temperature)')} AS avg_temperature FROM overview""",
)
def c9_fleet_kpis(spark, sf_dir):
    return rounded(reports.fleet_kpis(_states(spark, sf_dir), selected="1"))


_POINTS = f"""{q.series('users')},
  ahead AS (SELECT machine_id, unnest(generate_series(0, 11))::INT AS step, cpu_usage, memory_usage FROM (
    SELECT machine_id, avg(cpu_usage) AS cpu_usage, avg(memory_usage) AS memory_usage
    FROM latest WHERE step >= 48 GROUP BY 1)),
  points AS (SELECT machine_id, 'history' AS kind, step, cpu_usage, memory_usage, assigned_memory FROM latest
    UNION ALL SELECT machine_id, 'forecast', step, cpu_usage, memory_usage, NULL FROM ahead)"""


@query(
    "c10_overload_risk",
    f"""{_POINTS} SELECT machine_id, {q.r('greatest(0.0::DOUBLE, max(coalesce(cpu_usage, 0)))')} AS overload_pct,
greatest(0.0::DOUBLE, max(coalesce(cpu_usage, 0))) > 30 AS alert FROM points WHERE kind = 'forecast' GROUP BY 1""",
)
def c10_overload_risk(spark, sf_dir):
    return rounded(reports.overload_risk(_points(spark, sf_dir)))


# ---------------------------------------------------------------- joins


@query(
    "d1_with_scaler",
    f"""{q.series('pairs')}, {q.scalers(['cpu_usage'])}
SELECT s.machine_id, s.bin, {q.r('s.cpu_usage')} AS cpu_usage, {q.r('cpu_usage_lo')} AS cpu_usage__min,
{q.r('cpu_usage_hi')} AS cpu_usage__max FROM series s LEFT JOIN bounds b ON s.machine_id = b.machine_id""",
)
def d1_with_scaler(spark, sf_dir):
    series = _pairs(spark, sf_dir)
    scalers = scale.fit_minmax(windows.reject_short(series, USERS), ["cpu_usage"], USERS)
    rows = series.select("machine_id", "bin", "cpu_usage")
    return rounded(scale.with_scaler(rows, scalers, ["cpu_usage"]))


@query(
    "d2_known_machines",
    f"""{q.series('users')}, requested AS (SELECT c_custkey::VARCHAR AS machine_id FROM customer)
SELECT machine_id, machine_id IN (SELECT machine_id FROM series) AS known FROM requested""",
)
def d2_known_machines(spark, sf_dir):
    requested = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("machine_id")
    )
    return reports.known_machines(_users(spark, sf_dir), requested)


def _history_table(spark, sf_dir):
    """Loss curves per event type: daily means, the second ending ten days earlier."""
    daily = (
        table(spark, sf_dir, "events")
        .groupBy("event_type", F.to_date("ts").alias("day"))
        .agg(
            F.avg("value").alias("loss"),
            F.avg(F.get_json_object("props", "$.k").cast("double")).alias("other"),
        )
    )
    curve = F.sort_array(F.collect_list(F.struct("day", "loss", "other")))
    return (
        daily.groupBy(F.concat_ws("_", F.lit("moving_avg"), "event_type").alias("name"))
        .agg(curve.alias("curve"))
        .select(
            "name",
            F.col("curve.loss").alias("train_loss"),
            F.slice("curve.other", F.lit(1), F.size("curve") - 10).alias("val_loss"),
            F.transform("curve", lambda _: F.lit(0.001)).alias("lr"),
        )
    )


def _models_table(spark):
    return models.models_table(
        spark, [forecast.MovingAverage(window=12), forecast.MovingAverage(window=24)]
    )


_MODELS = """models AS (SELECT * FROM (VALUES
    ('moving_avg_12', 'moving_average', 0::BIGINT, 12), ('moving_avg_24', 'moving_average', 0::BIGINT, 24)
  ) t(name, kind, num_params, width))"""
_METRICS = f"""{q.predictions('events', (3, 12))},
  tested AS (SELECT * FROM predictions WHERE split = 'test'),
  {q.errors('model', 'tested')}, {_MODELS}"""


def _two_model_metrics(spark, sf_dir):
    """Metrics of two averaging widths, one of which is not among the loaded models."""
    return evaluate.evaluate_by_split(_predictions(spark, sf_dir, (3, 12), "test"))


@query(
    "a10_read_history",
    f"""WITH daily AS (SELECT event_type, ts::DATE AS day, avg(value) AS loss, avg({q.K}) AS other,
    row_number() OVER (PARTITION BY event_type ORDER BY ts::DATE) AS epoch, count(*) OVER (PARTITION BY event_type) AS epochs
  FROM events GROUP BY 1, 2)
SELECT 'moving_avg_' || event_type AS name, epoch::INT AS epoch, {q.r('loss')} AS train_loss,
  CASE WHEN epoch <= epochs - 10 THEN {q.r('other')} END AS val_loss, 0.001::DOUBLE AS lr FROM daily""",
)
def a10_read_history(spark, sf_dir):
    """Training histories as one JSON document per model, read back and unfolded."""
    path = scratch_folder(spark, "histories")
    _history_table(spark, sf_dir).write.partitionBy("name").json(path)
    _renamed(spark, path, lambda name: f"{name}_history.json")
    read = tables.read_history(spark, f"{path}/*_history.json")
    curves = ("train_loss", "val_loss", "lr")
    unfolded = read.select("name", F.posexplode(F.arrays_zip(*curves)).alias("at", "v"))
    return rounded(
        unfolded.select("name", (F.col("at") + 1).alias("epoch"), *[F.col("v")[c].alias(c) for c in curves])
    )


@query(
    "d3_model_sidecars",
    f"""{_METRICS}, curves AS (SELECT DISTINCT 'moving_avg_' || event_type AS name FROM events)
SELECT coalesce(m.name, s.model, c.name) AS name, m.name IS NOT NULL AS loaded, s.model IS NOT NULL AS has_metrics,
  c.name IS NOT NULL AS has_history
FROM models m FULL JOIN sums s ON m.name = s.model FULL JOIN curves c ON c.name = coalesce(m.name, s.model)""",
)
def d3_model_sidecars(spark, sf_dir):
    return models.model_sidecars(
        _models_table(spark), _two_model_metrics(spark, sf_dir), _history_table(spark, sf_dir)
    )


# ---------------------------------------------------------------- series and windows


@query(
    "e1_gap_spine",
    f"WITH {q.filled('events')} SELECT machine_id, bin_no, {_round_list(q.columns('events'))} FROM gridded",
)
def e1_gap_spine(spark, sf_dir):
    return rounded(resample.gap_spine(_bins(spark, sf_dir), EVENTS))


@query(
    "e2_ffill",
    f"""WITH {q.filled('events')} SELECT machine_id, bin_no, make_timestamp(bin_no * 300000000) AS bin,
{_round_list(q.columns('events'))} FROM filled WHERE reached = 1""",
)
def e2_ffill(spark, sf_dir):
    return rounded(resample.forward_fill(_bins(spark, sf_dir), EVENTS))


@query(
    "e3_e4_regular_series",
    f"{q.series('events')} SELECT machine_id, bin, rn, n, {_round_list(q.columns('events'))} FROM series",
)
def e3_e4_regular_series(spark, sf_dir):
    return rounded(_events(spark, sf_dir).drop("bin_no"))


@query(
    "e4_row_position_lines",
    f"{q.series('lines')} SELECT machine_id, bin, rn, n, {_round_list(TARGETS)} FROM series",
)
def e4_row_position_lines(spark, sf_dir):
    return rounded(_lines(spark, sf_dir).drop("bin_no"))


@query(
    "e5_sliding_windows",
    f"{q.series('events')} SELECT machine_id, window_idx, split, bin, {_round_list(TARGETS)} FROM windows",
)
def e5_sliding_windows(spark, sf_dir):
    made = windows.sliding_windows(_events(spark, sf_dir), EVENTS)
    return rounded(made.select("machine_id", "window_idx", "split", "bin", *TARGETS))


@query("e5_array_windows", _WINDOW_DIGEST)
def e5_array_windows(spark, sf_dir):
    """Window arrays, checked by size, ends and sums."""
    return _window_digest(_user_windows(spark, sf_dir))


GAPPY = PipelineConfig(interval_seconds=3_600, sequence_length=4, horizon=2, block_rows=16)


@query(
    "e5_windows_within_gaps",
    f"""{q.series('users')},
  parted AS (SELECT *, coalesce(bin_no - lag(bin_no) OVER (PARTITION BY machine_id ORDER BY rn) > 7, FALSE) AS starts FROM series),
  islands AS (SELECT *, sum(starts::INT) OVER (PARTITION BY machine_id ORDER BY rn) AS island FROM parted),
  framed AS (SELECT *, lag(island, 3) OVER o AS first_island, lead(island, 2) OVER o AS last_island FROM islands
    WINDOW o AS (PARTITION BY machine_id ORDER BY rn)),
  kept AS (SELECT machine_id, bin, rn, row_number() OVER (PARTITION BY machine_id ORDER BY rn) - 1 AS window_idx,
    count(*) OVER (PARTITION BY machine_id) AS total FROM framed WHERE first_island = last_island)
SELECT machine_id, bin, rn, window_idx, CASE WHEN window_idx < floor(total * 0.7::DOUBLE) THEN 'train'
  WHEN window_idx < floor(total * 0.7::DOUBLE) + floor(total * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM kept""",
)
def e5_windows_within_gaps(spark, sf_dir):
    """Windows that run over no more than six missing hours, in blocks of a few rows."""
    kept = windows.windows_within_gaps(_users(spark, sf_dir), GAPPY, max_gap=6)
    return kept.select("machine_id", "bin", "rn", "window_idx", "split")


@query(
    "e6_reject_short",
    f"""{q.series('pairs')}, inputs AS (SELECT DISTINCT machine_id FROM rolled)
SELECT i.machine_id, coalesce(max(n), 0) AS n,
  'Data length (' || coalesce(max(n), 0)::VARCHAR || ') < required (72).' AS reason
FROM inputs i LEFT JOIN series s ON i.machine_id = s.machine_id GROUP BY 1 HAVING coalesce(max(n), 0) < 72""",
)
def e6_reject_short(spark, sf_dir):
    rolled = _rolled(spark, sf_dir, pair_usage, count_jobs=False)
    series = resample.regular_series(rolled, USERS)
    return windows.skipped_machines(series, USERS, rolled.select("machine_id").distinct())


@query(
    "e7_split_chronological",
    f"""{q.series('lines')} SELECT machine_id, split, count(*) AS window_count, min(window_idx) AS first_window,
max(window_idx) AS last_window FROM windows GROUP BY 1, 2""",
)
def e7_split_chronological(spark, sf_dir):
    made = windows.sliding_windows(_lines(spark, sf_dir), LINES)
    return made.groupBy("machine_id", "split").agg(
        F.count(F.lit(1)).alias("window_count"),
        F.min("window_idx").alias("first_window"),
        F.max("window_idx").alias("last_window"),
    )


@query(
    "e7_window_counts",
    f"""{q.series('pairs')} SELECT machine_id, nw AS num_windows, train_end AS train_windows,
val_count AS val_windows, nw - train_end - val_count AS test_windows FROM marks WHERE rn = 0""",
)
def e7_window_counts(spark, sf_dir):
    return windows.window_counts(_pairs(spark, sf_dir), USERS)


@query(
    "e8_prepare",
    f"""{q.series('events')}, {q.scalers(FEATURES)} SELECT w.machine_id, window_idx, split, bin,
{', '.join(f'{q.r(q.scaled(c))} AS {c}' for c in FEATURES)}
FROM windows w JOIN bounds b ON w.machine_id = b.machine_id""",
)
def e8_prepare(spark, sf_dir):
    ready = pipeline.prepare(_rolled(spark, sf_dir, count_jobs=False), EVENTS)
    return rounded(ready.windows.select("machine_id", "window_idx", "split", "bin", *ready.features))


@query("e8_prepare_arrays", _WINDOW_DIGEST)
def e8_prepare_arrays(spark, sf_dir):
    """Inputs and targets of all splits, as prepare hands them out."""
    ready = pipeline.prepare(_rolled(spark, sf_dir, user_usage, count_jobs=False), USERS)
    return _window_digest(ready.arrays())


@query(
    "e9_latest_window",
    f"{q.series('users')} SELECT machine_id, step, bin, {_round_list(FEATURES)} FROM latest",
)
def e9_latest_window(spark, sf_dir):
    latest = windows.latest_window(_users(spark, sf_dir), USERS)
    return rounded(latest.select("machine_id", "step", "bin", *FEATURES))


@query(
    "e9_latest_stored_forecast",
    f"""{q.series('users')}, ahead AS (SELECT machine_id, avg(cpu_usage) AS cpu_usage, avg(memory_usage) AS memory_usage
  FROM latest WHERE step >= 48 GROUP BY 1)
SELECT machine_id, unnest(generate_series(0, 11))::INT AS step, {_round_list(TARGETS)} FROM ahead""",
)
def e9_latest_stored_forecast(spark, sf_dir):
    """Scaled windows and scalers written, read back, latest one scored and unscaled."""
    series = _users(spark, sf_dir)
    stored, bounds = scratch_folder(spark, "windows"), scratch_folder(spark, "scalers")
    blocks = windows.scaled_blocks(series, FEATURES, USERS, back=59, ahead=12)
    tables.write_windows(windows.array_windows(blocks, FEATURES, TARGETS, USERS), stored)
    tables.write_scalers(scale.fit_minmax(series, FEATURES, USERS), bounds)
    return rounded(
        pipeline.forecast_stored(
            tables.read_windows(spark, stored, latest_only=True),
            tables.read_scalers(spark, bounds), TARGETS,
            forecast.MovingAverage(),
        )
    )


@query(
    "e10_history",
    f"{q.series('users')} SELECT machine_id, step - 40 AS step, bin, {_round_list(FEATURES)} FROM latest WHERE step >= 40",
)
def e10_history(spark, sf_dir):
    recent = windows.history(_users(spark, sf_dir), USERS, steps=20)
    return rounded(recent.select("machine_id", "step", "bin", *FEATURES))


_TAIL = """tail AS (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY row_order DESC) AS back,
    count(*) OVER (PARTITION BY machine_id) AS n FROM usable QUALIFY back <= 60)"""


@query(
    "e11_last_rows",
    f"{_USABLE.replace(', bounds AS', ', unused AS')}, {_TAIL} SELECT machine_id, row_order, back, {_round_list(FEATURES)} FROM tail",
)
def e11_last_rows(spark, sf_dir):
    tail = windows.last_rows(_usable(spark, sf_dir), 60)
    return rounded(tail.select("machine_id", "row_order", "back", *FEATURES))


_ENOUGH = """counted AS (SELECT machine_id,
    count(*) FILTER (cpu_usage IS NOT NULL AND memory_usage IS NOT NULL) AS num_input_rows
  FROM typed WHERE machine_id IS NOT NULL GROUP BY 1)"""
_SHORT = """CASE WHEN num_input_rows < 60 THEN 'Not enough rows: ' || num_input_rows::VARCHAR
  || ' available, 60 required for a forecast.' END"""


@query(
    "e12_enough_rows",
    f"WITH {_COERCED.replace('user_id % 40', 'user_id')}, {_ENOUGH} SELECT machine_id, num_input_rows, {_SHORT} AS warning FROM counted",
)
def e12_enough_rows(spark, sf_dir):
    named, _ = clean.default_machine(text_telemetry(spark, sf_dir, machines=None))
    return windows.enough_rows(clean.coerce_numeric(named, EVENTS.features), EVENTS)


@query(
    "e13_step_label",
    """SELECT event_id, CASE WHEN o = 0 THEN 'now' WHEN o > 0 THEN '+' || (o * 5)::VARCHAR || 'm'
  ELSE (o * 5)::VARCHAR || 'm' END AS label FROM (SELECT event_id, user_id - 60 AS o FROM events)""",
)
def e13_step_label(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", derive.step_label(F.col("user_id") - 60).alias("label")
    )


# ---------------------------------------------------------------- scaling


@query(
    "f1_minmax_transform",
    f"""{q.series('events')}, {q.scalers(FEATURES)} SELECT m.machine_id, bin,
{', '.join(f'{q.r(q.scaled(c))} AS {c}' for c in FEATURES)} FROM marks m JOIN bounds b ON m.machine_id = b.machine_id""",
)
def f1_minmax_transform(spark, sf_dir):
    series = _events(spark, sf_dir)
    scalers = scale.fit_minmax(series, FEATURES, EVENTS)
    rows = series.select("machine_id", "bin", *FEATURES)
    return rounded(scale.minmax_transform(rows, scalers, FEATURES))


@query(
    "f2_inverse_features",
    f"""{q.series('pairs')}, {q.scalers(TARGETS)} SELECT s.machine_id, bin,
{', '.join(f"{q.r(f'coalesce(s.{c} * CASE WHEN {c}_hi = {c}_lo THEN 1 ELSE {c}_hi - {c}_lo END + {c}_lo, s.{c})')} AS {c}" for c in TARGETS)},
CASE WHEN b.machine_id IS NULL THEN 'No scaler for machine ''' || s.machine_id || '''; returning normalized values.' END AS unscaled_warning
FROM series s LEFT JOIN bounds b ON s.machine_id = b.machine_id""",
)
def f2_inverse_features(spark, sf_dir):
    """Inverse applied to arbitrary values; machines too short for a scaler keep them."""
    series = _pairs(spark, sf_dir)
    scalers = scale.fit_minmax(windows.reject_short(series, USERS), TARGETS, USERS)
    rows = series.select("machine_id", "bin", *TARGETS)
    return rounded(scale.inverse_features(rows, scalers, TARGETS))


@query(
    "f3_inverse_targets",
    f"""{q.series('users')}, {q.scalers(TARGETS)} SELECT m.machine_id, bin, {_round_list(TARGETS)}
FROM marks m""",
)
def f3_inverse_targets(spark, sf_dir):
    """Scaling and back gives the values that went in."""
    series = windows.reject_short(_users(spark, sf_dir), USERS)
    scalers = scale.fit_minmax(series, FEATURES, USERS)
    rows = series.select("machine_id", "bin", *TARGETS)
    there = scale.minmax_transform(rows, scalers, TARGETS)
    return rounded(scale.inverse_targets(there, scalers, TARGETS))


@query(
    "f4_inverse_upload",
    f"""{_USABLE} SELECT u.machine_id, row_order,
{q.r('cpu_usage * (CASE WHEN cpu_usage_hi = cpu_usage_lo THEN 1 ELSE cpu_usage_hi - cpu_usage_lo END) + cpu_usage_lo')} AS cpu_usage,
{q.r('memory_usage')} AS memory_usage FROM usable u JOIN bounds b ON u.machine_id = b.machine_id""",
)
def f4_inverse_upload(spark, sf_dir):
    """Only targets among the features are turned back."""
    rows = _usable(spark, sf_dir)
    scalers = scale.fit_minmax_all(rows, ["cpu_usage"])
    inverse, _ = scale.inverse_upload(
        rows.select("machine_id", "row_order", *TARGETS), scalers, ["cpu_usage"], TARGETS
    )
    return rounded(inverse)


_CONSTANT = "One or more feature columns had constant values; forecast may be degenerate."


@query(
    "f5_constant_column_warning",
    f"""{q.series('pairs')}, b AS (SELECT machine_id, min(max_cpu_usage) AS lo, max(max_cpu_usage) AS hi FROM series GROUP BY 1)
SELECT machine_id, CASE WHEN lo = hi THEN '{_CONSTANT}' END AS warning FROM b""",
)
def f5_constant_column_warning(spark, sf_dir):
    scalers = scale.fit_minmax_all(_pairs(spark, sf_dir), ["max_cpu_usage"])
    return scale.constant_columns(scalers)


# ---------------------------------------------------------------- forecasting


@query("g1_moving_average", f"{_POINTS} SELECT machine_id, step, {_round_list(TARGETS)} FROM ahead")
def g1_moving_average(spark, sf_dir):
    latest = windows.latest_window(_users(spark, sf_dir), USERS)
    return rounded(forecast.moving_average(latest, USERS, TARGETS))


@query(
    "g1_moving_average_windows",
    f"""{q.predictions('events')} SELECT machine_id, window_idx, split, model, target, count(*) AS steps,
{q.r('sum(y_true * step)', 9)} AS weighted_truth, {q.r('min(y_pred)', 9)} AS lowest, {q.r('max(y_pred)', 9)} AS highest
FROM predictions GROUP BY 1, 2, 3, 4, 5""",
)
def g1_moving_average_windows(spark, sf_dir):
    """Every window scored; truth is checked by a sum weighted with the step."""
    return rounded(
        _predictions(spark, sf_dir)
        .groupBy("machine_id", "window_idx", "split", "model", "target")
        .agg(
            F.count(F.lit(1)).alias("steps"),
            F.sum(F.col("y_true") * F.col("step")).alias("weighted_truth"),
            F.min("y_pred").alias("lowest"),
            F.max("y_pred").alias("highest"),
        ),
        9,
    )


# A window of two rows and one step ahead: the normal equations are three by three, so SQL
# can solve them. The same code fits any window.
PAIRS_AHEAD = PipelineConfig(interval_seconds=3_600, sequence_length=2, horizon=1)
def _small_fit_sql(penalty: str, machine: str = "", group: str = "") -> str:
    """Two rows and a bias to one row ahead, by Cramer's rule; pooled or per machine."""
    return f"""{q.series('users')},
  long AS (SELECT * FROM series WHERE n >= 3),
  range_of AS (SELECT machine_id, min(cpu_usage) AS cpu_usage_lo, max(cpu_usage) AS cpu_usage_hi FROM long
    WHERE rn < floor(n * 0.7::DOUBLE) GROUP BY 1),
  scaled AS (SELECT l.machine_id, rn, n, {q.scaled('cpu_usage')} AS c FROM long l JOIN range_of r ON l.machine_id = r.machine_id),
  framed AS (SELECT machine_id, rn, n, lag(c) OVER w AS p, c AS r, lead(c) OVER w AS y FROM scaled
    WINDOW w AS (PARTITION BY machine_id ORDER BY rn)),
  sums AS (SELECT {machine}count(*)::DOUBLE AS k, {penalty} AS l, sum(p) AS p, sum(r) AS r, sum(y) AS y,
      sum(p * p) AS pp, sum(p * r) AS pr, sum(r * r) AS rr, sum(p * y) AS py, sum(r * y) AS ry
    FROM framed WHERE rn >= 1 AND rn < n - 1 AND rn - 1 < floor((n - 2) * 0.7::DOUBLE) {group}),
  solved AS (SELECT *, (pp + l) * ((rr + l) * k - r * r) - pr * (pr * k - r * p) + p * (pr * r - (rr + l) * p) AS det,
      py * ((rr + l) * k - r * r) - pr * (ry * k - r * y) + p * (ry * r - (rr + l) * y) AS d0,
      (pp + l) * (ry * k - r * y) - py * (pr * k - r * p) + p * (pr * y - ry * p) AS d1,
      (pp + l) * ((rr + l) * y - ry * r) - pr * (pr * y - ry * p) + py * (pr * r - (rr + l) * p) AS d2 FROM sums),
  fitted AS (SELECT {machine}0 AS input, d0 / det AS weight FROM solved UNION ALL SELECT {machine}1, d1 / det FROM solved
    UNION ALL SELECT {machine}2, d2 / det FROM solved)"""


_SMALL_FIT = _small_fit_sql("count(*) * 1e-5::DOUBLE / 2")


def _small_fit(spark, sf_dir):
    columns = ["cpu_usage"]
    return forecast.linear_fit(_users(spark, sf_dir), PAIRS_AHEAD, columns, columns, train_on="all")


@query("g2_linear_fit", f"{_SMALL_FIT} SELECT input, {q.r('weight')} AS weight FROM fitted")
def g2_linear_fit(spark, sf_dir):
    """Weights of both rows and the bias (input 2), over the train windows of all machines."""
    model = _small_fit(spark, sf_dir)
    values = [*model.weights[:, 0].tolist(), float(model.bias[0])]
    return rounded(spark.createDataFrame(list(enumerate(values)), "input int, weight double"))


class Ridge:
    """A user's model: ridge regression on the flattened window, bias not penalised."""

    name = "ridge"

    def __init__(self, inputs: int, outputs: int, penalty: float):
        self.inputs, self.outputs, self.penalty = inputs, outputs, penalty

    def partial(self, x, y):
        design = np.column_stack([x.reshape(len(x), -1), np.ones(len(x))])
        return np.concatenate([(design.T @ design).ravel(), (design.T @ y.reshape(len(y), -1)).ravel()])

    def merge(self, states):
        return states.sum(axis=0)

    def finish(self, state):
        width = self.inputs + 1
        left, right = state[: width * width].reshape(width, width), state[width * width :].reshape(width, -1)
        return np.linalg.solve(left + np.diag([self.penalty] * self.inputs + [0.0]), right)

    def predictor(self, parameters):
        weights = parameters.reshape(self.inputs + 1, self.outputs)
        return lambda x: (x.reshape(len(x), -1) @ weights[:-1] + weights[-1]).reshape(len(x), 1, -1)


RIDGE = Ridge(2, 1, 3.0)


@query("g7_ridge_fit", f"{_small_fit_sql('3.0::DOUBLE')} SELECT input, {q.r('weight')} AS weight FROM fitted")
def g7_ridge_fit(spark, sf_dir):
    """A user-defined model fitted in parts over all machines, read off by scoring."""
    columns = ["cpu_usage"]
    model = training.fit(_users(spark, sf_dir), PAIRS_AHEAD, columns, columns, RIDGE, train_on="all")
    x = spark.createDataFrame([(i, [[float(i == 0)], [float(i == 1)]]) for i in range(3)], "input int, x array<array<double>>")
    scored = forecast.score(x, model).select("input", F.col("forecast")[0][0].alias("y"))
    bias = scored.filter("input = 2").select(F.col("y").alias("bias"))
    weight = F.when(F.col("input") == 2, F.col("bias")).otherwise(F.col("y") - F.col("bias"))
    # Three rows against one.
    return rounded(scored.join(F.broadcast(bias)).select("input", weight.alias("weight")))


_RIDGES = _small_fit_sql("3.0::DOUBLE", "machine_id, ", "GROUP BY machine_id")


@query(
    "g7_ridge_fit_each",
    f"{_RIDGES} SELECT machine_id, k::BIGINT AS windows, input, {q.r('weight')} AS weight "
    "FROM fitted JOIN sums USING (machine_id)",
)
def g7_ridge_fit_each(spark, sf_dir):
    """The same model, one per machine."""
    columns = ["cpu_usage"]
    models = training.fit_each(_users(spark, sf_dir), PAIRS_AHEAD, columns, columns, RIDGE)
    parts = models.select("machine_id", "windows", F.posexplode("parameters").alias("input", "weight"))
    return rounded(parts)


@query(
    "g7_ridge_score_each",
    f"""{_RIDGES}, w AS (SELECT machine_id, max(CASE input WHEN 0 THEN weight END) AS w0,
    max(CASE input WHEN 1 THEN weight END) AS w1, max(CASE input WHEN 2 THEN weight END) AS w2 FROM fitted GROUP BY 1)
SELECT s.machine_id, max(s.n) - 3 AS window_idx,
  {q.r('max(w0) * max(CASE WHEN s.rn = s.n - 3 THEN c END) + max(w1) * max(CASE WHEN s.rn = s.n - 2 THEN c END) + max(w2)')} AS y
FROM scaled s LEFT JOIN w ON w.machine_id = s.machine_id GROUP BY s.machine_id""",
)
def g7_ridge_score_each(spark, sf_dir):
    """Each machine's latest window scored with its own model."""
    columns = ["cpu_usage"]
    series = _users(spark, sf_dir)
    models = training.fit_each(series, PAIRS_AHEAD, columns, columns, RIDGE)
    blocks = windows.scaled_blocks(series, columns, PAIRS_AHEAD, 1, 1)
    latest = windows.latest_stored(windows.array_windows(blocks, columns, columns, PAIRS_AHEAD))
    scored = training.score_each(latest.select("machine_id", "window_idx", "x"), models, RIDGE)
    return rounded(scored.select("machine_id", "window_idx", F.col("forecast")[0][0].alias("y")))


def _set_linear() -> forecast.Linear:
    """Weights by a rule of input and output, so that SQL can form the products."""
    i, o = np.arange(180)[:, None], np.arange(24)[None, :]
    return forecast.Linear(3, 2, 60, 12, ((i * 7 + o * 3) % 11 - 5) / 600.0, np.arange(24) / 100.0)


def _set_weight(row: str, feature: int, output: str) -> str:
    return f"((((3 * {row} + {feature}) * 7 + {output} * 3) % 11 - 5) / 600.0::DOUBLE)"


_SET_LINEAR = f"""{q.series('users')}, {q.scalers(FEATURES)},
  framed AS (SELECT machine_id, rn, list(struct_pack(c := cpu_usage, m := memory_usage, a := assigned_memory)) OVER x AS x,
      list(cpu_usage) OVER y AS yc, list(memory_usage) OVER y AS ym
    FROM (SELECT m.machine_id, rn, n, {', '.join(f'{q.scaled(c)} AS {c}' for c in FEATURES)}
      FROM marks m JOIN bounds b ON m.machine_id = b.machine_id)
    WINDOW x AS (PARTITION BY machine_id ORDER BY rn ROWS BETWEEN 59 PRECEDING AND CURRENT ROW),
      y AS (PARTITION BY machine_id ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING)),
  made AS (SELECT f.machine_id, f.rn, w.split, x, yc, ym FROM framed f JOIN windows w ON w.machine_id = f.machine_id AND w.rn = f.rn),
  inputs AS (SELECT machine_id, rn, unnest(range(60)) AS pos, unnest(x) AS v FROM made),
  outputs AS (SELECT unnest(range(24)) AS o),
  dots AS (SELECT machine_id, rn, o, sum(v.c * {_set_weight('pos', 0, 'o')} + v.m * {_set_weight('pos', 1, 'o')}
      + v.a * {_set_weight('pos', 2, 'o')}) + o / 100.0::DOUBLE AS y_pred FROM inputs, outputs GROUP BY machine_id, rn, o),
  predictions AS (SELECT split, 'linear_baseline' AS model, (o // 2 + 1)::INT AS step,
      CASE WHEN o % 2 = 0 THEN 'cpu_usage' ELSE 'memory_usage' END AS target,
      CASE WHEN o % 2 = 0 THEN yc[o // 2 + 1] ELSE ym[o // 2 + 1] END AS y_true, y_pred
    FROM dots d JOIN made m ON m.machine_id = d.machine_id AND m.rn = d.rn)"""


@query(
    "g3_linear_predict",
    f"""{_SET_LINEAR}, {q.errors('split, model, target')}
SELECT split, model, target, {q.r('a / c')} AS mae, {q.r('sqrt(s / c)')} AS rmse FROM sums""",
)
def g3_linear_predict(spark, sf_dir):
    """All windows scored by a linear model, errors per split and target."""
    predicted = forecast.model_windows(
        _users(spark, sf_dir), USERS, FEATURES, TARGETS, _set_linear()
    )
    return rounded(evaluate.per_target(predicted, by=["split", "model"]).drop("mape"))


_SCORED = f"""{q.series('users')}, {q.scalers(TARGETS)},
  scaled AS (SELECT m.machine_id, m.step, {q.scaled('cpu_usage')} AS cpu, {q.scaled('memory_usage')} AS memory
    FROM latest m JOIN bounds b ON m.machine_id = b.machine_id WHERE m.step >= 48)"""


@query(
    "g4_score_latest",
    f"""{_SCORED} SELECT machine_id, 12 AS horizon, {q.r('avg(cpu)')} AS first_cpu, {q.r('avg(memory)')} AS last_memory
FROM scaled GROUP BY 1""",
)
def g4_score_latest(spark, sf_dir):
    latest = pipeline.latest_arrays(_users(spark, sf_dir), USERS, FEATURES)
    scored = forecast.score(latest, forecast.MovingAverage())
    return rounded(
        scored.select(
            "machine_id", F.size("forecast").alias("horizon"),
            F.col("forecast")[0][0].alias("first_cpu"), F.col("forecast")[11][1].alias("last_memory"),
        )
    )


@query(
    "g5_score_batch",
    f"""{q.predictions('users')} SELECT machine_id, window_idx, split,
{q.r("max(y_pred) FILTER (target = 'cpu_usage' AND step = 1)")} AS first_cpu,
{q.r("max(y_pred) FILTER (target = 'memory_usage' AND step = 12)")} AS last_memory
FROM predictions GROUP BY 1, 2, 3""",
)
def g5_score_batch(spark, sf_dir):
    """Array windows scored by a plug-in numpy model that averages the last 12 rows."""

    def last_hour(x):
        mean = x[:, -12:, :2].mean(axis=1, keepdims=True)
        return mean.repeat(12, axis=1)

    blocks = windows.scaled_blocks(_users(spark, sf_dir), FEATURES, USERS, back=59, ahead=12)
    made = windows.array_windows(blocks, FEATURES, TARGETS, USERS).drop("y")
    scored = forecast.score(made, forecast.NumpyForecaster("last_hour", last_hour))
    return rounded(
        scored.select(
            "machine_id", "window_idx", "split",
            F.col("forecast")[0][0].alias("first_cpu"), F.col("forecast")[11][1].alias("last_memory"),
        )
    )


@query(
    "g8_count_parameters",
    f"""{_SMALL_FIT} SELECT 'linear_baseline' AS name, 'linear' AS kind, count(weight) AS num_params FROM fitted
UNION ALL SELECT 'moving_avg_12', 'moving_average', 0""",
)
def g8_count_parameters(spark, sf_dir):
    """Sizes in the models table that holds the fitted linear model."""
    loaded = models.models_table(spark, [_small_fit(spark, sf_dir), forecast.MovingAverage()])
    return loaded.select("name", "kind", "num_params")


@query(
    "g9_training_set",
    f"""{q.series('users')} SELECT machine_id, count(*) AS row_count, {q.r('sum(cpu_usage)', 4)} AS cpu_total
FROM series WHERE machine_id = (SELECT min(machine_id) FROM series) GROUP BY 1""",
)
def g9_training_set(spark, sf_dir):
    chosen = forecast.training_set(_users(spark, sf_dir))
    return rounded(
        chosen.groupBy("machine_id").agg(
            F.count(F.lit(1)).alias("row_count"), F.sum("cpu_usage").alias("cpu_total")
        ),
        4,
    )


@query(
    "g10_forecast_machine",
    f"{_POINTS} SELECT machine_id, kind, step, {_round_list(FEATURES)} FROM points",
)
def g10_forecast_machine(spark, sf_dir):
    return rounded(_points(spark, sf_dir))


def _fading_last(x):
    """The last row, fading with the step: does not commute with scaling."""
    fade = 1 - np.arange(12) / 24
    return x[:, -1:, :2] * fade[None, :, None]


_FADING = forecast.NumpyForecaster("fading_last", _fading_last)


def _faded(column: str) -> str:
    return q.r(f"(f.{column} - {column}_lo) * (1 - h / 24.0::DOUBLE) + {column}_lo")


@query(
    "g10_forecast_machine_model",
    f"""{q.series('users')}, {q.scalers(TARGETS)}
SELECT machine_id, 'history' AS kind, step, {_round_list(FEATURES)} FROM latest
UNION ALL SELECT f.machine_id, 'forecast', h::INT, {_faded('cpu_usage')}, {_faded('memory_usage')}, NULL
FROM latest f JOIN bounds b ON f.machine_id = b.machine_id, range(12) t(h) WHERE f.step = 59""",
)
def g10_forecast_machine_model(spark, sf_dir):
    """Latest windows scaled, scored by a plug-in model and turned back."""
    return rounded(
        pipeline.forecast_with_history(_users(spark, sf_dir), USERS, FEATURES, TARGETS, _FADING)
    )


_UPLOAD = f"""{_USABLE}, {_TAIL},
  full_tail AS (SELECT *, (60 - back)::INT AS step FROM tail WHERE n >= 60),
  ahead AS (SELECT machine_id, unnest(generate_series(0, 11))::INT AS step, cpu_usage, memory_usage FROM (
    SELECT machine_id, avg(cpu_usage) AS cpu_usage, avg(memory_usage) AS memory_usage
    FROM full_tail WHERE step >= 48 GROUP BY 1))"""


@query(
    "g11_forecast_upload",
    f"""{_UPLOAD} SELECT machine_id, 'history' AS kind, step, {_round_list(FEATURES)} FROM full_tail
UNION ALL SELECT machine_id, 'forecast', step, {q.r('cpu_usage')}, {q.r('memory_usage')}, NULL FROM ahead""",
)
def g11_forecast_upload(spark, sf_dir):
    return rounded(upload.forecast_upload(text_telemetry(spark, sf_dir), EVENTS).points)


@query(
    "g11_forecast_upload_model",
    f"""{_UPLOAD} SELECT machine_id, 'history' AS kind, step, {_round_list(FEATURES)} FROM full_tail
UNION ALL SELECT f.machine_id, 'forecast', h::INT, {_faded('cpu_usage')}, {_faded('memory_usage')}, NULL
FROM full_tail f JOIN bounds b ON f.machine_id = b.machine_id, range(12) t(h) WHERE f.step = 59""",
)
def g11_forecast_upload_model(spark, sf_dir):
    """Uploads scaled by their own rows, scored by a plug-in model and turned back; the
    padded feature is a constant column."""
    made = upload.forecast_upload(text_telemetry(spark, sf_dir), EVENTS, _FADING)
    return rounded(made.points)


@query(
    "g11_forecast_upload_unnamed",
    f"""WITH {_COERCED}, usable AS (SELECT * FROM typed WHERE cpu_usage IS NOT NULL AND memory_usage IS NOT NULL),
  tail AS (SELECT *, row_number() OVER (ORDER BY row_order DESC) AS back FROM usable QUALIFY back <= 60)
SELECT 'uploaded' AS machine_id, 'history' AS kind, (60 - back)::INT AS step, {_round_list(FEATURES)} FROM tail
UNION ALL SELECT 'uploaded', 'forecast', unnest(generate_series(0, 11))::INT, {q.r('c')}, {q.r('m')}, NULL
FROM (SELECT avg(cpu_usage) AS c, avg(memory_usage) AS m FROM tail WHERE back <= 12)""",
)
def g11_forecast_upload_unnamed(spark, sf_dir):
    """The whole table as one machine without an id."""
    telemetry = text_telemetry(spark, sf_dir).drop("machine_id")
    return rounded(upload.forecast_upload(telemetry, EVENTS).points)


# ---------------------------------------------------------------- evaluation


def _metric(name: str, expression: str, digits: int):
    return f"""{q.predictions('events')}, {q.errors('model')} SELECT model, {q.r(expression, digits)} AS {name} FROM sums"""


@query("h1_mae", _metric("mae", "a / c", 6))
def h1_mae(spark, sf_dir):
    return rounded(evaluate.mae(_predictions(spark, sf_dir)))


@query("h2_rmse", _metric("rmse", "sqrt(s / c)", 6))
def h2_rmse(spark, sf_dir):
    return rounded(evaluate.rmse(_predictions(spark, sf_dir)))


@query("h3_mape", _metric("mape", "q / c * 100", 2))
def h3_mape(spark, sf_dir):
    return rounded(evaluate.mape(_predictions(spark, sf_dir)), 2)


_PRECISION, _RECALL = "tp / greatest(tp + fp, 1)", "tp / greatest(tp + fn, 1)"


@query(
    "h4_overload",
    f"""{q.predictions('events')}, {q.errors('model, target')} SELECT model, target,
{q.four(_PRECISION)} AS precision, {q.four(_RECALL)} AS recall,
{q.four(f'2 * ({_PRECISION}) * ({_RECALL}) / greatest({_PRECISION} + {_RECALL}, 1e-8::DOUBLE)')} AS f1,
{q.four('(tp + tn) / greatest(c, 1)')} AS accuracy,
tp + fn AS total_overload_events, tp + fp AS predicted_overload_events FROM sums""",
)
def h4_overload(spark, sf_dir):
    return evaluate.overload(_predictions(spark, sf_dir))


@query(
    "h5_per_horizon",
    f"""{q.predictions('events')}, {q.errors('model, step')} SELECT model, step, {q.nearest('a / c', 4)} AS mae,
{q.nearest('sqrt(s / c)', 4)} AS rmse FROM sums""",
)
def h5_per_horizon(spark, sf_dir):
    return evaluate.per_horizon(_window_predictions(spark, sf_dir))


@query(
    "h6_per_target",
    f"""{q.predictions('events')}, {q.errors('model, target')} SELECT model, target, {q.r('a / c')} AS mae,
{q.r('sqrt(s / c)')} AS rmse, {q.r('q / c * 100', 2)} AS mape FROM sums""",
)
def h6_per_target(spark, sf_dir):
    return rounded(evaluate.per_target(_window_predictions(spark, sf_dir)), mape=2)


@query(
    "h7_evaluate_all",
    f"{q.predictions('events')}, {q.errors('model, target, step')}{_metric_rows()}",
)
def h7_evaluate_all(spark, sf_dir):
    return rounded(evaluate.evaluate_all(_window_predictions(spark, sf_dir)), mape=2)


@query("h8_evaluate_by_split", _EVALUATION)
def h8_evaluate_by_split(spark, sf_dir):
    return rounded(evaluate.evaluate_by_split(_window_predictions(spark, sf_dir, "test")), mape=2)


# mape is left out here: y is exactly 0 so often that its sum is not stable to a fixed
# number of digits.
@query(
    "h8_evaluate_lines",
    f"""{q.predictions('lines')}, tested AS (SELECT * FROM predictions WHERE split = 'test'),
{q.errors('model, target, step', 'tested')} SELECT model, target, step, {q.r('a / c')} AS mae, {q.r('sqrt(s / c)')} AS rmse FROM sums""",
)
def h8_evaluate_lines(spark, sf_dir):
    predicted = forecast.moving_average_windows(_lines(spark, sf_dir), LINES, TARGETS, split="test")
    sums = evaluate.error_sums(predicted, ["model", "target", "step"])
    return rounded(
        sums.select(
            "model", "target", "step",
            evaluate.mae_of().alias("mae"), evaluate.rmse_of().alias("rmse"),
        )
    )


# ---------------------------------------------------------------- derived values

_CPU = "(value - 5)"


def _cpu(spark, sf_dir):
    """Event values shifted so that some are below zero and some above 100."""
    return table(spark, sf_dir, "events").select("event_id", (F.col("value") - 5).alias("cpu"))


@query(
    "i1_i4_derived",
    f"""SELECT event_id, {q.tenth(f'40.0::DOUBLE + {_CPU} * 0.4::DOUBLE')} AS temperature,
{q.tenth(f'80.0::DOUBLE + {_CPU} * 2.5::DOUBLE')} AS power,
trunc(least(10.0::DOUBLE, greatest(0.0::DOUBLE, {_CPU} / 25)))::INT AS jobs,
CASE WHEN {_CPU} > 80 THEN 'high' WHEN {_CPU} > 60 THEN 'medium' WHEN {_CPU} > 30 THEN 'normal' ELSE 'low' END AS status,
CASE WHEN {_CPU} > 80 THEN 'danger' WHEN {_CPU} > 60 THEN 'warn' ELSE 'ok' END AS band FROM events""",
)
def i1_i4_derived(spark, sf_dir):
    cpu = F.col("cpu")
    return _cpu(spark, sf_dir).select(
        "event_id", derive.temperature(cpu).alias("temperature"), derive.power(cpu).alias("power"),
        derive.jobs(cpu).alias("jobs"), derive.status(cpu).alias("status"),
        derive.risk_band(cpu).alias("band"),
    )


def _workload_sql(average: str) -> str:
    activity = f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {average} / 100.0::DOUBLE))"
    t, i, d = (q.tenth(f"{activity} * {share}::DOUBLE") for share in (55, 25, 15))
    rows = [("Training", t), ("Inference", i), ("Data Proc", d),
            ("Idle", q.tenth(f"greatest(0.0::DOUBLE, 100.0::DOUBLE - {t} - {i} - {d})"))]
    return " UNION ALL ".join(
        f"SELECT {q.tenth(average)} AS avg_cluster_cpu, '{name}' AS name, {percent} AS percent FROM averages"
        for name, percent in rows
    )


@query(
    "i5_workload_distribution",
    f"""WITH averages AS (SELECT event_type, avg(value) AS a FROM events GROUP BY 1)
{_workload_sql('a')}""",
)
def i5_workload_distribution(spark, sf_dir):
    averages = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("a"))
    return derive.workload_distribution(averages, "a")


@query(
    "i6_augment",
    f"""WITH {q.cleaned('events')} SELECT timestamp, machine_id, {q.r('cpu_usage')} AS cpu_usage,
{q.tenth('40.0::DOUBLE + cpu_usage * 0.4::DOUBLE')} AS temperature, {q.tenth('80.0::DOUBLE + cpu_usage * 2.5::DOUBLE')} AS power_draw,
trunc(least(10.0::DOUBLE, greatest(0.0::DOUBLE, cpu_usage / 25))) AS jobs_count FROM cleaned""",
)
def i6_augment(spark, sf_dir):
    cleaned = _cleaned(spark, sf_dir).select("timestamp", "machine_id", "cpu_usage")
    return rounded(derive.augment(cleaned))


# ---------------------------------------------------------------- reports

_OVERVIEW_COLUMNS = f"""id, num_windows, {q.r('latest_cpu')} AS latest_cpu, {q.r('latest_memory')} AS latest_memory,
latest_temperature, latest_power, latest_jobs, status"""


@query("j1_machine_overview", f"{_overview_sql('users')} SELECT {_OVERVIEW_COLUMNS} FROM overview ORDER BY id")
def j1_machine_states(spark, sf_dir):
    return rounded(reports.machine_overview(_users(spark, sf_dir), USERS))


def _stored_tail(spark, sf_dir):
    """The rows that reports on latest windows need, from a stored series."""
    path = scratch_folder(spark, "series")
    tables.write_series(_users(spark, sf_dir), path, tail_rows=USERS.window_length)
    return tables.read_series(spark, path, tail_only=True)


@query("j1_machine_overview_stored", ORACLES["j1_machine_overview"])
def j1_machine_overview_stored(spark, sf_dir):
    """From a stored series, whose files outside the tail are not read."""
    return rounded(reports.machine_overview(_stored_tail(spark, sf_dir), USERS))


@query(
    "j1_machine_overview_pairs",
    f"""{_overview_sql('pairs')}, inputs AS (SELECT DISTINCT machine_id AS id FROM rolled)
SELECT i.id, coalesce(num_windows, 0) AS num_windows, {q.r('latest_cpu')} AS latest_cpu,
{q.r('latest_memory')} AS latest_memory, latest_temperature, latest_power, latest_jobs, status
FROM inputs i LEFT JOIN overview o ON i.id = o.id""",
)
def j1_machine_overview_pairs(spark, sf_dir):
    """Most machines here are too short for a window and keep NULLs."""
    rolled = _rolled(spark, sf_dir, pair_usage, count_jobs=False)
    series = resample.regular_series(rolled, USERS)
    return rounded(reports.machine_overview(series, USERS, rolled.select("machine_id")))


@query(
    "j1_machine_overview_lines",
    f"{_overview_sql('lines')} SELECT {_OVERVIEW_COLUMNS} FROM overview ORDER BY id",
)
def j1_machine_overview_lines(spark, sf_dir):
    return rounded(reports.machine_overview(_lines(spark, sf_dir), LINES))


@query(
    "j2_workload",
    f"{_overview_sql('users')}, averages AS (SELECT coalesce(avg(latest_cpu), 0.0) AS a FROM overview) {_workload_sql('a')}",
)
def j2_workload(spark, sf_dir):
    return reports.workload(_states(spark, sf_dir))


_AUGMENTED = f"""{q.tenth('40.0::DOUBLE + cpu_usage * 0.4::DOUBLE')} AS temperature,
{q.tenth('80.0::DOUBLE + cpu_usage * 2.5::DOUBLE')} AS power_draw,
trunc(least(10.0::DOUBLE, greatest(0.0::DOUBLE, cpu_usage / 25))) AS jobs_count"""


@query(
    "j3_machine_history",
    f"{q.series('users')} SELECT machine_id, step, {_round_list(FEATURES)}, {_AUGMENTED} FROM latest",
)
def j3_machine_history(spark, sf_dir):
    return rounded(reports.machine_history(_users(spark, sf_dir), USERS, FEATURES))


@query(
    "j3_machine_history_scaled",
    f"""{q.series('users')}, {q.scalers(FEATURES)} SELECT m.machine_id, step - 30 AS step,
{', '.join(f'{q.r(q.scaled(c))} AS {c}' for c in FEATURES)}
FROM latest m JOIN bounds b ON m.machine_id = b.machine_id WHERE step >= 30""",
)
def j3_machine_history_scaled(spark, sf_dir):
    return rounded(
        reports.machine_history(_users(spark, sf_dir), USERS, FEATURES, 30, denormalized=False)
    )


@query(
    "j4_machine_forecast",
    f"{_POINTS} SELECT machine_id, kind, step, {_round_list(FEATURES)}, {_AUGMENTED} FROM points",
)
def j4_machine_forecast(spark, sf_dir):
    return rounded(reports.machine_forecast(_users(spark, sf_dir), USERS, FEATURES, TARGETS))


@query("j4_machine_forecast_stored", ORACLES["j4_machine_forecast"])
def j4_machine_forecast_stored(spark, sf_dir):
    return rounded(reports.machine_forecast(_stored_tail(spark, sf_dir), USERS, FEATURES, TARGETS))


@query(
    "j5_list_models",
    f"""{_METRICS} SELECT coalesce(m.name, s.model) AS name, coalesce(num_params, 0) AS num_params,
width::VARCHAR AS "window", s.model IS NOT NULL AS has_metrics, m.name IS NOT NULL AS invokable
FROM models m FULL JOIN sums s ON m.name = s.model""",
)
def j5_list_models(spark, sf_dir):
    listed = models.list_models(_models_table(spark), _two_model_metrics(spark, sf_dir))
    return listed.select(
        "name", "num_params", F.try_element_at("config", F.lit("window")).alias("window"),
        "has_metrics", "invokable",
    )


@query(
    "j6_compare_models",
    f"""{_METRICS} SELECT coalesce(m.name, s.model) AS name, {q.r('a / c')} AS mae,
{q.r('sqrt(s.s / c)')} AS rmse, {q.r('q / c * 100', 2)} AS mape FROM models m FULL JOIN sums s ON m.name = s.model""",
)
def j6_compare_models(spark, sf_dir):
    compared = models.compare_models(_models_table(spark), _two_model_metrics(spark, sf_dir))
    return rounded(compared, mape=2)


_J7 = _EVALUATION.split("SELECT model, 'overall'")[0]


@query(
    "j7_model_metrics",
    f"""{_J7.rstrip()}, metrics AS ({_EVALUATION[len(_J7):]}),
  curve AS (SELECT ts::DATE AS day, avg(value) AS loss, avg({q.K}) AS other,
      row_number() OVER (ORDER BY ts::DATE) AS epoch, count(*) OVER () AS epochs
    FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1)
SELECT *, NULL::DOUBLE AS train_loss, NULL::DOUBLE AS val_loss, NULL::DOUBLE AS lr FROM metrics
UNION ALL BY NAME
SELECT 'moving_avg_12' AS model, 'training_history' AS scope, epoch::INT AS step, {q.r('loss')} AS train_loss,
  CASE WHEN epoch <= epochs - 10 THEN {q.r('other')} END AS val_loss, 0.001::DOUBLE AS lr FROM curve""",
)
def j7_model_metrics(spark, sf_dir):
    """Metric rows of one model and its training curve."""
    metrics = evaluate.evaluate_by_split(_predictions(spark, sf_dir, split="test"))
    history = _history_table(spark, sf_dir)
    first = history.agg(F.min("name").alias("name"))
    traced = history.join(first, "name", "left_semi").withColumn("name", F.lit("moving_avg_12"))
    found = models.model_metrics(_models_table(spark), metrics, "moving_avg_12", traced)
    return rounded(found, mape=2)


@query(
    "j8_inventory",
    f"""{q.series('users')}, {_MODELS} SELECT 'model' AS kind, name FROM models
UNION ALL SELECT 'machine', machine_id FROM series WHERE rn = 0 AND n >= 72 ORDER BY 1, 2""",
)
def j8_inventory(spark, sf_dir):
    usable = windows.reject_short(_users(spark, sf_dir), USERS).filter("rn = 0")
    return models.inventory(_models_table(spark), usable)


_LABEL = "CASE WHEN position = 0 THEN 'now' WHEN position > 0 THEN '+' || (position * 5)::VARCHAR || 'm' ELSE (position * 5)::VARCHAR || 'm' END"


@query(
    "j9_utilization_series",
    f"""{_POINTS}, chart AS (
  SELECT machine_id, step - 59 AS position, coalesce(cpu_usage, 0) AS value, NULL::DOUBLE AS forecast, 0 AS part FROM points WHERE kind = 'history'
  UNION ALL SELECT machine_id, 0, NULL, coalesce(cpu_usage, 0), 1 FROM points WHERE kind = 'history' AND step = 59
  UNION ALL SELECT machine_id, step + 1, NULL, coalesce(cpu_usage, 0), 1 FROM points WHERE kind = 'forecast')
SELECT machine_id, position, {_LABEL} AS time, {q.r('value')} AS value, {q.r('forecast')} AS forecast, part FROM chart""",
)
def j9_utilization_series(spark, sf_dir):
    return rounded(reports.utilization_series(_points(spark, sf_dir)))


@query(
    "j9_utilization_series_stored",
    ORACLES["j9_utilization_series"],
)
def j9_utilization_series_stored(spark, sf_dir):
    tail = _stored_tail(spark, sf_dir)
    points = pipeline.forecast_with_history(tail, USERS, FEATURES, TARGETS)
    return rounded(reports.utilization_series(points))


@query(
    "j10_memory_series",
    f"""{_POINTS}, chart AS (SELECT machine_id, step - 59 AS position, memory_usage AS value FROM points WHERE kind = 'history')
SELECT machine_id, position, {_LABEL} AS time, {q.r('coalesce(value, 0)')} AS value FROM chart""",
)
def j10_memory_series(spark, sf_dir):
    return rounded(reports.memory_series(_points(spark, sf_dir)))


@query(
    "j11_multi_horizon",
    f"""{_POINTS}, chart AS (SELECT machine_id, step + 1 AS position, cpu_usage, memory_usage FROM points WHERE kind = 'forecast')
SELECT machine_id, position, {_LABEL} AS time, {_round_list(TARGETS)} FROM chart""",
)
def j11_multi_horizon(spark, sf_dir):
    return rounded(reports.multi_horizon(_points(spark, sf_dir)))


@query(
    "j12_forecast_summary",
    f"""{_POINTS} SELECT machine_id, step + 1 AS step, '+' || ((step + 1) * 5)::VARCHAR || 'm' AS label, {q.r('cpu_usage')} AS cpu,
CASE WHEN cpu_usage > 80 THEN 'danger' WHEN cpu_usage > 60 THEN 'warn' ELSE 'ok' END AS band
FROM points WHERE kind = 'forecast' AND step + 1 IN (1, 3, 6, 12)""",
)
def j12_forecast_summary(spark, sf_dir):
    return rounded(reports.forecast_summary(_points(spark, sf_dir)))


@query(
    "j13_cluster_heatmap",
    f"""{_overview_sql('users')} SELECT id, {q.r('coalesce(latest_cpu, 0)')} AS cpu, {q.r('coalesce(latest_memory, 0)')} AS memory,
coalesce(latest_jobs, 0) AS jobs, coalesce(latest_temperature, 0) AS temperature, coalesce(latest_power, 0) AS power,
upper(status) AS band FROM overview""",
)
def j13_cluster_heatmap(spark, sf_dir):
    return rounded(reports.cluster_heatmap(_states(spark, sf_dir)))


@query(
    "j14_training_history",
    f"""WITH daily AS (SELECT event_type, ts::DATE AS day, avg(value) AS loss, avg({q.K}) AS other FROM events GROUP BY 1, 2),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS epoch,
    count(*) OVER (PARTITION BY event_type) AS days FROM daily)
SELECT 'moving_avg_' || event_type AS name, epoch::INT AS epoch, {q.nearest_up('loss')} AS train,
  {q.nearest_up('CASE WHEN epoch <= days - 10 THEN other ELSE 0 END')} AS val FROM numbered""",
)
def j14_training_history(spark, sf_dir):
    return models.training_history(_history_table(spark, sf_dir))


@query(
    "j15_upload_machines",
    f"""WITH {_COERCED}, {_ENOUGH} SELECT machine_id, num_input_rows, coalesce({_SHORT}, '') AS warnings FROM counted""",
)
def j15_upload_machines(spark, sf_dir):
    result = upload.forecast_upload(text_telemetry(spark, sf_dir), EVENTS)
    return result.machines.withColumn("warnings", F.concat_ws(" ", "warnings"))
