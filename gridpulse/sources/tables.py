"""Stored windows, scalers, metrics, training histories and models (survey A6-A10)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.operators.forecast import Forecaster, Linear
from gridpulse.plans.models import rebuild

SPLITS = ("train", "val", "test")


def write_windows(windows: DataFrame, path: str, mode: str = "error") -> None:
    """Windows by split, rows of a machine close together and in order.

    Written from the partitions they come in: ``array_windows`` forms them by (machine,
    block), so a machine with most windows lies in several files, row group statistics prune
    by machine, and no array is shuffled. The last window of each machine (``latest``) lies in
    a folder of its own; with that column the windows of a split are written in the order they
    come in, and those of ``array_windows`` come as the writer needs them, so no array is
    sorted either. Without the column the last window is found by a join on the window numbers
    and the rows are sorted.
    """
    order = ["split", "latest"]
    if "latest" not in windows.columns:
        last = windows.groupBy("machine_id").agg(F.max("window_idx").alias("last_idx"))
        windows = windows.join(last, "machine_id")
        windows = windows.withColumn("latest", F.col("window_idx") == F.col("last_idx")).drop("last_idx")
        order += ["machine_id", "window_idx"]
    (
        windows.withColumn("latest", F.col("latest").cast("int"))
        .sortWithinPartitions(*order)
        .write.partitionBy("split", "latest")
        .mode(mode)
        .parquet(path)
    )


def read_windows(
    spark: SparkSession,
    path: str,
    split: str | None = None,
    machine_ids: Sequence[str] | None = None,
    latest_only: bool = False,
) -> DataFrame:
    """Stored windows; split and ``latest_only`` prune folders, ids are pushed to the scan.

    ``latest_only`` reads the files with the last window of each machine and no others. A
    damaged file is an error: it may hold windows of many machines, and without them the rest
    would look whole.
    """
    df = spark.read.parquet(path)
    if split is not None:
        if split not in SPLITS:
            raise ValueError(f"split must be one of {SPLITS}")
        df = df.filter(F.col("split") == split)
    if latest_only:
        df = df.filter(F.col("latest") == 1)
    df = df.drop("latest")
    if machine_ids is not None:
        df = df.filter(F.col("machine_id").isin(*machine_ids))
    return df


def write_series(
    series: DataFrame, path: str, mode: str = "error", tail_rows: int = 72
) -> None:
    """The numbered series, so that reports need not build it again.

    The last ``tail_rows`` rows of each machine (a whole window) lie in a folder of their
    own. Range-partitioned by machine and position: a long series is cut into several
    files, and file statistics prune by machine.
    """
    placed = series.withColumn("tail", (F.col("n") - F.col("rn") <= tail_rows).cast("int"))
    (
        placed.repartitionByRange("tail", "machine_id", "rn")
        .sortWithinPartitions("tail", "machine_id", "rn")
        .write.partitionBy("tail")
        .mode(mode)
        .parquet(path)
    )


def read_series(
    spark: SparkSession,
    path: str,
    machine_ids: Sequence[str] | None = None,
    tail_only: bool = False,
) -> DataFrame:
    """A stored series; ``tail_only`` reads the rows of latest windows and no others.

    Reports on latest windows need only those: each row carries the series length.
    """
    df = spark.read.parquet(path)
    if tail_only:
        df = df.filter(F.col("tail") == 1)
    df = df.drop("tail")
    return df if machine_ids is None else df.filter(F.col("machine_id").isin(*machine_ids))


def write_scalers(scalers: DataFrame, path: str, mode: str = "error") -> None:
    scalers.write.mode(mode).parquet(path)


def read_scalers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_metrics(metrics: DataFrame, path: str, mode: str = "error") -> None:
    """Metrics table, one folder per model."""
    metrics.write.partitionBy("model").mode(mode).parquet(path)


METRICS_SCHEMA = T.StructType(
    [
        T.StructField("scope", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("step", T.IntegerType()),
        T.StructField("mae", T.DoubleType()),
        T.StructField("rmse", T.DoubleType()),
        T.StructField("mape", T.DoubleType()),
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("f1", T.DoubleType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("total_overload_events", T.LongType()),
        T.StructField("predicted_overload_events", T.LongType()),
        T.StructField("model", T.StringType()),
    ]
)


def read_metrics(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """Stored metrics; a model without any gives no rows."""
    df = spark.read.schema(METRICS_SCHEMA).parquet(path)
    return df if model is None else df.filter(F.col("model") == model)


_REGRESSION = "struct<mae:double,rmse:double,mape:double>"
_DETECTION = (
    "struct<precision:double,recall:double,f1:double,accuracy:double,"
    "total_overload_events:bigint,predicted_overload_events:bigint>"
)
_METRICS_JSON = (
    f"overall {_REGRESSION}, per_target map<string,{_REGRESSION}>, "
    "per_horizon array<struct<step:int,mae:double,rmse:double>>, "
    f"overload map<string,{_DETECTION}>"
)


def _sidecar_name(suffix: str):
    return F.regexp_replace(F.col("_metadata.file_name"), f"{suffix}\\.json$", "")


def read_metrics_json(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Metrics documents ``<model>_metrics.json`` as rows of the metrics table."""
    docs = (
        spark.read.schema(_METRICS_JSON)
        .option("multiLine", True)
        .json(paths)
        .withColumn("model", _sidecar_name("_metrics"))
    )
    numbers = ("mae", "rmse", "mape")
    events = [f.name for f in METRICS_SCHEMA.fields[6:12]]
    text, whole, real = (F.lit(None).cast(t) for t in ("string", "int", "double"))
    no_events = [F.lit(None).cast(METRICS_SCHEMA[c].dataType).alias(c) for c in events]
    overall = docs.filter(F.col("overall").isNotNull()).select(
        "model", F.lit("overall").alias("scope"), text.alias("target"), whole.alias("step"),
        *[F.col("overall")[c].alias(c) for c in numbers], *no_events,
    )
    by_target = docs.select(
        "model", "overload", F.explode("per_target").alias("target", "m")
    ).select(
        "model", F.lit("per_target").alias("scope"), "target", whole.alias("step"),
        *[F.col("m")[c].alias(c) for c in numbers],
        *[F.try_element_at("overload", F.col("target"))[c].alias(c) for c in events],
    )
    by_step = docs.select("model", F.explode("per_horizon").alias("m")).select(
        "model", F.lit("per_horizon").alias("scope"), text.alias("target"),
        F.col("m.step").alias("step"), F.col("m.mae").alias("mae"), F.col("m.rmse").alias("rmse"),
        real.alias("mape"), *no_events,
    )
    return overall.unionByName(by_target).unionByName(by_step)


def read_history(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Training histories ``<model>_history.json``: name and three loss arrays."""
    return (
        spark.read.schema("train_loss array<double>, val_loss array<double>, lr array<double>")
        .option("multiLine", True)
        .json(paths)
        .select(_sidecar_name("_history").alias("name"), "train_loss", "val_loss", "lr")
    )


_STORED_MODEL = "name string, config map<string,string>, weights array<double>, bias array<double>"


def write_models(spark: SparkSession, models: Sequence[Forecaster], path: str) -> None:
    """Settings and weights of models; a handful of rows of bounded size."""
    rows = [
        (
            m.name,
            m.config(),
            m.weights.ravel().tolist() if isinstance(m, Linear) else None,
            m.bias.tolist() if isinstance(m, Linear) else None,
        )
        for m in models
    ]
    spark.createDataFrame(rows, _STORED_MODEL).coalesce(1).write.parquet(path)


def read_models(spark: SparkSession, path: str) -> dict[str, Forecaster]:
    """Models by name, in name order."""
    models = {}
    for row in spark.read.schema(_STORED_MODEL).parquet(path).orderBy("name").collect():
        weights = bias = None
        if row["weights"] is not None:
            bias = np.array(row["bias"])
            weights = np.array(row["weights"]).reshape(-1, len(bias))
        models[row["name"]] = rebuild(row["name"], row["config"], weights, bias)
    return models
