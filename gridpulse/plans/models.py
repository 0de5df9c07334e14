"""Model registry views and model reports (survey G6-G8, D3, J5-J8, J14)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse import messages
from gridpulse.functions.columns import round_nearest
from gridpulse.operators.forecast import Forecaster, Linear, MovingAverage, UnknownModelError

# Name prefix -> kind of model.
KIND_PREFIXES = {"linear_baseline": "linear", "moving_avg": "moving_average"}

MODEL_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("kind", T.StringType(), True),
        T.StructField("num_params", T.LongType(), False),
        T.StructField("config", T.MapType(T.StringType(), T.StringType()), False),
        T.StructField("invokable", T.BooleanType(), False),
    ]
)


def kind_of(name: str) -> str:
    for prefix, kind in KIND_PREFIXES.items():
        if name.startswith(prefix):
            return kind
    raise UnknownModelError(f"Unknown model name prefix: {name!r}")


def rebuild(name: str, config: Mapping[str, str], weights=None, bias=None) -> Forecaster:
    """A forecaster from its stored name, settings and weights."""
    settings = {key: int(value) for key, value in config.items()}
    if kind_of(name) == "linear":
        return Linear(
            settings["input_dim"], settings["output_dim"], settings["seq_len"],
            settings["horizon"], weights, bias,
        )
    return MovingAverage(settings["horizon"], settings["window"], settings["output_dim"])


def models_table(spark: SparkSession, models: Iterable[Forecaster]) -> DataFrame:
    """One row per loaded model."""
    rows = []
    for model in models:
        try:
            kind = kind_of(model.name)
        except UnknownModelError:
            kind = "custom"
        rows.append((model.name, kind, model.num_params(), model.config(), True))
    return spark.createDataFrame(rows, MODEL_SCHEMA)


def model_sidecars(models: DataFrame, metrics: DataFrame, history: DataFrame) -> DataFrame:
    """Every model name with what exists for it: model, metrics, training history."""
    loaded = models.select("name", F.lit(True).alias("loaded"))
    measured = metrics.select(F.col("model").alias("name")).distinct()
    traced = history.select("name").distinct()
    joined = loaded.join(
        measured.withColumn("has_metrics", F.lit(True)), "name", "full_outer"
    ).join(traced.withColumn("has_history", F.lit(True)), "name", "full_outer")
    flags = ("loaded", "has_metrics", "has_history")
    return joined.select("name", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in flags])


def list_models(models: DataFrame, metrics: DataFrame) -> DataFrame:
    """Loaded models and names that only have metrics, by name."""
    measured = metrics.select(F.col("model").alias("name")).distinct()
    joined = models.join(measured.withColumn("has_metrics", F.lit(True)), "name", "full_outer")
    no_config = F.create_map().cast("map<string,string>")
    return joined.select(
        "name",
        F.coalesce("num_params", F.lit(0)).alias("num_params"),
        F.coalesce("config", no_config).alias("config"),
        F.coalesce("has_metrics", F.lit(False)).alias("has_metrics"),
        F.coalesce("invokable", F.lit(False)).alias("invokable"),
    ).orderBy("name")


def compare_models(models: DataFrame, metrics: DataFrame) -> DataFrame:
    """Overall metrics side by side; NULL where a model has none."""
    numbers = ("mae", "rmse", "mape")
    overall = metrics.groupBy(F.col("model").alias("name")).agg(
        *[F.max(F.when(F.col("scope") == "overall", F.col(c))).alias(c) for c in numbers]
    )
    return models.select("name").join(overall, "name", "full_outer").orderBy("name")


def model_metrics(
    models: DataFrame, metrics: DataFrame, name: str, history: DataFrame | None = None
) -> DataFrame:
    """All metric rows of one model and, with ``history``, its training curve.

    Curve rows have the scope ``training_history``, the epoch from 1 as ``step`` and the
    losses and learning rate in ``train_loss``, ``val_loss`` and ``lr``; there are none
    without a history. A model known from its metrics alone is accepted, a name that is
    neither loaded nor measured is an error.
    """
    found = metrics.filter(F.col("model") == name)
    if models.filter(F.col("name") == name).isEmpty() and found.isEmpty():
        raise UnknownModelError(messages.MODEL_NOT_FOUND % name)
    if history is None:
        return found
    curves = ("train_loss", "val_loss", "lr")
    epochs = history.filter(F.col("name") == name).select(
        F.col("name").alias("model"),
        F.lit("training_history").alias("scope"),
        F.posexplode(F.arrays_zip(*curves)).alias("at", "values"),
    )
    curve = epochs.select(
        "model", "scope", (F.col("at") + 1).alias("step"), *[F.col("values")[c].alias(c) for c in curves]
    )
    return found.unionByName(curve, allowMissingColumns=True)


def inventory(models: DataFrame, machines: DataFrame) -> DataFrame:
    """Names of loaded models and available machines, one per row, sorted as text."""
    names = models.select(F.lit("model").alias("kind"), "name")
    ids = machines.select(F.lit("machine").alias("kind"), F.col("machine_id").alias("name"))
    return names.unionByName(ids).distinct().orderBy("kind", "name")


def training_history(history: DataFrame) -> DataFrame:
    """Epochs from 1 with losses rounded to 4 digits; a missing val loss reads 0."""
    zipped = F.arrays_zip("train_loss", "val_loss")
    return (
        history.select("name", F.posexplode(zipped).alias("at", "loss"))
        .filter(F.col("loss.train_loss").isNotNull())
        .select(
            "name",
            "at",
            F.col("loss.train_loss").alias("train"),
            F.coalesce("loss.val_loss", F.lit(0.0)).alias("val"),
        )
        .select(
            "name",
            (F.col("at") + 1).alias("epoch"),
            round_nearest(F.col("train"), 4, ties_to_even=False).alias("train"),
            round_nearest(F.col("val"), 4, ties_to_even=False).alias("val"),
        )
    )
