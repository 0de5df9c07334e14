"""The provided tables re-labelled as telemetry; pure projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.config import PipelineConfig
from gridpulse.functions.columns import epoch_micros

# Bin lengths suited to how dense each source is.
EVENTS = PipelineConfig()
USERS = PipelineConfig(interval_seconds=3_600)
LINES = PipelineConfig(interval_seconds=86_400)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("double")


def _events(spark: SparkSession, sf_dir: str, machine: Column) -> DataFrame:
    share = F.col("value") / 100
    return (
        table(spark, sf_dir, "events")
        .withColumn("micros", epoch_micros("ts"))
        .select(
            "event_id",
            (F.col("micros") - F.pmod("micros", F.lit(60_000_000))).alias("start_time"),
            F.col("user_id").alias("collection_id"),
            machine.alias("machine_id"),
            share.alias("avg_cpu"),
            (_k() / 100).alias("avg_memory"),
            (share * 1.2).alias("max_cpu"),
            (_k() / 100 * 1.1).alias("max_memory"),
            F.when(F.col("event_id") % 7 != 0, _k() / 200).alias("assigned_memory"),
            (1 + (F.col("event_id") % 10) / 10).alias("cycles_per_instruction"),
        )
    )


def events_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few busy machines: one per event type."""
    return _events(spark, sf_dir, F.col("event_type"))


def user_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many machines: one per user."""
    return _events(spark, sf_dir, F.col("user_id").cast("string"))


def pair_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mostly short series: one machine per user and event type."""
    return _events(spark, sf_dir, F.concat_ws("-", F.col("user_id").cast("string"), "event_type"))


def line_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume: one machine per supplier, daily."""
    return table(spark, sf_dir, "lineitem").select(
        epoch_micros("l_shipdate").alias("start_time"),
        F.col("l_orderkey").alias("collection_id"),
        F.col("l_suppkey").cast("string").alias("machine_id"),
        (F.col("l_quantity") / 50).alias("avg_cpu"),
        (F.col("l_discount") * 10).alias("avg_memory"),
    )


def text_telemetry(spark: SparkSession, sf_dir: str, machines: int | None = 40) -> DataFrame:
    """Telemetry as a user would upload it: text with blanks, words and missing ids.

    ``machines`` is the number of machines, without it each user is one.
    """
    machine = F.col("user_id") if machines is None else F.col("user_id") % machines
    number = F.col("event_id") % 10
    return table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 13 != 0, F.concat(F.lit("m"), machine)).alias(
            "machine_id"
        ),
        F.when(number == 0, "abc")
        .when(number == 1, " ")
        .when(number == 2, F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")))
        .otherwise(F.col("value").cast("string"))
        .alias("cpu_usage"),
        F.get_json_object("props", "$.k").alias("memory_usage"),
        F.when(F.col("event_id") % 7 != 0, (_k() / 2).cast("string")).alias("assigned_memory"),
        F.col("event_id").alias("row_order"),
    )
