"""Closed bins and moving-average forecasts of a usage stream (survey C5, G1, as a stream).

Rows are rolled up per (timestamp, machine) and averaged per (machine, bin) in two keyed,
watermarked aggregations, so state holds only the bins that are still open. Whatever a micro-batch
closes goes through the batch operators: gap filling, the last window, the moving average.

A row is late when its timestamp is at or before the watermark, which is the largest timestamp
of the micro-batches before less the delay: the rollup of that moment has been handed on. Late
rows are left out, also where their bin is still open, and counted by ``late_rows``. A bin closes
when the watermark reaches its end; without late rows closed bins equal the bins of one batch
over all rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gridpulse.config import SECONDS_PER_DAY, PipelineConfig
from gridpulse.functions.columns import epoch_micros, floor_div
from gridpulse.operators.clean import clean_usage, numeric_columns
from gridpulse.operators.forecast import moving_average
from gridpulse.operators.resample import fill_gaps, with_bin_start
from gridpulse.operators.rollup import clip_rollup, rollup_machine
from gridpulse.operators.windows import last_rows

NO_DELAY = "0 seconds"

# Spark's first watermark is the epoch, where a trace may well begin. Inside a stream, instants
# stand a thousand years later, a whole number of bins.
_AHEAD_DAYS = 365_250
_AHEAD_MICROS = _AHEAD_DAYS * SECONDS_PER_DAY * 1_000_000


def stream_bins(usage: DataFrame, config: PipelineConfig, delay: str = NO_DELAY) -> DataFrame:
    """Mean of every numeric column per machine and closed bin of a stream of raw usage rows.

    Also takes a plain table and then gives all its bins, open ones included. Rows without
    a timestamp or a machine are left out. The job count is not kept: a distinct count has
    no bounded state.
    """
    # Watermarks need an instant; it is counted from the epoch, whatever the session's zone.
    instant = F.timestamp_micros(epoch_micros("timestamp") + _AHEAD_MICROS)
    timed = clean_usage(usage).withColumn("timestamp", instant).withWatermark("timestamp", delay)
    rolled = clip_rollup(rollup_machine(timed, count_jobs=False))
    span = F.window("timestamp", f"{config.interval_seconds} seconds")
    means = [F.avg(c).alias(c) for c in numeric_columns(rolled)]
    closed = rolled.groupBy("machine_id", span.alias("span")).agg(*means)
    bin_no = floor_div(F.unix_micros("span.start") - _AHEAD_MICROS, config.interval_micros)
    return closed.select("machine_id", bin_no.alias("bin_no"), *numeric_columns(rolled))


@dataclass(frozen=True)
class Feed:
    """The tables of one followed stream, in one shared folder.

    ``bins`` and ``forecasts`` grow by one folder per micro-batch. ``tails`` has two slots
    used in turn: a micro-batch reads what the one before left and writes the other slot,
    so one that runs again after a failure finds its input as it was and writes the same.
    """

    path: str
    config: PipelineConfig
    targets: tuple[str, ...]

    def bins(self, spark: SparkSession) -> DataFrame:
        """All closed bins."""
        found = spark.read.option("basePath", f"{self.path}/bins").parquet(f"{self.path}/bins")
        return with_bin_start(found.drop("batch"), self.config)

    def forecasts(self, spark: SparkSession) -> DataFrame:
        """Every forecast made: batch, machine_id, last_bin, step, bin_no, bin, targets."""
        found = spark.read.option("basePath", f"{self.path}/forecasts").parquet(f"{self.path}/forecasts")
        return with_bin_start(found, self.config)

    def latest_forecasts(self, spark: SparkSession) -> DataFrame:
        """The newest forecast of each machine."""
        made = self.forecasts(spark)
        newest = made.groupBy("machine_id").agg(F.max("batch").alias("batch"))
        return made.join(newest, ["machine_id", "batch"], "left_semi")

    def slot(self, batch_id: int) -> str:
        return f"{self.path}/tails/{batch_id % 2}"


def _tail_schema(bins: DataFrame) -> T.StructType:
    return T.StructType([*bins.schema.fields, T.StructField("filled", T.BooleanType())])


def _new_tail(closed: DataFrame, tail: DataFrame, config: PipelineConfig) -> DataFrame:
    """Tail after ``closed``: the last rows of each regular series and the bins fills reach.

    ``filled`` rows are the last ``sequence_length`` of the machine's series, the others
    its bins among the last ``ffill_limit`` numbers (the newest at least).
    """
    columns = numeric_columns(closed, exclude=("machine_id", "bin_no"))
    names = ["machine_id", "bin_no", *columns]
    occupied = tail.filter("not filled").select(names).unionByName(closed.select(names))
    seen = tail.filter("not filled").groupBy("machine_id").agg(F.max("bin_no").alias("seen"))
    series = fill_gaps(occupied, config, columns).select(names).join(seen, "machine_id", "left")
    added = series.filter("seen is null or bin_no > seen").select(names)
    rows = added.unionByName(tail.filter("filled").select(names))
    rows = last_rows(rows, config.sequence_length, "bin_no").select(*names, F.lit(True).alias("filled"))
    newest = occupied.groupBy("machine_id").agg(F.max("bin_no").alias("newest"))
    reach = F.col("newest") - max(config.ffill_limit, 1)
    recent = occupied.join(newest, "machine_id").filter(F.col("bin_no") > reach)
    return rows.unionByName(recent.select(*names, F.lit(False).alias("filled")))


def _forecast(tail: DataFrame, closed: DataFrame, feed: Feed, window: int) -> DataFrame:
    """Moving averages of the machines with newly closed bins and a whole window of rows."""
    config, targets = feed.config, list(feed.targets)
    touched = closed.select("machine_id").distinct()
    rows = tail.filter("filled").join(touched, "machine_id", "left_semi")
    ends = rows.groupBy("machine_id").agg(F.max("bin_no").alias("last_bin"), F.count("*").alias("n"))
    ends = ends.filter(F.col("n") == config.sequence_length).drop("n")
    latest = last_rows(rows, config.sequence_length, "bin_no").withColumn(
        "step", F.lit(config.sequence_length) - F.col("back")
    )
    ahead = moving_average(latest, config, targets, window).join(ends, "machine_id")
    return ahead.select(
        "machine_id", "last_bin", "step", (F.col("last_bin") + F.col("step") + 1).alias("bin_no"), *targets
    )


def follow(
    usage: DataFrame,
    path: str,
    config: PipelineConfig,
    targets: Sequence[str],
    delay: str = NO_DELAY,
    window: int = 12,
    trigger: dict | None = None,
) -> tuple[Feed, StreamingQuery]:
    """Start keeping bins and forecasts of a usage stream under ``path``.

    ``path`` is a folder all executors share; it also takes the stream's checkpoint, and a
    call with the same path goes on where the last one stopped. By default all rows there
    are get processed and the query ends (available now). Forecasts start after the newest
    row of a machine's series, not ``horizon`` rows earlier, and need ``sequence_length``
    rows. A micro-batch costs its closed bins plus one tail per machine; one that closes no
    bin, as those that bring rows after a pause do, only copies the tails.
    """
    if usage.isStreaming is False:
        raise ValueError("`usage` must be a stream; use the batch operators for tables")
    if not 1 <= window <= config.sequence_length:
        raise ValueError(f"window must be in 1..{config.sequence_length}, got {window}")
    feed = Feed(path, config, tuple(targets))
    # The session of a micro-batch plans without adaptive execution and keeps the partitions
    # of the first start. Only the stream itself needs that.
    spark = usage.sparkSession

    def keep(batch: DataFrame, batch_id: int) -> None:
        def put(rows: DataFrame, folder: str) -> DataFrame:
            rows.write.mode("overwrite").parquet(folder)
            return spark.read.schema(rows.schema).parquet(folder)

        closed = put(batch, f"{path}/bins/batch={batch_id}")
        schema = _tail_schema(batch)
        if batch_id:
            before = spark.read.schema(schema).parquet(feed.slot(batch_id - 1))
        else:
            before = closed.withColumn("filled", F.lit(True)).limit(0)
        forecasts = f"{path}/forecasts/batch={batch_id}"
        if closed.isEmpty():
            put(before, feed.slot(batch_id))
            put(_forecast(before, closed, feed, window).limit(0), forecasts)
            return
        tail = put(_new_tail(closed, before, config), feed.slot(batch_id))
        put(_forecast(tail, closed, feed, window), forecasts)

    writer = (
        stream_bins(usage, config, delay).writeStream.outputMode("append")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(keep)
    )
    return feed, writer.start()


def late_rows(query: StreamingQuery) -> int:
    """Rows and rollups left out as late in the progress reports the query still holds."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )
