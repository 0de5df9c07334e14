"""Streams against the batch operators over the same rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridpulse.config import PipelineConfig
from gridpulse.operators import clean, forecast, resample, rollup
from gridpulse.sources import usage as sources
from gridpulse.streaming import bins as streams

CONFIG = PipelineConfig(sequence_length=6, horizon=3)
TARGETS = ["cpu_usage", "memory_usage"]
BIN = 300_000_000
SCHEMA = "start_time long, machine_id string, avg_cpu double, avg_memory double"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def batch_bins(usage):
    rolled = rollup.clip_rollup(rollup.rollup_machine(clean.clean_usage(usage), False))
    return resample.resample_mean(rolled, CONFIG)


def as_set(df, *columns):
    return {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()}


def run(spark, source, path, **options):
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    feed, query = streams.follow(stream, path, CONFIG, TARGETS, window=4, **options)
    query.awaitTermination()
    return feed, query


def telemetry(lo, hi):
    """Two rows a bin; machine b skips bins, some for longer than a fill reaches."""
    out = []
    for at in range(lo, hi):
        for half in (0, 1):
            micros = at * BIN + half * 120_000_000
            out.append((micros, "a", (at % 7) / 10, 0.5))
            if at % 5 != 3 and not 20 <= at < 27:
                out.append((micros, "b", (at % 3) / 4, None if at % 11 == 0 else at / 100))
                out.append((micros, "b", 0.1, 0.01))
    return out


def test_stream_equals_batch(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    chunks = [telemetry(0, 9), telemetry(9, 10), telemetry(10, 30), telemetry(30, 41)]
    for chunk in chunks:
        rows_of(spark, chunk).write.mode("append").parquet(source)
        feed, query = run(spark, source, path)
        assert streams.late_rows(query) == 0
    whole = batch_bins(rows_of(spark, [r for c in chunks for r in c]))
    last = max(r[0] for c in chunks for r in c)
    closed = whole.filter((F.col("bin_no") + 1) * BIN <= last)
    names = ["machine_id", "bin_no", *TARGETS]
    assert as_set(feed.bins(spark), *names) == as_set(closed, *names)
    assert feed.bins(spark).count() == closed.count()

    # Forecasts from the end of the regular series over the closed bins.
    series = resample.fill_gaps(closed, CONFIG)
    ends = series.filter(F.col("rn") >= F.col("n") - 6).withColumn("step", F.expr("rn - n + 6"))
    expected = forecast.moving_average(ends, CONFIG, TARGETS, 4)
    got = feed.latest_forecasts(spark)
    assert as_set(got, "machine_id", "step", *TARGETS) == as_set(expected, "machine_id", "step", *TARGETS)
    tops = {r.machine_id: r.top for r in series.groupBy("machine_id").agg(F.max("bin_no").alias("top")).collect()}
    assert all(r.bin_no == tops[r.machine_id] + r.step + 1 for r in got.collect())


def test_only_closed_bins_rework_the_tails(spark, tmp_path, monkeypatch):
    """Micro-batches without a closed bin hand the tails on, the others plan adaptively."""
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    reworked, new_tail = [], streams._new_tail

    def noted(closed, tail, config):
        reworked.append((closed.count(), closed.sparkSession.conf.get("spark.sql.adaptive.enabled")))
        return new_tail(closed, tail, config)

    monkeypatch.setattr(streams, "_new_tail", noted)
    # The rows added last lie in the bin that is still open: none closes.
    chunks = [telemetry(0, 9), telemetry(9, 20), [(19 * BIN + 130_000_000, "a", 0.5, 0.5)]]
    tails = []
    for chunk in chunks:
        rows_of(spark, chunk).write.mode("append").parquet(source)
        feed, query = run(spark, source, path)
        assert streams.late_rows(query) == 0
        last = max(p["batchId"] for p in query.recentProgress)
        tails.append(sorted(map(str, spark.read.parquet(feed.slot(last)).collect())))
    assert len(reworked) == 2 and all(rows > 0 and adaptive == "true" for rows, adaptive in reworked)
    assert tails[2] == tails[1] != tails[0]
    assert feed.latest_forecasts(spark).filter("machine_id = 'a'").agg(F.min("bin_no")).first()[0] == 19


def test_late_rows(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    rows_of(spark, [(0, "a", 0.1, 0.1), (7 * BIN, "a", 0.3, 0.3)]).write.parquet(source)
    run(spark, source, path)
    late = [(BIN, "a", 0.9, 0.9), (7 * BIN, "a", 0.5, 0.5), (7 * BIN + 1, "a", 0.7, 0.7), (9 * BIN, "a", 0.1, 0.1)]
    rows_of(spark, late).write.mode("append").parquet(source)
    feed, query = run(spark, source, path)
    assert streams.late_rows(query) == 2
    assert as_set(feed.bins(spark), "bin_no", "cpu_usage") == {(0, 10.0), (7, 50.0)}
    assert feed.forecasts(spark).count() == 0


def test_delay_keeps_bins_open(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    rows_of(spark, [(0, "a", 0.1, 0.1), (3 * BIN, "a", 0.3, 0.3)]).write.parquet(source)
    run(spark, source, path, delay="20 minutes")
    rows_of(spark, [(1, "a", 0.5, 0.5), (5 * BIN, "a", 0.1, 0.1)]).write.mode("append").parquet(source)
    feed, query = run(spark, source, path, delay="20 minutes")
    assert streams.late_rows(query) == 0
    assert as_set(feed.bins(spark), "bin_no", "cpu_usage") == {(0, 30.0)}


def test_nulls_and_empty(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    rows_of(spark, []).write.parquet(source)
    feed, _ = run(spark, source, path)
    rows_of(spark, [(None, "a", 0.1, 0.1), (0, None, 0.1, 0.1), (0, "a", None, 0.1)]).write.mode("append").parquet(source)
    rows_of(spark, [(0, "a", 0.2, 0.1), (2 * BIN, "a", 0.2, 0.1)]).write.mode("append").parquet(source)
    feed, _ = run(spark, source, path)
    assert as_set(feed.bins(spark), "machine_id", "bin_no", "cpu_usage") == {("a", 0, 20.0)}


def test_rejected(spark, tmp_path):
    with pytest.raises(ValueError, match="stream"):
        streams.follow(rows_of(spark, []), str(tmp_path), CONFIG, TARGETS)


def test_shards_as_a_stream(spark, tmp_path):
    """Text shards arrive typed as in a batch read."""
    folder = tmp_path / "shards"
    folder.mkdir()
    line = "{},0,12.0,0,m1,0,0.25,NaN,,,,,0.1,1.0,,"
    (folder / "a.csv").write_text("\n".join(line.format(at * BIN) for at in range(4)) + "\n")
    stream = sources.stream_usage(spark, str(folder))
    query = stream.writeStream.format("memory").queryName("shards").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("shards").orderBy("start_time").collect()
    assert got == sources.read_usage(spark, str(folder)).orderBy("start_time").collect()
    assert len(got) == 4 and got[0].collection_id == 12 and got[0].avg_memory is None
