"""Usage trace shards and user telemetry as CSV (survey A1-A5)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.functions.columns import missing_to_null, nan_to_null

# Columns of a headerless usage shard, in file order.
USAGE_COLUMNS = (
    ("start_time", "bigint"),
    ("end_time", "bigint"),
    ("collection_id", "bigint"),
    ("instance_index", "bigint"),
    ("machine_id", "string"),
    ("alloc_collection_id", "bigint"),
    ("avg_cpu", "double"),
    ("avg_memory", "double"),
    ("max_cpu", "double"),
    ("max_memory", "double"),
    ("sample_cpu", "double"),
    ("sample_memory", "double"),
    ("assigned_memory", "double"),
    ("cycles_per_instruction", "double"),
    ("memory_accesses_per_instruction", "double"),
    ("sample_rate", "double"),
)

_TEXT_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name, _ in USAGE_COLUMNS])
_FILE_POSITION = ("source_file", "block_start", "row_in_scan")


def _typed(name: str, kind: str):
    text = missing_to_null(F.col(name))
    if kind == "string":
        return text.alias(name)
    if kind == "bigint":
        # Ids may be written as 12.0 where a column had gaps.
        whole = F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))
        return whole.alias(name)
    return nan_to_null(text.try_cast("double")).alias(name)


def _with_file_position(df: DataFrame) -> DataFrame:
    """File, start of the split in it, and a number rising within the split."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_in_scan"),
    )


def stream_usage(spark: SparkSession, path: str, **options) -> DataFrame:
    """Shards that arrive in a folder, as a stream typed like ``read_usage``.

    ``options`` are those of Spark's file stream (``maxFilesPerTrigger``). A shard must be
    whole when it arrives: a damaged one stops the stream, since rows once handed on
    cannot be taken back.
    """
    raw = spark.readStream.schema(_TEXT_SCHEMA).options(header=False, **options).csv(path)
    return raw.select(*[_typed(name, kind) for name, kind in USAGE_COLUMNS])


@dataclass(frozen=True)
class Shards:
    """What was read, and a ledger with one row per shard: shard, bytes, rows_read, reason.

    ``reason`` is null for a shard that was read. Files of no bytes are not listed.
    """

    usage: DataFrame
    ledger: DataFrame


def read_usage(
    spark: SparkSession, paths: str | Sequence[str], limit_per_file: int | None = None
) -> DataFrame:
    """The rows of ``read_shards``."""
    return read_shards(spark, paths, limit_per_file).usage


def read_shards(
    spark: SparkSession, paths: str | Sequence[str], limit_per_file: int | None = None
) -> Shards:
    """All shards (plain or gzip) in one scan, without those that cannot be read.

    A gzip shard that is damaged anywhere gives no row at all; finding those is one job over
    the compressed bytes, run here if there are gzip shards. Missing paths raise an
    AnalysisException, an empty list a FileNotFoundError, only damaged shards a ValueError.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise FileNotFoundError("No CSV files found to load.")
    files = spark.read.format("binaryFile").load(paths)
    named = files.select(F.col("_metadata.file_path").alias("shard"), F.col("length").alias("bytes"))
    damaged = damaged_shards(spark, paths)
    raw = (
        spark.read.schema(_TEXT_SCHEMA)
        .option("header", False)
        .option("ignoreCorruptFiles", True)
        .csv(paths)
    )
    if damaged and len(damaged) == named.count():
        raise ValueError("No shard could be read: " + "; ".join(f"{k}: {v}" for k, v in damaged[:10]))
    raw = raw.select("*", "_metadata")
    if damaged:
        raw = raw.filter(~F.col("_metadata.file_path").isin([shard for shard, _ in damaged]))
    if limit_per_file is not None:
        raw = limit_rows_per_file(raw, limit_per_file)
    reasons = spark.createDataFrame(damaged, "shard string, reason string")
    counts = raw.groupBy(F.col("_metadata.file_path").alias("shard")).agg(F.count("*").alias("rows_read"))
    ledger = named.join(counts, "shard", "left").join(reasons, "shard", "left").select(
        "shard", "bytes", F.coalesce("rows_read", F.lit(0)).alias("rows_read"), "reason"
    )
    return Shards(raw.select(*[_typed(name, kind) for name, kind in USAGE_COLUMNS]), ledger)


_GZIP = 31  # window bits of zlib that ask for a gzip header
_PIECE = 1 << 20


def gzip_damage(data: memoryview) -> str | None:
    """Why the bytes are no whole gzip file, or None. Holds one piece of the text at a time."""
    at, member = 0, None
    while at < len(data) or member is not None:
        if member is None:
            member = zlib.decompressobj(_GZIP)
        piece = data[at : at + _PIECE]
        if not piece:
            return "gzip data end too early"
        try:
            left = piece
            while left:
                member.decompress(left, 8 * _PIECE)
                left = member.unconsumed_tail
        except zlib.error as error:
            return f"gzip data are damaged: {error}"
        at += len(piece)
        if member.eof:
            at -= len(member.unused_data)
            member = None
    return None if len(data) else "gzip data end too early"


def damaged_shards(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, str]]:
    """(path, reason) of gzip shards that do not decompress to their end.

    A task holds one compressed shard at a time; only names of damaged ones come back, and
    the driver lists all shards already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                reason = gzip_damage(memoryview(batch.column(1)[i].as_buffer()))
                if reason is not None:
                    found.append((batch.column(0)[i].as_py(), reason))
            columns = list(zip(*found)) or [[], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string()) for c in columns], names=["shard", "reason"]
            )

    packed = (
        spark.read.format("binaryFile").load(list(paths))
        .select(F.col("_metadata.file_path").alias("shard"), "content")
        .filter(F.lower("shard").endswith(".gz"))
    )
    return sorted(tuple(row) for row in packed.mapInArrow(run, "shard string, reason string").collect())


# Beyond so many files the table of splits is no longer sent to all tasks.
MOST_FILES_SENT = 500_000


def limit_rows_per_file(scan: DataFrame, count: int) -> DataFrame:
    """The first ``count`` rows of each file of a scan; no data row is shuffled.

    Rows are numbered in file order by prefix counts: a first pass counts the rows of each
    split and notes where it begins in its scan partition, the counts of earlier splits of
    the file are added up, and the second pass filters rows by their place. Both passes scan
    one relation, so its partitions are the same. Only splits that begin before ``count`` are
    sent to the tasks, a few short rows per file; with more than ``MOST_FILES_SENT`` files
    the optimizer chooses the join.
    """
    placed = _with_file_position(scan)
    key = ["source_file", "block_start"]
    splits = placed.groupBy(*key).agg(
        F.min("row_in_scan").alias("first_in_scan"), F.count("*").alias("rows_in_split")
    )
    earlier = Window.partitionBy("source_file").orderBy("block_start")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        splits.withColumn("rows_before", F.coalesce(F.sum("rows_in_split").over(earlier), F.lit(0)))
        .filter(F.col("rows_before") < count).drop("rows_in_split")
    )
    if len(scan.inputFiles()) <= MOST_FILES_SENT:
        splits = F.broadcast(splits)
    place = F.col("rows_before") + F.col("row_in_scan") - F.col("first_in_scan")
    return placed.join(splits, key).filter(place < count).select(*scan.columns)


def read_telemetry_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """User telemetry with a header row, all text, plus ``row_order`` in file order.

    ``row_order`` sorts by file, split and row, whatever task read a split. A file whose
    header names other columns, or the same in another order, than the first file is an
    error when it is read.
    """
    df = spark.read.option("header", True).option("enforceSchema", False).csv(paths)
    if not df.columns:
        raise ValueError("File is empty.")
    return _with_file_position(df).select(
        *[F.col(f"`{c}`") for c in df.columns], F.struct(*_FILE_POSITION).alias("row_order")
    )
