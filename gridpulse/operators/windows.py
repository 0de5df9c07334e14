"""Sliding windows, chronological split, latest window (survey E5-E12).

A window is named by its anchor, the last input row. Anchors, splits, latest windows
and histories are filters on (rn, n), so they cost no shuffle and copy no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse import messages
from gridpulse.config import PipelineConfig
from gridpulse.functions.columns import epoch_micros
from gridpulse.operators.blocks import block_order, in_own_block, with_halo
from gridpulse.operators.scale import apply_scaled, training_rows


def is_anchor(config: PipelineConfig) -> Column:
    return (F.col("rn") >= config.sequence_length - 1) & (
        F.col("rn") < F.col("n") - config.horizon
    )


def split_of(index: Column, total: Column, config: PipelineConfig) -> Column:
    """Chronological split of window ``index`` among ``total``; the rest is test."""
    train_end = F.floor(total * F.lit(float(config.train_ratio)))
    val_end = train_end + F.floor(total * F.lit(float(config.val_ratio)))
    return F.when(index < train_end, "train").when(index < val_end, "val").otherwise("test")


def sliding_windows(series: DataFrame, config: PipelineConfig) -> DataFrame:
    """One row per window, at its anchor, with ``window_idx`` and ``split``."""
    index = F.col("rn") - (config.sequence_length - 1)
    total = F.col("n") - (config.window_length - 1)
    return series.filter(is_anchor(config)).withColumns(
        {"window_idx": index, "split": split_of(index, total, config)}
    )


def windows_within_gaps(series: DataFrame, config: PipelineConfig, max_gap: int) -> DataFrame:
    """As ``sliding_windows``, of windows with at most ``max_gap`` missing bins between rows.

    A longer gap parts a series into islands, and no window, from its first input row to its
    last target, lies in two of them. Windows are numbered per machine over all islands and
    split by that number. Islands may begin anywhere: a block sees the rows its windows reach
    on both sides, and numbers inside a block are moved up by the counts of those before.
    """
    s, h, size = config.sequence_length, config.horizon, config.block_rows
    halo = with_halo(series, "rn", size, s - 1, h)
    order = block_order("rn")
    bin_no = F.floor(epoch_micros("bin") / config.interval_micros)
    parted = bin_no - F.lag(bin_no).over(order) - 1 > max_gap
    halo = halo.withColumn("parted", F.coalesce(parted, F.lit(False)).cast("int"))
    crossed = F.sum("parted").over(order.rowsBetween(2 - s, h))
    whole = (
        halo.withColumn("crossed", crossed)
        .filter(in_own_block("rn", size) & is_anchor(config) & (F.col("crossed") == 0))
        .drop("parted", "crossed")
    )
    machine = Window.partitionBy("machine_id")
    counts = whole.groupBy("machine_id", "block").agg(F.count(F.lit(1)).alias("in_block"))
    before = machine.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "machine_id", "block", F.coalesce(F.sum("in_block").over(before), F.lit(0)).alias("before"),
        F.sum("in_block").over(machine).alias("total"),
    )
    index = F.col("before") + F.row_number().over(order) - 1
    numbered = whole.join(counts, ["machine_id", "block"]).withColumn("window_idx", index)
    split = split_of(F.col("window_idx"), F.col("total"), config)
    return numbered.withColumn("split", split).select(*series.columns, "window_idx", "split")


def reject_short(series: DataFrame, config: PipelineConfig) -> DataFrame:
    """Series long enough for one window."""
    return series.filter(F.col("n") >= config.window_length)


def skipped_machines(
    series: DataFrame, config: PipelineConfig, machines: DataFrame | None = None
) -> DataFrame:
    """Machines without a window, and why.

    ``machines`` (distinct ids that went in) adds those whose bins were all dropped.
    """
    short = series.filter((F.col("rn") == 0) & (F.col("n") < config.window_length))
    counted = short.select("machine_id", "n")
    if machines is not None:
        seen = series.filter(F.col("rn") == 0)
        gone = machines.select("machine_id").join(seen, "machine_id", "left_anti")
        counted = counted.unionByName(gone.select("machine_id", F.lit(0).cast("long").alias("n")))
    reason = F.format_string(messages.TOO_SHORT, F.col("n"), F.lit(config.window_length))
    return counted.withColumn("reason", reason)


def latest_window(series: DataFrame, config: PipelineConfig) -> DataFrame:
    """Input rows of each machine's last window, with ``step`` from 0.

    It is an input window and so ends ``horizon`` rows before the series does. The
    last window is in test, or in val / train when those splits are empty.
    """
    first = F.col("n") - config.window_length
    step = F.col("rn") - first
    return (
        series.filter(
            (F.col("n") >= config.window_length)
            & (F.col("rn") >= first)
            & (F.col("rn") < first + config.sequence_length)
        )
        .withColumn("step", step.cast("int"))
    )


def latest_stored(windows: DataFrame) -> DataFrame:
    """Latest of each machine's stored windows; splits are in time order.

    The number of the latest comes from two narrow columns; only its row is read in full.
    """
    latest = windows.groupBy("machine_id").agg(F.max("window_idx").alias("window_idx"))
    return windows.join(latest, ["machine_id", "window_idx"], "left_semi")


def window_counts(series: DataFrame, config: PipelineConfig) -> DataFrame:
    """Windows per split and machine, from the series length alone."""
    total = F.col("n") - (config.window_length - 1)
    train = F.floor(total * F.lit(float(config.train_ratio)))
    val = F.floor(total * F.lit(float(config.val_ratio)))
    return (
        series.filter((F.col("rn") == 0) & (F.col("n") >= config.window_length))
        .select(
            "machine_id",
            total.alias("num_windows"),
            train.alias("train_windows"),
            val.alias("val_windows"),
            (total - train - val).alias("test_windows"),
        )
    )


MAX_HISTORY_STEPS = 1000


def history(series: DataFrame, config: PipelineConfig, steps: int = 60) -> DataFrame:
    """The last ``steps`` rows of each latest window, numbered from 0.

    A window has ``sequence_length`` rows; asking for more, up to ``MAX_HISTORY_STEPS``,
    gives the whole window.
    """
    if not 1 <= steps <= MAX_HISTORY_STEPS:
        raise ValueError(f"steps must be in 1..{MAX_HISTORY_STEPS}, got {steps}")
    first = config.sequence_length - min(steps, config.sequence_length)
    return (
        latest_window(series, config)
        .filter(F.col("step") >= first)
        .withColumn("step", F.col("step") - first)
    )


def last_rows(df: DataFrame, count: int, order_by: str = "row_order") -> DataFrame:
    """Last ``count`` rows per machine in file order; ``back`` is 1 for the very last.

    Spark keeps at most ``count`` rows per machine on the map side before shuffling. A
    table without ``machine_id`` is one machine: its rows are cut by a top-k, since a
    window over a constant key would gather the whole table in one task.
    """
    latest = F.desc(order_by)
    if "machine_id" in df.columns:
        order = Window.partitionBy("machine_id").orderBy(latest)
    else:
        df = df.orderBy(latest).limit(count)
        order = Window.orderBy(latest)
    return df.withColumn("back", F.row_number().over(order)).filter(F.col("back") <= count)


def enough_rows(
    df: DataFrame, config: PipelineConfig, required: Sequence[str] = ("cpu_usage", "memory_usage")
) -> DataFrame:
    """Usable rows per machine, with a warning where a window cannot be filled."""
    usable = F.lit(True)
    for c in required:
        usable &= F.col(c).isNotNull()
    counted = df.groupBy("machine_id").agg(F.count_if(usable).alias("num_input_rows"))
    return counted.withColumn("warning", short_warning(F.col("num_input_rows"), config))


def short_warning(rows: Column, config: PipelineConfig) -> Column:
    text = F.format_string(messages.NOT_ENOUGH_ROWS, rows, F.lit(config.sequence_length))
    return F.when(rows < config.sequence_length, text)


def split_rows(config: PipelineConfig, split: str | None, back: int, ahead: int) -> Column:
    """Rows that the frames of a split's windows touch; with no split, all rows."""
    if split is None:
        return F.lit(True)
    windows = f"(n - {config.window_length - 1})"
    train_end = f"floor({windows} * {float(config.train_ratio)!r}D)"
    val_end = f"({train_end} + floor({windows} * {float(config.val_ratio)!r}D))"
    first, end = {
        "train": ("0", train_end), "val": (train_end, val_end), "test": (val_end, windows),
    }[split]
    offset = config.sequence_length - 1
    return F.expr(f"rn >= {first} + {offset - back} AND rn < {end} + {offset + ahead}")


def scaled_blocks(
    series: DataFrame,
    columns: Sequence[str],
    config: PipelineConfig,
    back: int,
    ahead: int,
    split: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Series cut into blocks with halo, its columns scaled by the training rows.

    With ``split``, only the rows its windows need are cut and shuffled; ``keep`` names
    further columns to carry unscaled. Without overlap every row appears once.

    Scalers are repeated once per block, so the join uses the same (machine, block)
    key as the windows behind it: one shuffle of the series, and a machine holding
    most rows spreads over all its blocks.
    """
    size = config.block_rows
    long_enough = reject_short(series, config)
    needed = long_enough.filter(split_rows(config, split, back, ahead))
    carried = needed.select("machine_id", "rn", "n", *keep, *columns)
    halo = with_halo(carried, "rn", size, back, ahead)
    wide = training_rows(long_enough, config).groupBy("machine_id").agg(
        F.max("n").alias("last_n"),
        *[F.min(c).alias(f"{c}__min") for c in columns],
        *[F.max(c).alias(f"{c}__max") for c in columns],
    )
    per_block = wide.withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last_n") - 1) / size)))
    ).drop("last_n")
    if back or ahead:
        # A merge join shuffles and sorts the series just as the windows behind it need;
        # the series itself must never be broadcast on a low size estimate.
        joined = halo.hint("merge").join(per_block, ["machine_id", "block"])
    else:
        # No window follows. Every machine here has training rows, so a left join finds the
        # same rows, and only the scalers can be broadcast, if they measure small.
        joined = halo.join(per_block, ["machine_id", "block"], "left")
    return apply_scaled(joined, columns).drop(
        *[f"{c}__{side}" for c in columns for side in ("min", "max")]
    )


def _by_split(blocks: DataFrame, config: PipelineConfig) -> DataFrame:
    """Rows of each block with ``split`` and ``latest``, once per group of windows they are in.

    The groups are the windows of a split but the machine's last one, and that one alone; only
    rows near a border are in several.
    """
    total = F.col("n") - (config.window_length - 1)
    final = total - 1
    train_end = F.floor(total * F.lit(float(config.train_ratio)))
    val_end = train_end + F.floor(total * F.lit(float(config.val_ratio)))
    bounds = (F.lit(0), F.least(train_end, final)), (train_end, F.least(val_end, final)), (val_end, final), (final, total)
    rn, reach = F.col("rn"), config.window_length - 1
    groups = [
        F.when((first < end) & (rn >= first) & (rn < end + reach), F.lit(i)) for i, (first, end) in enumerate(bounds)
    ]
    split = F.when(F.col("_group") == 3, split_of(final, total, config))
    for i, name in enumerate(("train", "val", "test")):
        split = split.when(F.col("_group") == i, name)
    return (
        blocks.withColumn("_group", F.explode(F.array_compact(F.array(*groups))))
        .withColumns({"split": split, "latest": (F.col("_group") == 3).cast("int")})
        .drop("_group")
    )


def array_windows(
    blocks: DataFrame, features: Sequence[str], targets: Sequence[str], config: PipelineConfig
) -> DataFrame:
    """Windows as arrays: x is S rows of features, y is H rows of targets.

    For export and external scoring only; it repeats every row S + H times. Takes
    the output of ``scaled_blocks`` (or ``raw_blocks``) with full overlap. ``latest``
    is 1 for the last window of each machine, otherwise 0. Within a partition windows come by
    split and ``latest``: the rows are put in that order before arrays are made of them, so
    that no array has to be sorted where they are written.
    """
    order = Window.partitionBy("split", "latest", "machine_id", "block").orderBy("rn")
    s, h = config.sequence_length, config.horizon
    x = F.collect_list(F.array(*features)).over(order.rowsBetween(-(s - 1), 0))
    y = F.collect_list(F.array(*targets)).over(order.rowsBetween(1, h))
    index, total = F.col("rn") - (s - 1), F.col("n") - (config.window_length - 1)
    own = (split_of(index, total, config) == F.col("split")) & ((index == total - 1).cast("int") == F.col("latest"))
    return (
        _by_split(blocks, config).withColumns({"x": x, "y": y})
        .filter(in_own_block("rn", config.block_rows) & is_anchor(config) & own)
        .select("machine_id", index.alias("window_idx"), "split", "latest", "x", "y")
    )


def raw_blocks(
    series: DataFrame,
    columns: Sequence[str],
    config: PipelineConfig,
    back: int,
    ahead: int,
    split: str | None = None,
) -> DataFrame:
    """As ``scaled_blocks``, in real units."""
    needed = reject_short(series, config).filter(split_rows(config, split, back, ahead))
    return with_halo(
        needed.select("machine_id", "rn", "n", *columns), "rn", config.block_rows, back, ahead
    )


# Called for every block with (machine_id, block, n, positions, values by column).
BlockFunction = Callable[[str, int, int, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]
# Called for every block with (machine_id, window indexes, n, X, Y).
WindowFunction = Callable[
    [str, np.ndarray, int, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]
]


def own_windows(rn: np.ndarray, number: int, config: PipelineConfig) -> slice:
    """Rows of a block (with its halo) at which the windows begin whose anchor it owns."""
    s, size = config.sequence_length, config.block_rows
    if len(rn) < config.window_length:
        return slice(0, 0)
    first, last = int(rn[0]), int(rn[-1]) - config.window_length + 1
    begin, end = max(first, number * size - (s - 1)), min(last, (number + 1) * size - s)
    return slice(begin - first, max(begin, end + 1) - first)


def map_blocks(
    blocks: DataFrame,
    columns: Sequence[str],
    make: Callable[[], tuple[BlockFunction, Callable[[], Iterator[pa.RecordBatch]]]],
    schema: str,
) -> DataFrame:
    """Run a numpy function over the rows of each (machine, block), in order of position.

    Rows cross to Python once, as Arrow batches. ``make`` builds, per partition, a function
    called for every block and one called at the end.
    """
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, finish = make()
        # Rows arrive sorted; a block may go on in the next batch.
        key, rest_rn, rest = None, [], []

        def close():
            if key is not None:
                yield from each(*key, np.concatenate(rest_rn), np.concatenate(rest))

        for batch in batches:
            if not batch.num_rows:
                continue
            machine, number, n, rn, *data = (
                column.to_numpy(zero_copy_only=False) for column in batch.columns
            )
            values = np.column_stack([d.astype(float) for d in data]).reshape(-1, width)
            changed = (machine[1:] != machine[:-1]) | (number[1:] != number[:-1])
            starts = [0, *(np.flatnonzero(changed) + 1).tolist(), len(rn)]
            for begin, end in zip(starts, starts[1:]):
                found = (machine[begin], int(number[begin]), int(n[begin]))
                if found != key:
                    yield from close()
                    key, rest_rn, rest = found, [], []
                rest_rn.append(rn[begin:end])
                rest.append(values[begin:end])
        yield from close()
        yield from finish()

    return (
        blocks.select("machine_id", "block", "n", "rn", *columns)
        .repartition("machine_id", "block")
        .sortWithinPartitions("machine_id", "block", "rn")
        .mapInArrow(run, schema)
    )


def map_windows(
    blocks: DataFrame,
    features: Sequence[str],
    targets: Sequence[str],
    config: PipelineConfig,
    make: Callable[[], tuple[WindowFunction, Callable[[], Iterator[pa.RecordBatch]]]],
    schema: str,
) -> DataFrame:
    """Run a numpy function over all windows of each block, as ``map_blocks`` does.

    The windows are strided views of the rows, never copies in the exchange.
    """
    s, length = config.sequence_length, config.window_length
    columns = list(features) + [t for t in targets if t not in features]
    feature_at = [columns.index(c) for c in features]
    target_at = [columns.index(c) for c in targets]

    def made():
        each, finish = make()

        def block(machine: str, number: int, n: int, rn: np.ndarray, values: np.ndarray):
            own = own_windows(rn, number, config)
            if own.start < own.stop:
                views = np.lib.stride_tricks.sliding_window_view(values, length, axis=0)
                views = views[own].transpose(0, 2, 1)
                yield from each(
                    machine, rn[own], n, views[:, :s, feature_at], views[:, s:, target_at]
                )

        return block, finish

    return map_blocks(blocks, columns, made, schema)
