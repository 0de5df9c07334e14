"""Forecasters and scoring (survey G1-G10).

The moving average is built from Spark expressions. The linear model is fitted from
partial Gram matrices: one numpy pass per partition, entries summed by Spark, and a
solve of fixed size (inputs + 1 square) on the driver. Other models plug in as a
numpy function over a batch of windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from math import isqrt
from typing import Protocol, runtime_checkable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse import messages
from gridpulse.config import PipelineConfig
from gridpulse.operators.blocks import in_own_block
from gridpulse.operators.windows import (
    map_blocks,
    map_windows,
    own_windows,
    raw_blocks,
    reject_short,
    scaled_blocks,
    sliding_windows,
    split_of,
)

WINDOW_TYPE = T.ArrayType(T.ArrayType(T.DoubleType()))


class ModelError(LookupError):
    """A model that cannot be used."""


class NoModelsError(ModelError):
    """No model is loaded."""


class UnknownModelError(ModelError):
    """No loaded model has that name, or its kind is unknown."""


@runtime_checkable
class Forecaster(Protocol):
    """What a model offers: a name, its settings, its size and batch scoring."""

    name: str
    input_dim: int | None

    def config(self) -> dict[str, str]: ...

    def num_params(self) -> int: ...

    def forecast(self, windows: DataFrame) -> DataFrame:
        """Add ``forecast`` (H rows of T values) to a table with windows ``x``."""
        ...


def _scored(windows: DataFrame, predict: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Score array windows with a numpy function on the value buffers of Arrow batches.

    ``forecast`` takes the place of ``x``; values do not turn into Python objects.
    """
    names = [c for c in windows.columns if c != "x"]
    schema = T.StructType([*windows.select(*names).schema.fields, T.StructField("forecast", WINDOW_TYPE)])

    def nested(values: np.ndarray) -> pa.Array:
        batch, steps, targets = values.shape
        rows = np.arange(0, batch * steps * targets + 1, targets, dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(rows), pa.array(values.ravel()))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, batch * steps + 1, steps, dtype=np.int32)), lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = batch.column("x").flatten()
                values = rows.flatten().to_numpy(zero_copy_only=False).astype(float)
                x = values.reshape(batch.num_rows, len(rows) // batch.num_rows, -1)
                made = nested(np.ascontiguousarray(predict(x), dtype=float))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in names], made], names=[*names, "forecast"]
                )

    return windows.select(*names, "x").mapInArrow(run, schema)


@dataclass(frozen=True)
class MovingAverage:
    """Every step is forecast as the mean of the last ``window`` input rows."""

    horizon: int = 12
    window: int = 12
    output_dim: int = 2
    input_dim: int | None = None

    @property
    def name(self) -> str:
        return f"moving_avg_{self.window}"

    def config(self) -> dict[str, str]:
        return {
            "output_dim": str(self.output_dim),
            "horizon": str(self.horizon),
            "window": str(self.window),
        }

    def num_params(self) -> int:
        return 0

    def forecast(self, windows: DataFrame) -> DataFrame:
        first = F.greatest(F.size("x") - (self.window - 1), F.lit(1))
        recent = F.slice("x", first, F.lit(self.window))

        def mean(target: int):
            total = F.aggregate(recent, F.lit(0.0), lambda acc, row: acc + row[target])
            return total / F.size(recent)

        step = F.array(*[mean(t) for t in range(self.output_dim)])
        return windows.withColumn("forecast", F.array_repeat(step, self.horizon))


@dataclass(frozen=True)
class Linear:
    """One linear map from the flattened input window to all steps and targets."""

    input_dim: int
    output_dim: int
    sequence_length: int
    horizon: int
    weights: np.ndarray = field(repr=False)
    bias: np.ndarray = field(repr=False)

    @property
    def name(self) -> str:
        return "linear_baseline"

    def config(self) -> dict[str, str]:
        return {
            "input_dim": str(self.input_dim),
            "output_dim": str(self.output_dim),
            "seq_len": str(self.sequence_length),
            "horizon": str(self.horizon),
        }

    def num_params(self) -> int:
        inputs, outputs = self.sequence_length * self.input_dim, self.horizon * self.output_dim
        return inputs * outputs + outputs

    def predictor(self) -> Callable[[np.ndarray], np.ndarray]:
        weights, bias = self.weights, self.bias
        inputs, steps, targets = len(self.weights), self.horizon, self.output_dim

        def predict(x: np.ndarray) -> np.ndarray:
            flat = x.reshape(len(x), -1)
            if flat.shape[1] != inputs:
                raise ValueError(f"expected {inputs} input values, got {flat.shape[1]}")
            return (flat @ weights + bias).reshape(len(x), steps, targets)

        return predict

    def forecast(self, windows: DataFrame) -> DataFrame:
        return _scored(windows, self.predictor())


@dataclass(frozen=True)
class NumpyForecaster:
    """A user model: ``function`` maps (batch, S, F) to (batch, H, T)."""

    name: str
    function: Callable[[np.ndarray], np.ndarray] = field(repr=False)
    settings: dict[str, str] = field(default_factory=dict)
    parameters: int = 0
    input_dim: int | None = None

    def config(self) -> dict[str, str]:
        return dict(self.settings)

    def num_params(self) -> int:
        return self.parameters

    def predictor(self) -> Callable[[np.ndarray], np.ndarray]:
        return self.function

    def forecast(self, windows: DataFrame) -> DataFrame:
        return _scored(windows, self.function)


def resolve_model(models: dict[str, Forecaster], name: str | None = None) -> Forecaster:
    """The named model, or the first one."""
    if not models:
        raise NoModelsError("No models loaded.")
    if name is None:
        return next(iter(models.values()))
    if name not in models:
        raise UnknownModelError(messages.MODEL_NOT_FOUND % name)
    return models[name]


def score(windows: DataFrame, model: Forecaster) -> DataFrame:
    """Score a table of windows ``x`` (each S rows of F scaled values)."""
    kind = windows.schema["x"].dataType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType)):
        raise ValueError("windows must be 3D: (batch, seq_len, num_features)")
    if isinstance(kind.elementType.elementType, T.ArrayType):
        raise ValueError("windows must be 3D: (batch, seq_len, num_features)")
    return model.forecast(windows.withColumn("x", F.col("x").cast(WINDOW_TYPE)))


def score_one(
    spark: SparkSession, window: Sequence[Sequence[float]], model: Forecaster
) -> DataFrame:
    """Score a single window (S rows of F scaled values)."""
    if np.ndim(window) != 2:
        raise ValueError("`window` must be 2D: (seq_len, num_features)")
    rows = [([[float(v) for v in row] for row in window],)]
    schema = T.StructType([T.StructField("x", WINDOW_TYPE)])
    return score(spark.createDataFrame(rows, schema), model)


def moving_average(
    latest: DataFrame, config: PipelineConfig, targets: Sequence[str], window: int = 12
) -> DataFrame:
    """Forecast of every machine from its latest window: ``step`` from 0, targets.

    The mean commutes with scaling, so real units go in and come out.
    """
    return (
        latest.filter(F.col("step") >= config.sequence_length - window)
        .groupBy("machine_id")
        .agg(*[F.avg(t).alias(t) for t in targets])
        .select(
            "machine_id",
            F.explode(F.sequence(F.lit(0), F.lit(config.horizon - 1))).alias("step"),
            *targets,
        )
    )


@dataclass(frozen=True)
class WindowPredictions:
    """Truth and forecasts of windows, one row per window.

    ``rows`` holds machine_id, window_idx, split, ``truth`` (values by target, then step) and
    ``guess`` (by model, target, then step; one value per target where ``constant``, for
    forecasts that are the same at every step).
    """

    rows: DataFrame
    models: tuple[str, ...]
    targets: tuple[str, ...]
    horizon: int
    constant: bool

    def long(self) -> DataFrame:
        """One row per window, model, step and target.

        The exploded array is a constant, so rows multiply without building anything per
        window; values are then picked by position from the arrays each row carries.
        """
        cells = ", ".join(
            f"struct({t * self.horizon + step - 1} AS truth_at, {at} AS guess_at, "
            f"'{model}' AS model, {step} AS step, '{target}' AS target)"
            for m, model in enumerate(self.models)
            for step in range(1, self.horizon + 1)
            for t, target in enumerate(self.targets)
            for at in [m * len(self.targets) + t]
            for at in [at if self.constant else at * self.horizon + step - 1]
        )
        return self.rows.selectExpr("*", f"inline(array({cells}))").selectExpr(
            "machine_id", "window_idx", "split", "model", "step", "target",
            "get(truth, truth_at) AS y_true", "get(guess, guess_at) AS y_pred",
        )


def moving_average_windows(
    series: DataFrame,
    config: PipelineConfig,
    targets: Sequence[str],
    windows: Sequence[int] = (12,),
    scale: bool = True,
    split: str | None = None,
) -> WindowPredictions:
    """Truth and forecast of every window, for each averaging width.

    Values are scaled as the evaluation wants them, or in real units with
    ``scale=False``; ``split`` keeps the windows of one split.
    """
    order = "OVER (PARTITION BY machine_id, block ORDER BY rn"
    cut = scaled_blocks if scale else raw_blocks
    blocks = cut(series, targets, config, max(windows) - 1, config.horizon, split)
    ahead = ", ".join(
        f"lead(`{t}`, {h}) {order})" for t in targets for h in range(1, config.horizon + 1)
    )
    means = ", ".join(
        f"avg(`{t}`) {order} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        for w in windows for t in targets
    )
    framed = blocks.selectExpr("*", f"array({ahead}) AS truth", f"array({means}) AS guess")
    made = sliding_windows(framed.filter(in_own_block("rn", config.block_rows)), config)
    if split is not None:
        made = made.filter(F.col("split") == split)
    rows = made.select("machine_id", "window_idx", "split", "truth", "guess")
    names = tuple(f"moving_avg_{w}" for w in windows)
    return WindowPredictions(rows, names, tuple(targets), config.horizon, True)


def moving_average_predictions(
    series: DataFrame,
    config: PipelineConfig,
    targets: Sequence[str],
    windows: Sequence[int] = (12,),
    scale: bool = True,
    split: str | None = None,
) -> DataFrame:
    """``moving_average_windows`` with one row per window, model, step and target."""
    return moving_average_windows(series, config, targets, windows, scale, split).long()


def first_machine(series: DataFrame) -> DataFrame:
    """Rows of the machine whose id sorts first, the default training set.

    The broadcast side is one row.
    """
    first = series.agg(F.min("machine_id").alias("machine_id"))
    return series.join(F.broadcast(first), "machine_id", "left_semi")


def training_set(series: DataFrame, train_on: Sequence[str] | str | None = None) -> DataFrame:
    """Series to fit on: the given machines, the first one, or ``"all"``."""
    if train_on is None:
        return first_machine(series)
    if train_on == "all":
        return series
    return series.filter(F.col("machine_id").isin(*train_on))


WEIGHT_DECAY = 1e-5


def _entries(*parts: np.ndarray) -> pa.RecordBatch:
    values = np.concatenate(parts)
    ends = pa.array([0, len(values)], pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.ListArray.from_arrays(ends, pa.array(values))], names=["entries"]
    )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of all arrays of a partition, nothing if it has none."""
    total = None
    for batch in batches:
        if batch.num_rows:
            rows = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            total = rows.sum(axis=0) if total is None else total + rows.sum(axis=0)
    if total is not None:
        yield _entries(total)


class LaggedGram:
    """Gram matrix of sliding windows, from lagged products and border corrections.

    Windows move on by one row, so the products of their positions p + 1 and q + 1 are those
    of p and q with the first window's pair taken out and the one behind the last window's
    put in. What is left to sum are the products of position 0 with every later position,
    and one pair of windows per block for the borders. Both add up over blocks and
    partitions; ``whole`` unrolls the sums once.
    """

    BORDERS = 512  # windows at the ends of blocks, held until their products are summed

    def __init__(self, length: int, columns: int):
        self.length, self.columns = length, columns
        self.first = np.zeros((columns + 1, length, columns))
        side = (length - 1) * columns
        self.moved = np.zeros((side, side))
        self.count = 0
        self._begins: list[np.ndarray] = []
        self._ends: list[np.ndarray] = []

    def add(self, rows: np.ndarray) -> None:
        """All windows of consecutive rows."""
        windows = len(rows) - self.length + 1
        if windows <= 0:
            return
        left = np.column_stack([rows[:windows], np.ones(windows)]).T
        for q in range(self.length):
            self.first[:, q] += left @ rows[q : q + windows]
        self._begins.append(rows[: self.length - 1].ravel())
        self._ends.append(rows[windows:].ravel())
        self.count += windows
        if len(self._begins) >= self.BORDERS:
            self._settle()

    def _settle(self) -> None:
        if self._begins:
            begins, ends = np.stack(self._begins), np.stack(self._ends)
            self.moved += ends.T @ ends - begins.T @ begins
            self._begins, self._ends = [], []

    def entries(self) -> np.ndarray:
        """All sums in one row, to be added to those of other partitions."""
        self._settle()
        upper = np.triu_indices(len(self.moved))
        return np.concatenate([[self.count], self.first.ravel(), self.moved[upper]])

    @staticmethod
    def whole(entries: np.ndarray, length: int, columns: int) -> tuple[int, np.ndarray, np.ndarray]:
        """(windows, column sums, products) by (position, column) from summed entries."""
        cut = 1 + (columns + 1) * length * columns
        first = entries[1:cut].reshape(columns + 1, length, columns)
        side = (length - 1) * columns
        moved = np.zeros((side, side))
        moved[np.triu_indices(side)] = entries[cut:]
        moved = moved + np.triu(moved, 1).T
        moved = moved.reshape(length - 1, columns, length - 1, columns)
        products = np.zeros((length, columns, length, columns))
        products[0] = first[:columns]
        products[:, :, 0] = first[:columns].transpose(1, 2, 0)
        for p in range(length - 1):
            products[p + 1, :, 1:] = products[p, :, :-1] + moved[p]
        return int(entries[0]), first[columns], products


def _summed(partials: DataFrame) -> np.ndarray | None:
    """One row of sums from one array per partition.

    They are added up whole, in two levels of about the square root of their number, so no
    level adds many of them and none is cut into rows.
    """
    parts = int(partials.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for count in (isqrt(parts) or 1, 1):
        partials = partials.repartition(count).mapInArrow(_added, "entries array<double>")
    row = partials.first()
    return None if row is None else np.array(row["entries"])


def linear_fit(
    series: DataFrame,
    config: PipelineConfig,
    features: Sequence[str],
    targets: Sequence[str],
    train_on: Sequence[str] | str | None = None,
) -> Linear:
    """Least squares with L2 on the train windows, in one distributed pass.

    Minimises mean(err^2) + WEIGHT_DECAY / 2 * |w|^2, the mean being over windows,
    steps and targets; the bias is not penalised. By default the machine whose id sorts
    first is fitted, ``"all"`` pools every machine.
    """
    s, h, length = config.sequence_length, config.horizon, config.window_length
    inputs, outputs = s * len(features), h * len(targets)
    train_ratio = float(config.train_ratio)
    columns = list(features) + [t for t in targets if t not in features]

    def make():
        gram = LaggedGram(length, len(columns))

        def each(machine_id, number, n, rn, values):
            own = own_windows(rn, number, config)
            train = int((n - length + 1) * train_ratio) - int(rn[0])
            gram.add(values[own.start : min(own.stop, train) + length - 1])
            return iter(())

        def finish():
            if gram.count:
                yield _entries(gram.entries())

        return each, finish

    chosen = training_set(reject_short(series, config), train_on)
    blocks = scaled_blocks(chosen, columns, config, s - 1, h, "train")
    entries = _summed(map_blocks(blocks, columns, make, "entries array<double>"))
    if entries is None:
        raise ValueError("no training window in the given series")
    windows, sums, products = LaggedGram.whole(entries, length, len(columns))
    feature_at = [columns.index(c) for c in features]
    target_at = [columns.index(c) for c in targets]
    design = products[:s][:, feature_at]
    width = inputs + 1
    left, right = np.zeros((width, width)), np.zeros((width, outputs))
    left[:-1, :-1] = design[:, :, :s][:, :, :, feature_at].reshape(inputs, inputs)
    left[-1, :-1] = left[:-1, -1] = sums[:s][:, feature_at].ravel()
    left[-1, -1] = windows
    right[:-1] = design[:, :, s:][:, :, :, target_at].reshape(inputs, outputs)
    right[-1] = sums[s:][:, target_at].ravel()
    penalty = np.full(width, windows * outputs * WEIGHT_DECAY / 2)
    penalty[-1] = 0.0
    left = left + np.diag(penalty)
    try:
        solution = np.linalg.solve(left, right)
    except np.linalg.LinAlgError:
        solution = np.linalg.pinv(left) @ right
    return Linear(len(features), len(targets), s, h, solution[:-1], solution[-1])


def model_windows(
    series: DataFrame,
    config: PipelineConfig,
    features: Sequence[str],
    targets: Sequence[str],
    model: Linear | NumpyForecaster,
    split: str | None = None,
) -> WindowPredictions:
    """As ``moving_average_windows`` for a model with a numpy predictor."""
    s, h = config.sequence_length, config.horizon
    predict, name = model.predictor(), model.name
    count = h * len(targets)

    def make():
        def lists(values):
            by_target = values.reshape(len(values), h, -1).transpose(0, 2, 1)
            ends = np.arange(0, values.size + 1, count, dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(by_target.ravel()))

        def each(machine_id, index, n, x, y):
            guess = np.asarray(predict(x), dtype=float).reshape(len(x), count)
            yield pa.RecordBatch.from_pydict(
                {
                    "machine_id": [machine_id] * len(x),
                    "window_idx": pa.array(index, pa.int64()),
                    "n": pa.array(np.full(len(x), n), pa.int64()),
                    "truth": lists(y.reshape(len(y), count)),
                    "guess": lists(guess),
                }
            )

        return each, lambda: iter(())

    columns = list(features) + [t for t in targets if t not in features]
    blocks = scaled_blocks(series, columns, config, s - 1, h, split)
    wide = map_windows(
        blocks, features, targets, config, make,
        "machine_id string, window_idx long, n long, "
        "truth array<double>, guess array<double>",
    )
    total = F.col("n") - (config.window_length - 1)
    wide = wide.withColumn("split", split_of(F.col("window_idx"), total, config))
    if split is not None:
        wide = wide.filter(F.col("split") == split)
    return WindowPredictions(wide.drop("n"), (name,), tuple(targets), h, False)


def model_predictions(
    series: DataFrame,
    config: PipelineConfig,
    features: Sequence[str],
    targets: Sequence[str],
    model: Linear | NumpyForecaster,
    split: str | None = None,
) -> DataFrame:
    """``model_windows`` with one row per window, step and target."""
    return model_windows(series, config, features, targets, model, split).long()
