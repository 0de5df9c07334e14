"""Forecast evaluation (survey H1-H8), on truth and forecast.

Every metric is a ratio of sums. One pass reduces the predictions to one row of sums
per (model, target, step); all scopes are then grouping sets over that small table.
Predictions are a long table, or ``WindowPredictions`` with one row per window: those are
added up element by element as arrays, and steps and targets become rows after the sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.functions.columns import round_nearest
from gridpulse.operators.forecast import WindowPredictions

# Guard of the percentage error and the overload threshold.
MAPE_EPSILON = 1e-8
OVERLOAD_THRESHOLD = 0.8
F1_EPSILON = 1e-8
OVERLOAD_NAME_PARTS = ("cpu", "util")

OVERLOAD_COLUMNS = (
    "precision", "recall", "f1", "accuracy",
    "total_overload_events", "predicted_overload_events",
)

Predictions = DataFrame | WindowPredictions

_SUMS = ("count", "abs_error", "squared_error", "percent_error", "tp", "fp", "fn", "tn")


def window_sums(
    predictions: WindowPredictions,
    threshold: float = OVERLOAD_THRESHOLD,
    epsilon: float = MAPE_EPSILON,
) -> DataFrame:
    """Sums per split, model, target and step; each task hands out one row for each."""
    models, targets, horizon = predictions.models, predictions.targets, predictions.horizon
    width = 1 if predictions.constant else horizon
    shape = (len(models), len(targets), horizon)

    def values(column: pa.Array, *shape: int) -> np.ndarray:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
        return flat.reshape(len(column), *shape)

    def added(y: np.ndarray, p: np.ndarray) -> np.ndarray:
        error = np.abs(y - p)
        known = ~np.isnan(error)
        error = np.where(known, error, 0.0)
        hit, called = (y > threshold) & known, (p > threshold) & known
        percent = error / np.maximum(np.where(known, np.abs(y), 0.0), epsilon)
        both = hit & called
        cells = [known, error, error * error, percent, both, called & ~both, hit & ~both, known & ~hit & ~called]
        return np.stack([np.broadcast_to(c, (len(y), *shape)).sum(axis=0) for c in cells], axis=-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}
        for batch in batches:
            splits = batch.column(0).to_numpy(zero_copy_only=False)
            truth = values(batch.column(1), 1, len(targets), horizon)
            guess = values(batch.column(2), len(models), len(targets), width)
            for split in set(splits):
                own = splits == split
                sums[split] = sums.get(split, 0) + added(truth[own], guess[own])
        rows = [
            (split, model, target, step + 1, *total[m, t, step].tolist())
            for split, total in sums.items()
            for m, model in enumerate(models)
            for t, target in enumerate(targets)
            for step in range(horizon)
        ]
        columns = list(zip(*rows)) or [[]] * (4 + len(_SUMS))
        kinds = [pa.string()] * 3 + [pa.int32()] + [pa.float64()] * len(_SUMS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["split", "model", "target", "step", *_SUMS]
        )

    schema = "split string, model string, target string, step int, " + ", ".join(f"{c} double" for c in _SUMS)
    return predictions.rows.select("split", "truth", "guess").mapInArrow(run, schema)


def error_sums(
    predictions: Predictions,
    keys: Sequence[str],
    threshold: float = OVERLOAD_THRESHOLD,
    epsilon: float = MAPE_EPSILON,
) -> DataFrame:
    """Sums of errors and confusion counts per key."""
    if isinstance(predictions, WindowPredictions):
        parts = window_sums(predictions, threshold, epsilon).groupBy(*keys)
        kinds = {c: "double" if "error" in c else "long" for c in _SUMS}
        return parts.agg(*[F.sum(c).cast(kind).alias(c) for c, kind in kinds.items()])
    y, p = F.col("y_true"), F.col("y_pred")
    error = y - p
    hit, called = y > threshold, p > threshold
    return predictions.groupBy(*keys).agg(
        F.count(error).alias("count"),
        F.sum(F.abs(error)).alias("abs_error"),
        F.sum(error * error).alias("squared_error"),
        F.sum(F.abs(error) / F.greatest(F.abs(y), F.lit(epsilon))).alias("percent_error"),
        F.count_if(hit & called).alias("tp"),
        F.count_if(~hit & called).alias("fp"),
        F.count_if(hit & ~called).alias("fn"),
        F.count_if(~hit & ~called).alias("tn"),
    )


def mae_of() -> Column:
    return F.col("abs_error") / F.col("count")


def rmse_of() -> Column:
    return F.sqrt(F.col("squared_error") / F.col("count"))


def mape_of() -> Column:
    return F.col("percent_error") / F.col("count") * 100.0


def mae(predictions: Predictions, keys: Sequence[str] = ("model",)) -> DataFrame:
    return error_sums(predictions, keys).select(*keys, mae_of().alias("mae"))


def rmse(predictions: Predictions, keys: Sequence[str] = ("model",)) -> DataFrame:
    return error_sums(predictions, keys).select(*keys, rmse_of().alias("rmse"))


def mape(
    predictions: Predictions, keys: Sequence[str] = ("model",), epsilon: float = MAPE_EPSILON
) -> DataFrame:
    sums = error_sums(predictions, keys, epsilon=epsilon)
    return sums.select(*keys, mape_of().alias("mape"))


def _four_digits(ratio: Column) -> Column:
    return F.rint(ratio * 1e4) / 1e4


def _overload_columns(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    one = F.lit(1)
    precision = tp / F.greatest(tp + fp, one)
    recall = tp / F.greatest(tp + fn, one)
    f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(F1_EPSILON))
    accuracy = (tp + tn) / F.greatest(tp + fp + fn + tn, one)
    return sums.select(
        *keys,
        _four_digits(precision).alias("precision"),
        _four_digits(recall).alias("recall"),
        _four_digits(f1).alias("f1"),
        _four_digits(accuracy).alias("accuracy"),
        (tp + fn).alias("total_overload_events"),
        (tp + fp).alias("predicted_overload_events"),
    )


def overload(
    predictions: Predictions,
    threshold: float = OVERLOAD_THRESHOLD,
    keys: Sequence[str] = ("model", "target"),
) -> DataFrame:
    """How well values above the threshold are foreseen."""
    return _overload_columns(error_sums(predictions, keys, threshold), keys)


def _is_overload_target() -> Column:
    matches = F.lit(False)
    for part in OVERLOAD_NAME_PARTS:
        matches |= F.col("target").contains(part)
    return matches


def per_horizon(predictions: Predictions, by: Sequence[str] = ("model",)) -> DataFrame:
    """MAE and RMSE per step, counted from 1."""
    keys = [*by, "step"]
    return error_sums(predictions, keys).select(
        *keys, round_nearest(mae_of(), 4).alias("mae"), round_nearest(rmse_of(), 4).alias("rmse")
    )


def per_target(predictions: Predictions, by: Sequence[str] = ("model",)) -> DataFrame:
    keys = [*by, "target"]
    return error_sums(predictions, keys).select(
        *keys, mae_of().alias("mae"), rmse_of().alias("rmse"), mape_of().alias("mape")
    )


def evaluate_all(
    predictions: Predictions,
    by: Sequence[str] = ("model",),
    threshold: float = OVERLOAD_THRESHOLD,
) -> DataFrame:
    """All metrics, one row per scope: overall, per target, per horizon step.

    Overload columns are filled for per-target rows of utilisation targets. Per-step
    metrics are rounded to 4 digits and have no percentage error.
    """
    by = list(by)
    finest = error_sums(predictions, [*by, "target", "step"], threshold)
    sums = finest.groupingSets(
        [[*map(F.col, by)], [*map(F.col, by), F.col("target")], [*map(F.col, by), F.col("step")]],
        *by, "target", "step",
    ).agg(
        *[F.sum(c).alias(c) for c in _SUMS],
        F.grouping("target").alias("no_target"),
        F.grouping("step").alias("no_step"),
    )
    horizon = F.col("no_step") == 0
    scope = (
        F.when(horizon, "per_horizon")
        .when(F.col("no_target") == 0, "per_target")
        .otherwise("overall")
    )
    measured = sums.withColumn("scope", scope)
    keys = [*by, "scope", "target", "step"]
    flagged = (F.col("scope") == "per_target") & _is_overload_target()
    return _overload_columns(
        measured,
        [
            *keys,
            F.when(horizon, round_nearest(mae_of(), 4)).otherwise(mae_of()).alias("mae"),
            F.when(horizon, round_nearest(rmse_of(), 4)).otherwise(rmse_of()).alias("rmse"),
            F.when(~horizon, mape_of()).alias("mape"),
        ],
    ).withColumns({c: F.when(flagged, F.col(c)) for c in OVERLOAD_COLUMNS})


def evaluate_by_split(
    predictions: Predictions, split: str | None = "test", by: Sequence[str] = ("model",)
) -> DataFrame:
    """Evaluation of one split, or of each split side by side with ``split=None``."""
    if split is None:
        return evaluate_all(predictions, by=["split", *by])
    return evaluate_all(_of_split(predictions, split), by=by)


def _of_split(predictions: Predictions, split: str) -> Predictions:
    if isinstance(predictions, WindowPredictions):
        return replace(predictions, rows=_of_split(predictions.rows, split))
    return predictions.filter(F.col("split") == split)
