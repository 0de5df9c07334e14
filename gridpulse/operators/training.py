"""Fitting user models on the train windows (survey G7).

A trainer condenses the windows of a block to a state of fixed size, merges states and turns
the last one into parameters. States are built next to the rows and merged in levels, one
model for all machines or one for each; no task holds a machine's windows at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import isqrt
from typing import Protocol, runtime_checkable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.config import PipelineConfig
from gridpulse.operators.blocks import blocked_lookup
from gridpulse.operators.forecast import WINDOW_TYPE, NumpyForecaster, training_set
from gridpulse.operators.windows import map_windows, reject_short, scaled_blocks

Predictor = Callable[[np.ndarray], np.ndarray]


@runtime_checkable
class Trainer(Protocol):
    """What a user model offers to be fitted."""

    name: str

    def partial(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """State of some windows: x is (batch, S, F), y is (batch, H, T), scaled."""
        ...

    def merge(self, states: np.ndarray) -> np.ndarray:
        """One state for the rows of ``states``; their order and grouping must not matter."""
        ...

    def finish(self, state: np.ndarray) -> np.ndarray:
        """Parameters, a flat array."""
        ...

    def predictor(self, parameters: np.ndarray) -> Predictor:
        """A function from (batch, S, F) to (batch, H, T)."""
        ...


HELD_STATES = 64
_STATE = "machine_id string, part int, windows long, state array<double>"


class _Merging:
    """States of the machine at hand, merged before they pile up."""

    def __init__(self, trainer: Trainer, part: int):
        self.trainer, self.part = trainer, part
        self.machine, self.windows, self.states, self.started = None, 0, [], False

    def add(self, machine: str | None, windows: int, state: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.started and machine != self.machine:
            yield from self.close()
        self.machine, self.started = machine, True
        self.windows += windows
        self.states.append(np.asarray(state, dtype=float).ravel())
        if len(self.states) >= HELD_STATES:
            self.states = [self._merged()]

    def _merged(self) -> np.ndarray:
        if len(self.states) == 1:
            return self.states[0]
        return np.asarray(self.trainer.merge(np.stack(self.states)), dtype=float).ravel()

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.states:
            yield pa.RecordBatch.from_pydict(
                {
                    "machine_id": pa.array([self.machine], pa.string()),
                    "part": pa.array([self.part], pa.int32()),
                    "windows": pa.array([self.windows], pa.int64()),
                    "state": pa.array([self._merged()], pa.list_(pa.float64())),
                }
            )
        self.windows, self.states = 0, []


def _states(
    series: DataFrame,
    config: PipelineConfig,
    features: Sequence[str],
    targets: Sequence[str],
    trainer: Trainer,
    each_machine: bool,
) -> DataFrame:
    """A state per partition, or per partition and machine, of the train windows."""
    length, train_ratio = config.window_length, float(config.train_ratio)

    def make():
        merging = _Merging(trainer, TaskContext.get().partitionId())

        def each(machine_id, index, n, x, y):
            train = index < int((n - length + 1) * train_ratio)
            if train.any():
                state = trainer.partial(x[train], y[train])
                yield from merging.add(machine_id if each_machine else None, int(train.sum()), state)

        return each, merging.close

    columns = list(features) + [t for t in targets if t not in features]
    blocks = scaled_blocks(
        reject_short(series, config), columns, config, config.sequence_length - 1, config.horizon, "train"
    )
    return map_windows(blocks, features, targets, config, make, _STATE)


def _merge_level(states: DataFrame, groups: int, trainer: Trainer) -> DataFrame:
    """States of one machine and one of ``groups`` groups of partitions, merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merging = _Merging(trainer, TaskContext.get().partitionId())
        for batch in batches:
            for machine, _, windows, state in zip(*(c.to_pylist() for c in batch.columns)):
                yield from merging.add(machine, windows, np.array(state))
        yield from merging.close()

    group = F.pmod("part", F.lit(groups))
    dealt = states.repartition("machine_id", group).sortWithinPartitions("machine_id", "part")
    return dealt.mapInArrow(run, _STATE)


def _merged(states: DataFrame, trainer: Trainer) -> DataFrame:
    """One state per machine, in two levels of about the square root of the partitions."""
    parts = int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for groups in (isqrt(parts) or 1, 1):
        states = _merge_level(states, groups, trainer)
    return states


def fit(
    series: DataFrame,
    config: PipelineConfig,
    features: Sequence[str],
    targets: Sequence[str],
    trainer: Trainer,
    train_on: Sequence[str] | str | None = None,
) -> NumpyForecaster:
    """One model of the train windows of the chosen machines (see ``training_set``)."""
    chosen = training_set(series, train_on)
    states = _states(chosen, config, features, targets, trainer, each_machine=False)
    row = _merged(states, trainer).first()
    if row is None:
        raise ValueError("no training window in the given series")
    parameters = np.asarray(trainer.finish(np.array(row["state"])), dtype=float).ravel()
    return NumpyForecaster(
        trainer.name, trainer.predictor(parameters), {"windows": str(row["windows"])},
        len(parameters), len(features),
    )


def fit_each(
    series: DataFrame,
    config: PipelineConfig,
    features: Sequence[str],
    targets: Sequence[str],
    trainer: Trainer,
) -> DataFrame:
    """A model per machine: machine_id, windows, parameters. Machines without a train window
    have no row."""
    merged = _merged(_states(series, config, features, targets, trainer, each_machine=True), trainer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                np.asarray(trainer.finish(np.array(s)), dtype=float).ravel()
                for s in batch.column("state").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("machine_id"), batch.column("windows"), pa.array(made, pa.list_(pa.float64()))],
                names=["machine_id", "windows", "parameters"],
            )

    return merged.mapInArrow(run, "machine_id string, windows long, parameters array<double>")


def score_each(windows: DataFrame, models: DataFrame, trainer: Trainer) -> DataFrame:
    """Score windows (machine_id, ..., x) with the model of their machine.

    ``forecast`` takes the place of ``x``; a machine without a model has a null one.
    """
    joined = blocked_lookup(windows, models.select("machine_id", "parameters"))
    names = [c for c in windows.columns if c != "x"]
    schema = T.StructType([*windows.select(*names).schema.fields, T.StructField("forecast", WINDOW_TYPE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, predict = None, None
        for batch in batches:
            made = []
            rows = zip(batch.column("machine_id").to_pylist(), batch.column("x"), batch.column("parameters"))
            for owner, x, parameters in rows:
                if not parameters.is_valid or not x.is_valid:
                    made.append(None)
                    continue
                if predict is None or owner != machine:
                    machine, predict = owner, trainer.predictor(parameters.values.to_numpy())
                made.append(np.asarray(predict(np.array([x.as_py()], dtype=float)))[0].tolist())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(made, pa.list_(pa.list_(pa.float64())))],
                names=[*names, "forecast"],
            )

    return joined.select(*names, "x", "parameters").mapInArrow(run, schema)
