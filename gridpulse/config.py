"""Pipeline settings shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

SECONDS_PER_DAY = 86_400

# The default pipeline settings every result depends on.
DEFAULT_INTERVAL_SECONDS = 300
DEFAULT_SEQUENCE_LENGTH = 60
DEFAULT_HORIZON = 12
DEFAULT_TRAIN_RATIO = 0.70
DEFAULT_VAL_RATIO = 0.15
DEFAULT_FFILL_LIMIT = 3
FEATURE_COLUMNS = ("cpu_usage", "memory_usage", "assigned_memory", "cycles_per_instruction")
TARGET_COLUMNS = ("cpu_usage", "memory_usage")


@dataclass(frozen=True)
class PipelineConfig:
    """Settings of one pipeline run.

    ``block_rows`` is a physical setting: window functions run over blocks of that
    many bins (or rows) of one machine plus a small halo, so that no task ever
    holds a whole series. Results do not depend on it.
    """

    interval_seconds: int = DEFAULT_INTERVAL_SECONDS
    sequence_length: int = DEFAULT_SEQUENCE_LENGTH
    horizon: int = DEFAULT_HORIZON
    train_ratio: float = DEFAULT_TRAIN_RATIO
    val_ratio: float = DEFAULT_VAL_RATIO
    ffill_limit: int = DEFAULT_FFILL_LIMIT
    features: tuple[str, ...] = FEATURE_COLUMNS
    targets: tuple[str, ...] = TARGET_COLUMNS
    block_rows: int = 4000

    def __post_init__(self) -> None:
        if self.interval_seconds <= 0 or SECONDS_PER_DAY % self.interval_seconds:
            # Bins are counted from the epoch; only then do they also start at midnight.
            raise ValueError(
                f"interval_seconds must divide a day, got {self.interval_seconds}"
            )
        if min(self.sequence_length, self.horizon) < 1 or self.ffill_limit < 0:
            raise ValueError("sequence_length and horizon must be >= 1, ffill_limit >= 0")
        if self.block_rows <= max(self.window_length, self.ffill_limit):
            raise ValueError("block_rows must exceed sequence_length + horizon")

    @property
    def window_length(self) -> int:
        return self.sequence_length + self.horizon

    @property
    def interval_micros(self) -> int:
        return self.interval_seconds * 1_000_000
