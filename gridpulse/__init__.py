"""Machine-telemetry analysis and forecasting as Spark DataFrame operators."""

from gridpulse.config import PipelineConfig

__all__ = ["PipelineConfig"]
