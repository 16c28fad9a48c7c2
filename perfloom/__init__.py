"""Host-telemetry analytics on Spark DataFrames, for many runs and hosts at once."""

from .thresholds import RunThresholds, Thresholds

__all__ = ["RunThresholds", "Thresholds"]
