"""A Spark-native engine for telemetry analytics (traces, logs, metrics)."""

__version__ = "0.1.0"
