"""Spark-native web-log analytics: ingestion, statistics, features, models,
anomaly and drift detection, streaming windows and metric queries."""

__version__ = "0.1.0"
