"""Spark-native record linkage and deduplication."""

__version__ = "0.1.0"
