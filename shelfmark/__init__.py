"""Shelfmark: a PySpark-native analytics engine for catalogue aggregation data."""

__version__ = "0.1.0"
