"""A PySpark-native engine that treats text corpora and telemetry as data."""

__version__ = "0.1.0"
