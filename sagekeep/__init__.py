"""Spark-native analytics over a bi-temporal memory graph."""

__version__ = "0.1.0"
