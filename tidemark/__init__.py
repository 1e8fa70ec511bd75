"""Spark-native analytics over company filings, reported facts, prices, estimates and call text."""

__version__ = "0.1.0"
