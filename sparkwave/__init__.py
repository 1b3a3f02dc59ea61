"""Spark-native engine for multichannel recordings and training-data pipelines."""

__version__ = "0.1.0"
