"""Tidemark: Spark-native analytics over account histories, rating calls and dependency networks."""

__version__ = "0.1.0"
