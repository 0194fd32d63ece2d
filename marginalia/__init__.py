"""Marginalia: PySpark-native analytics for batches of questions and answers."""

__version__ = "0.1.0"
