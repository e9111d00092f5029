"""Spark-native document distillation and retrieval engine."""

__version__ = "0.1.0"
