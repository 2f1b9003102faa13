"""Spark-first text mining, record cleaning and firm-year panel analytics."""

__version__ = "0.1.0"
