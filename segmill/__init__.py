"""Batch analytics over two-dimensional line segments, as Spark DataFrame operators keyed by document."""

__version__ = "0.1.0"
