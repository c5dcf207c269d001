"""Sketching, comparing and learning from large sparse feature tables on Spark."""

__version__ = "0.1.0"
