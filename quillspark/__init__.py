"""Retrieval, evaluation and text preparation over a chunk relation, written as PySpark jobs."""

__version__ = "0.1.0"
