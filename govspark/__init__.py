"""Governed analytics over tables and prompt logs, as Spark DataFrame code."""

__version__ = "0.1.0"
