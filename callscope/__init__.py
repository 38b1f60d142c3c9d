"""Evaluate and compare scored binary calls with Spark DataFrames."""

__version__ = "0.1.0"
