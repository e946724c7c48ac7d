"""Weftline: web-corpus processing, indexing and search on Spark DataFrames."""

__version__ = "0.1.0"
