"""Phrase-frequency time series over timestamped text, on Spark DataFrames."""

__version__ = "0.1.0"
