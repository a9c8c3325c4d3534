"""Tributary: analytics for streams of rated, free-text events, planned as Spark DataFrames."""

__version__ = "0.1.0"
