"""Keyed sensor time series on Spark: alignment, features, audits, forecasts."""

__version__ = "0.1.0"
