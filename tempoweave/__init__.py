"""Alignment, matching and quality scoring of multi-device time series on Spark."""
