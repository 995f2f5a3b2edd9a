"""Subscription analytics as lazy Spark DataFrames."""

__version__ = "0.1.0"
