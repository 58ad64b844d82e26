"""Parcel time series and windowed connectivity on Spark."""

__version__ = "0.1.0"
