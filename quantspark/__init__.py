"""PySpark-native analytics engine for market-style time-series panels."""

__version__ = "0.1.0"
