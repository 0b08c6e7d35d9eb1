"""PySpark-native analytics engine for long-term memory over message corpora."""

__version__ = "0.1.0"
