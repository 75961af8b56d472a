"""Bulk entity-to-page resolution on Spark: one best web page per table row."""

__version__ = "0.1.0"
