"""Temporal moment retrieval and media-library audits as Spark DataFrame jobs."""

__version__ = "0.1.0"
