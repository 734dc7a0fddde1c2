"""The site event log: the current file and rotated, compressed ones as one input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.analytics import parse_lines


def read_event_log(spark: SparkSession, pattern: str) -> DataFrame:
    """``bad, at, c, a`` rows of every file the pattern names; gzip is recognised by its suffix."""
    return parse_lines(spark.read.text(pattern))
