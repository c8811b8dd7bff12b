"""Structured log: one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks.schema import LOG_EVENT


def parse_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed log events; text around the object (a log prefix) is ignored, lines without one are dropped."""
    body = F.regexp_extract(column, r"(?s)(\{.*\})", 1)
    return (lines.select(F.from_json(F.nullif(body, F.lit("")), LOG_EVENT).alias("e")).where("e is not null")
            .select("e.*"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return parse_events(spark.read.text(path))


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    return parse_events(spark.readStream.text(path))
