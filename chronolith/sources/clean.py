"""Cleaning of trip records into CSV files of one year."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def clean_trips(trips: DataFrame, start: str, end: str, low: dt.datetime, high: dt.datetime) -> DataFrame:
    """Trips that overlap ``[low, high)`` and start before they end."""
    at = lambda t, column: F.lit(t).cast(trips.schema[column].dataType)
    return trips.where((F.col(start) < at(high, start)) & (F.col(end) > at(low, end)) & (F.col(start) < F.col(end)))


def prepare(spark: SparkSession, source: str, target: str, start: str, end: str, year: int) -> None:
    """Parquet files to CSV: no header, NULL as ``null``."""
    rows = clean_trips(spark.read.parquet(source), start, end, dt.datetime(year, 1, 1), dt.datetime(year + 1, 1, 1))
    rows.write.option("nullValue", "null").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(target)
