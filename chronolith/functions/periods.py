"""Predicates and integer time of periods."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Instant = dt.date | dt.datetime


def constant(value: Instant, kind: T.DataType) -> Column:
    """A query constant as a literal of the period's type, so that it can be pushed to the scan."""
    if isinstance(value, str) or not isinstance(value, dt.date):
        raise ValueError("a time constant must be a date or a datetime")
    if isinstance(kind, T.DateType):
        if isinstance(value, dt.datetime):
            raise ValueError("a period of dates takes a date")
        return F.lit(value)
    if not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    name = "TIMESTAMP_NTZ" if isinstance(kind, T.TimestampNTZType) else "TIMESTAMP"
    return F.expr(f"{name}'{value.isoformat(sep=' ')}'")


def contains(start: Column, end: Column, t: Column) -> Column:
    return (start <= t) & (end > t)


def ticks(column: str, kind: T.DataType) -> Column:
    """Days or microseconds since 1970 as a long."""
    if isinstance(kind, T.DateType):
        return F.expr(f"cast(unix_date(`{column}`) AS bigint)")
    name = "TIMESTAMP_NTZ" if isinstance(kind, T.TimestampNTZType) else "TIMESTAMP"
    return F.expr(f"timestampdiff(MICROSECOND, {name}'1970-01-01 00:00:00', `{column}`)")
