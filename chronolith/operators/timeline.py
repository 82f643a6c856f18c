"""The endpoint events of a period: what a timeline index orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import TemporalTable

STARTS, ENDS = 0, 1


def endpoint_events(table: TemporalTable, period: str, *carry: str) -> DataFrame:
    """Rows (version, flag, carried columns): flag 0 where a row becomes valid, 1 where it ends."""
    p = table.period(period)
    event = lambda at, flag: F.struct(F.col(at).alias("version"), F.lit(flag).alias("flag"))
    return table.df().select(F.explode(F.array(event(p.start, STARTS), event(p.end, ENDS))).alias("x"), *carry).select("x.*", *carry)


def build_index(table: TemporalTable, period: str, *carry: str, partitions: int | None = None) -> DataFrame:
    """Events in order of version over range partitions: partition k holds versions before those of k + 1."""
    events = endpoint_events(table, period, *carry)
    n = partitions or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return events.repartitionByRange(n, "version").sortWithinPartitions("version", "flag")


def event_counts(table: TemporalTable, period: str) -> DataFrame:
    """Rows (version, flag, rows)."""
    return endpoint_events(table, period).groupBy("version", "flag").agg(F.count(F.lit(1)).alias("rows"))


def period_report(table: TemporalTable, period: str) -> DataFrame:
    """Rows (state, rows): how many rows have a valid, null or inverted period."""
    p = table.period(period)
    state = F.when(F.col(p.start).isNull() | F.col(p.end).isNull(), "null").when(F.col(p.start) < F.col(p.end), "valid").otherwise("inverted")
    return table.df().groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("rows"))
