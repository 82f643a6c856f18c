"""Valid-time analytics on Spark."""

from .functions.aggregates import aggregate, avg_, count_, max_, min_, sum_
from .operators.temporal_grouping import TemporalGrouping, coalesced
from .operators.time_travel import TimeTravel
from .plans.catalog import Catalog, Period, TableBuilder, TemporalTable
from .sources.csv_load import Load

__all__ = ["Catalog", "Load", "Period", "TableBuilder", "TemporalGrouping", "TemporalTable", "TimeTravel", "aggregate", "avg_", "coalesced", "count_", "max_", "min_", "sum_"]
