"""Time travel: the rows, or an aggregate of the rows, that are valid at an instant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import Aggregate
from ..functions.periods import Instant, constant, contains
from ..plans.catalog import Catalog, Period, TemporalTable, parse_type
from .settings import WithOptions


class TimeTravel(WithOptions):
    """``TimeTravel(table).contains(period, t).where(...).select(...) | .agg(...) .df()``.

    A lazy plan: both bounds of the period and the filter reach the scan, and only the
    columns in use are read.
    """

    def __init__(self, table: TemporalTable | str, catalog: Catalog | None = None):
        if isinstance(table, str):
            if catalog is None:
                raise ValueError("a table's name needs a catalog")
            table = catalog.table(table)
        if not table.is_temporal:
            raise ValueError(f"table {table.name} has no period")
        super().__init__()
        self.table = table
        self._period: Period | None = None
        self._at: Instant | None = None
        self._where: list[str] = []
        self._items: list[tuple[str, str, str | None]] = []
        self._aggregates: list[Aggregate] = []

    def contains(self, period: str, t: Instant) -> TimeTravel:
        self._period = self.table.period(period)
        constant(t, self.table.schema[self._period.start].dataType)
        self._at = t
        return self

    def where(self, predicate: str) -> TimeTravel:
        self._where.append(predicate)
        return self

    def select(self, expression: str, name: str | None = None, type: str | None = None) -> TimeTravel:  # noqa: A002
        self._items.append((expression, name or expression, type))
        return self

    def agg(self, *aggregates: Aggregate) -> TimeTravel:
        self._aggregates.extend(aggregates)
        return self

    def rows(self) -> DataFrame:
        if self._period is None or self._at is None:
            raise ValueError("contains is missing")
        df = self.table.df()
        at = constant(self._at, self.table.schema[self._period.start].dataType)
        df = df.where(contains(F.col(self._period.start), F.col(self._period.end), at))
        for predicate in self._where:
            df = df.where(predicate)
        return df

    def _build(self) -> DataFrame:
        if self._items and self._aggregates:
            raise ValueError("either all items of a query are aggregates or none")
        if not self._items and not self._aggregates:
            raise ValueError("the query selects nothing")
        rows = self.rows()
        if self._aggregates:
            return rows.agg(*(a.over_rows().alias(a.name) for a in self._aggregates))
        return rows.select(*((F.expr(e) if t is None else F.expr(e).cast(parse_type(t))).alias(n) for e, n, t in self._items))
