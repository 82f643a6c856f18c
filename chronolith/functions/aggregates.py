"""Aggregates of temporal queries.

SUM of no value is 0 and skips NULL; MIN and MAX skip NULL and NaN and are NULL over no value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.catalog import parse_type

KINDS = ("sum", "min", "max", "count", "avg")
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class Aggregate:
    kind: str
    expression: str
    name: str
    type: T.DataType | None = None

    @property
    def cumulative(self) -> bool:
        """Whether running sums of what rows add and take away give it exactly."""
        if self.kind == "count":
            return True
        return self.kind in ("sum", "avg") and not isinstance(self.type, (T.FloatType, T.DoubleType))

    @property
    def selective(self) -> bool:
        return self.kind in ("min", "max")

    def value(self) -> Column:
        """The measure of one row; NULL where the aggregate skips it."""
        column = F.expr(self.expression)
        if self.type is not None:
            column = column.cast(self.type)
        if self.selective and isinstance(self.type, (T.FloatType, T.DoubleType)):
            column = F.when(~F.isnan(column), column)
        return column

    def sum_type(self) -> T.DataType:
        if isinstance(self.type, T.DecimalType):
            return T.DecimalType(38, self.type.scale)
        return T.LongType() if isinstance(self.type, _INTEGRAL) else T.DoubleType()

    def zero(self) -> Column:
        return F.lit(0).cast(self.sum_type())

    def over_rows(self) -> Column:
        """As an ordinary aggregate function."""
        value = self.value()
        if self.kind == "sum":
            return F.coalesce(F.sum(value).cast(self.sum_type()), self.zero())
        return {"min": F.min, "max": F.max, "count": F.count, "avg": F.avg}[self.kind](value)


def aggregate(kind: str, expression: str, name: str | None = None, type: str | T.DataType | None = None) -> Aggregate:  # noqa: A002
    """An aggregate by name, in any case."""
    kind = kind.lower()
    if kind not in KINDS:
        raise ValueError(f"unknown aggregate {kind}")
    found = parse_type(type) if type is not None else None
    if kind in ("sum", "avg"):
        if found is None:
            raise ValueError(f"{kind}({expression}) needs a type")
        if not isinstance(found, _NUMERIC):
            raise ValueError(f"{kind}({expression}): {found.simpleString()} is not numeric")
    if kind in ("min", "max") and isinstance(found, (T.BooleanType, T.StringType, T.BinaryType)):
        raise ValueError(f"{kind}({expression}): {found.simpleString()} is not supported")
    return Aggregate(kind, expression, name or f"{kind}_{expression}", found)


def sum_(expression: str, type: str, name: str | None = None) -> Aggregate:  # noqa: A002
    return aggregate("sum", expression, name, type)


def min_(expression: str, type: str, name: str | None = None) -> Aggregate:  # noqa: A002
    return aggregate("min", expression, name, type)


def max_(expression: str, type: str, name: str | None = None) -> Aggregate:  # noqa: A002
    return aggregate("max", expression, name, type)


def count_(expression: str = "1", name: str = "count") -> Aggregate:
    return aggregate("count", expression, name)


def avg_(expression: str, type: str, name: str | None = None) -> Aggregate:  # noqa: A002
    return aggregate("avg", expression, name, type)
