"""Temporal aggregation: aggregates over every constant interval of a time range.

The interval points are the distinct ends of the rows that pass the filter and overlap
the range, clipped to it; between two consecutive points the set of valid rows is
constant.  A row whose period has a null end, or one that is not after its start, is valid
at no instant and left out.

Physical forms, all of equi-joins and aggregations with a partial step before the shuffle:

* *Cumulative* aggregates (COUNT, and SUM and AVG of exact types): every row adds its
  values at its start and takes them away at its end; these changes are summed by instant,
  then added up along time.  Time is cut into windows: one pass sums each window, a running
  sum over the few windows gives each its carry, and every window then runs by itself, so
  no task sees all instants, and a result never depends on the number of windows.
* *Selective* aggregates (MIN, MAX) and sums of floating point numbers: every row's
  range of ticks is cut into at most ``2 log2(length)`` dyadic segments, whose values are
  aggregated by segment; an interval takes the aggregate over the segments that contain
  its start, one for each level.  A row that covers a million intervals costs no more than
  a few dozen segments, and nothing is subtracted, so sums do not drift.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.aggregates import Aggregate
from ..functions.periods import Instant, constant, ticks
from ..plans.catalog import Catalog, Period, TemporalTable
from .settings import WithOptions

#: A segment is ``index * _LEVELS + level``.
_LEVELS = 64


class TemporalGrouping(WithOptions):
    """``TemporalGrouping(table).overlaps(period, s, e).where(...).agg(...).df()``.

    The result has the columns of ``by`` if any, ``period_start``, ``period_end`` and the
    aggregates.  Intervals without a valid row are left out unless ``include_gaps``.
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
        self._range: tuple[Instant | None, Instant | None] = (None, None)
        self._where: list[str] = []
        self._aggregates: list[Aggregate] = []
        self._by: tuple[str, ...] = ()
        self._windows: int | None = None
        self._gaps = False

    def overlaps(self, period: str, start: Instant | None = None, end: Instant | None = None) -> TemporalGrouping:
        """The range ``[start, end)``; None leaves that side open."""
        self._period = self.table.period(period)
        kind = self.table.schema[self._period.start].dataType
        for bound in (start, end):
            if bound is not None:
                constant(bound, kind)
        if start is not None and end is not None and not start < end:
            raise ValueError("the range is empty")
        self._range = (start, end)
        return self

    def where(self, predicate: str) -> TemporalGrouping:
        self._where.append(predicate)
        return self

    def agg(self, *aggregates: Aggregate) -> TemporalGrouping:
        self._aggregates.extend(aggregates)
        return self

    def by(self, *columns: str) -> TemporalGrouping:
        self._by = columns
        return self

    def windows(self, n: int) -> TemporalGrouping:
        """The number of time windows; 0 or less: as many as shuffle partitions."""
        self._windows = n if n > 0 else None
        return self

    def include_gaps(self, on: bool = True) -> TemporalGrouping:
        self._gaps = on
        return self

    def rows(self) -> DataFrame:
        """The rows in range: the keys, ``_b`` and ``_e`` (clipped ends) and a measure for each aggregate."""
        if self._period is None:
            raise ValueError("overlaps is missing")
        if not self._aggregates:
            raise ValueError("the query selects nothing")
        names = [a.name for a in self._aggregates]
        if len({*names, *self._by}) < len(names) + len(self._by):
            raise ValueError("names of the result repeat")
        kind = self.table.schema[self._period.start].dataType
        start, end = F.col(self._period.start), F.col(self._period.end)
        low, high = (None if x is None else constant(x, kind) for x in self._range)
        df = self.table.df().where(start < end)
        if low is not None:
            df = df.where(end > low)
        if high is not None:
            df = df.where(start < high)
        for predicate in self._where:
            df = df.where(predicate)
        b = start if low is None else F.greatest(start, low)
        e = end if high is None else F.least(end, high)
        return df.select(*self._by, b.alias("_b"), e.alias("_e"), *(a.value().alias(f"_v{k}") for k, a in enumerate(self._aggregates)))

    def _build(self) -> DataFrame:
        rows = self.rows()
        kind = self.table.schema[self._period.start].dataType
        by = [f"_k{i}" for i in range(len(self._by))]
        rows = rows.toDF(*by, *rows.columns[len(by) :])
        low, high = self._tick_range(rows, kind)
        intervals = self._intervals(rows, by, kind, low, high)
        selected = [(k, a) for k, a in enumerate(self._aggregates) if not a.cumulative]
        if selected:
            found = _by_segments(rows, intervals, by, kind, selected, (high - low).bit_length())
            same = [F.col(f"i.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
            on = F.col("i._t") == F.col("s._t")
            for x in same:
                on = on & x
            intervals = intervals.alias("i").join(found.alias("s"), on, "left").select("i.*", *(f"s._r{k}" for k, _ in selected))
        kept = intervals.where(F.col("_te").isNotNull())
        if not self._gaps:
            kept = kept.where(F.col("_n") > 0)
        return kept.select(
            *(F.col(k).alias(name) for k, name in zip(by, self._by, strict=True)),
            F.col("_t").alias("period_start"),
            F.col("_te").alias("period_end"),
            *(self._result(k, a).alias(a.name) for k, a in enumerate(self._aggregates)),
        )

    def _result(self, k: int, a: Aggregate) -> Column:
        if not a.cumulative:
            return F.coalesce(F.col(f"_r{k}"), a.zero()) if a.kind == "sum" else F.col(f"_r{k}")
        if a.kind == "count":
            return F.col(f"_c{k}")
        total = F.coalesce(F.col(f"_s{k}"), a.zero()).cast(a.sum_type())
        return total if a.kind == "sum" else F.when(F.col(f"_c{k}") > 0, total.cast("double") / F.col(f"_c{k}"))

    def _intervals(self, rows: DataFrame, by: Sequence[str], kind: T.DataType, low: int, high: int) -> DataFrame:
        """One row for each point: ``_t``, ``_te`` (the next one), ``_n`` valid rows, and running sums."""
        cumulative = [(k, a) for k, a in enumerate(self._aggregates) if a.cumulative]

        def change(sign: int, at: str) -> Column:
            parts = [F.col(at).alias("_t"), F.lit(sign).cast("long").alias("_n")]
            for k, a in cumulative:
                there = F.col(f"_v{k}").isNotNull().cast("long") * sign
                parts.append(there.alias(f"_c{k}"))
                if a.kind != "count":
                    parts.append((F.col(f"_v{k}").cast(a.sum_type()) * sign if not _is_decimal(a) else _signed(F.col(f"_v{k}"), sign)).alias(f"_s{k}"))
            return F.struct(*parts)

        sums = ["_n"] + [f"_c{k}" for k, _ in cumulative] + [f"_s{k}" for k, a in cumulative if a.kind != "count"]
        types = {f"_s{k}": a.sum_type() for k, a in cumulative if a.kind != "count"}
        events = rows.select(*by, F.explode(F.array(change(1, "_b"), change(-1, "_e"))).alias("_x")).select(*by, "_x.*")
        points = events.groupBy(*by, "_t").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast(types.get(c, "long")).alias(c) for c in sums))

        n = self._windows or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        points = points.withColumn("_i", ticks("_t", kind))
        width = max(1, -(-(high - low) // n))
        points = points.withColumn("_w", F.floor((F.col("_i") - F.lit(low)) / F.lit(width)).cast("long"))
        whole = points.groupBy(*by, "_w").agg(*(F.sum(c).cast(types.get(c, "long")).alias(c) for c in sums), F.min("_t").alias("_first"))
        along = Window.partitionBy(*by).orderBy("_w")
        before = along.rowsBetween(Window.unboundedPreceding, -1)
        carry = whole.select(
            *(F.col(c).alias(f"{c}_w") for c in by),
            F.col("_w").alias("_w_w"),
            *(F.coalesce(F.sum(c).over(before), F.lit(0)).cast(types.get(c, "long")).alias(f"{c}_carry") for c in sums),
            F.lead("_first").over(along).alias("_after"),
        )
        on = F.col("_w").eqNullSafe(F.col("_w_w"))  # no null filters, so that both sides share one exchange of changes
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"{c}_w"))
        joined = points.join(carry, on)
        inside = Window.partitionBy(*by, "_w").orderBy("_t")
        running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return joined.select(
            *by,
            "_t",
            F.coalesce(F.lead("_t").over(inside), F.col("_after")).alias("_te"),
            *((F.col(f"{c}_carry") + F.sum(c).over(running)).cast(types.get(c, "long")).alias(c) for c in sums),
        )

    def _tick_range(self, rows: DataFrame, kind: T.DataType) -> tuple[int, int]:
        """Ticks of the range; an open side takes the data's least start or largest end."""
        spark = rows.sparkSession
        bounds = [None if x is None else spark.range(1).select(constant(x, kind).alias("t")).select(ticks("t", kind)).first()[0] for x in self._range]
        if None in bounds:
            found = rows.agg(F.min("_b").alias("b"), F.max("_e").alias("e")).select(ticks("b", kind), ticks("e", kind)).first()
            bounds = [x if x is not None else (found[i] or 0) for i, x in enumerate(bounds)]
        return bounds[0], max(bounds[1], bounds[0] + 1)


def _is_decimal(a: Aggregate) -> bool:
    return "decimal" in a.sum_type().simpleString()


def _signed(column: Column, sign: int) -> Column:
    return column if sign > 0 else -column


def _by_segments(rows: DataFrame, intervals: DataFrame, by: Sequence[str], kind: T.DataType, selected: Sequence[tuple[int, Aggregate]], levels: int) -> DataFrame:
    """Aggregates by interval start: rows (keys, ``_t``, ``_r<k>``); no row is longer than ``2 ** levels`` ticks."""
    parts, merged, result = [], [], []
    for k, a in selected:
        if a.selective:
            f = F.min if a.kind == "min" else F.max
            parts.append(f(f"_v{k}").alias(f"_p{k}"))
            merged.append(f(f"_p{k}").alias(f"_p{k}"))
            result.append(F.col(f"_p{k}").alias(f"_r{k}"))
        else:
            parts += [F.sum(f"_v{k}").alias(f"_p{k}"), F.count(f"_v{k}").alias(f"_q{k}")]
            merged += [F.sum(f"_p{k}").alias(f"_p{k}"), F.sum(f"_q{k}").alias(f"_q{k}")]
            result.append((F.col(f"_p{k}") if a.kind == "sum" else F.col(f"_p{k}") / F.col(f"_q{k}")).alias(f"_r{k}"))
    spans = rows.groupBy(*by, "_b", "_e").agg(*parts).withColumn("_lo", ticks("_b", kind)).withColumn("_hi", ticks("_e", kind))
    segments = []
    for level in range(levels):
        low, high = F.expr(f"shiftright(_lo + {(1 << level) - 1}L, {level})"), F.expr(f"shiftright(_hi, {level})")
        left = F.when((low < high) & (low.bitwiseAND(F.lit(1)) == 1), low * _LEVELS + level)
        right = F.when((low < high) & (high.bitwiseAND(F.lit(1)) == 1), (high - 1) * _LEVELS + level)
        segments += [left, right]
    values = [c for c in spans.columns if c.startswith(("_p", "_q"))]
    cut = spans.select(*by, F.explode(F.array_compact(F.array(*segments))).alias("_g"), *values)
    segment = cut.groupBy(*by, "_g").agg(*merged)
    chain = F.array(*(F.expr(f"shiftright(_i, {level})") * _LEVELS + level for level in range(levels)))
    starts = intervals.where("_n > 0").select(*by, "_t", ticks("_t", kind).alias("_i")).select(*by, "_t", F.explode(chain).alias("_g"))
    on = F.col("a._g") == F.col("b._g")
    for c in by:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = starts.alias("a").join(segment.hint("merge").alias("b"), on).select(*(f"a.{c}" for c in by), "a._t", *(f"b.{c}" for c in values))
    return joined.groupBy(*by, "_t").agg(*merged).select(*by, "_t", *result)


def coalesced(result: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Join neighbouring intervals whose other columns are equal.

    Intervals are compared within windows of time; only the first and the last of each window,
    a few for each shuffle partition and key, are compared across windows.
    """
    values = [c for c in result.columns if c not in (*by, "period_start", "period_end")]
    kind = result.schema["period_start"].dataType
    timed = result.withColumn("_i", ticks("period_start", kind))
    low, high = timed.agg(F.min("_i"), F.max("_i")).first()
    if low is None:
        return result.select(*by, "period_start", "period_end", *values)
    width = (high - low) // int(result.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1
    timed = timed.withColumn("_w", F.floor((F.col("_i") - F.lit(low)) / F.lit(width)).cast("long"))

    def follows(end: Column, before: Sequence[Column], start: Column, after: Sequence[Column]) -> Column:
        same = end.eqNullSafe(start)
        for x, y in zip(before, after, strict=True):
            same = same & x.eqNullSafe(y)
        return same

    columns = [F.col(c) for c in values]
    inside = Window.partitionBy(*by, "_w").orderBy("period_start")
    joins = follows(F.lag("period_end").over(inside), [F.lag(c).over(inside) for c in values], F.col("period_start"), columns)
    marked = timed.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(inside))
    part = F.struct("period_start", "period_end", *values)
    edges = marked.groupBy(*by, "_w").agg(F.min_by(part, "period_start").alias("first"), F.max_by(part, "period_start").alias("last"), F.sum("_new").alias("runs"))
    along = Window.partitionBy(*by).orderBy("_w")
    last, first = F.lag("last").over(along), F.col("first")
    edges = edges.withColumn("_joins", F.when(follows(last["period_end"], [last[c] for c in values], first["period_start"], [first[c] for c in values]), 1).otherwise(0))
    # runs that began before this window, less one where its first interval goes on with the last of them
    before = F.sum(F.col("runs") - F.col("_joins")).over(along) - F.col("runs")
    edges = edges.select(*(F.col(c).alias(f"{c}_w") for c in by), F.col("_w").alias("_w_w"), before.alias("_before"))
    on = F.col("_w") == F.col("_w_w")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_w"))
    runs = marked.join(edges, on).withColumn("_run", F.col("_before") + F.col("_run"))
    return runs.groupBy(*by, "_run", *values).agg(F.min("period_start").alias("period_start"), F.max("period_end").alias("period_end")).select(*by, "period_start", "period_end", *values)
