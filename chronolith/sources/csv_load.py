"""Bulk load of CSV files into temporal tables.

Every load writes a folder of its own below the table's location and is appended to
the table's paths.  Rows are clustered by period start, so that the minima and maxima of
row groups let a query skip most of a file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader

from ..plans.catalog import Catalog, TemporalTable

#: Option names and their defaults.
DEFAULTS = {"separator": ",", "quote": '"', "escape": "\\", "has-header-line": "false", "null-string": "null", "timestamp-format": ""}

#: The default form of timestamps: ``yyyy[-/]MM[-/]dd['T'| ]HH:mm:ss``, then a fraction, an offset, or both in any order.
_TIMESTAMP = r"^\s*(\d{4})[-/]?(\d{2})[-/]?(\d{2})[T ]?(\d{2}:\d{2}:\d{2})(\.\d{1,6})? ?(Z|[+-]\d{2}(?::?\d{2})?)?(\.\d{1,6})?\s*$"
_OFFSET = r"\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}(:?\d{2})?)$"


def typed(column: Column, kind: T.DataType, timestamp_format: str = "") -> Column:
    """A CSV field as a value; text that is not one of the type is an error when the row is read."""
    if isinstance(kind, T.BooleanType):
        return F.when(column.isNotNull(), F.lower(F.trim(column)).isin("true", "t", "1"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        if timestamp_format:
            return F.to_timestamp(column, timestamp_format).cast(kind)
        plain = F.trim(F.regexp_replace(column, _TIMESTAMP, "$1-$2-$3 $4$5$7$6"))
        # with an offset it is an instant, which a column without zone shows in the session's zone
        return F.when(plain.rlike(_OFFSET), plain.cast("timestamp").cast(kind)).otherwise(plain.cast(kind))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return column.cast(kind)
    return F.trim(column).cast(kind)


def csv_rows(reader: DataFrameReader | DataStreamReader, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """The typed rows of CSV files, one record per line, read at once or as a stream."""
    conf = DEFAULTS | {k.replace("_", "-"): v for k, v in options.items()}
    if unknown := set(conf) - set(DEFAULTS):
        raise ValueError(f"unknown options {sorted(unknown)}")
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = (
        reader.schema(text)
        .option("sep", conf["separator"])
        .option("quote", conf["quote"])
        .option("escape", conf["escape"])
        .option("header", conf["has-header-line"])
        .option("enforceSchema", "true")
        .option("nullValue", conf["null-string"])
        .option("mode", "FAILFAST")
        .option("multiLine", "false")
        .csv(path)
    )
    return raw.select(*(typed(F.col(f"`{f.name}`"), f.dataType, conf["timestamp-format"]).alias(f.name) for f in schema.fields))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """The typed rows of CSV files."""
    return csv_rows(spark.read, path, schema, **options)


def bad_period(table: TemporalTable) -> Column:
    """Whether some period of a row has a null end, or one that is not after its start."""
    bad = F.lit(False)
    for p in table.periods.values():
        bad = bad | F.coalesce(F.col(p.start) >= F.col(p.end), F.lit(True))
    return bad


class Load:
    """``Load(catalog).into_table(n).from_path(path, "csv").with_properties(...).execute(spark)``."""

    def __init__(self, catalog: Catalog):
        self._catalog = catalog
        self._table: TemporalTable | None = None
        self._path: str | None = None
        self._properties: dict[str, str] = {}
        self._parallel = 0
        self._quarantine = False

    def into_table(self, name: str) -> Load:
        self._table = self._catalog.table(name)
        if self._table.location is None:
            raise ValueError(f"table {name} has no location")
        return self

    def from_path(self, path: str, kind: str = "csv") -> Load:
        if kind != "csv":
            raise ValueError(f"{kind} files are not supported")
        self._path = path
        return self

    def with_properties(self, **properties: str) -> Load:
        self._properties |= properties
        return self

    def with_parallelism(self, n: int) -> Load:
        """Partitions of the load; 0 or less: as many as shuffle partitions."""
        self._parallel = n
        return self

    def quarantine(self, on: bool = True) -> Load:
        """Write rows with a bad period to a folder beside the load instead of failing."""
        self._quarantine = on
        return self

    def execute(self, spark: SparkSession) -> TemporalTable:
        if self._table is None or self._path is None:
            raise ValueError("into_table or from_path is missing")
        rows = read_csv(spark, self._path, self._table.schema, **self._properties)
        return append(spark, self._table, rows, self._parallel, self._quarantine)


def append(spark: SparkSession, table: TemporalTable, rows: DataFrame, parallel: int = 0, quarantine: bool = False, name: str | None = None) -> TemporalTable:
    """Append rows as a new load, clustered by the first period's start.

    A load with a ``name`` takes the place of one of that name, so that it can be repeated.
    """
    target = f"{table.location}/load-{name or uuid.uuid4().hex}"
    mode = "overwrite" if name else "errorifexists"
    bad = bad_period(table)
    if quarantine:
        rows.where(bad).write.format(table.storage_format).mode(mode).save(f"{target}-rejected")
        rows = rows.where(~bad)
    else:
        rows = rows.withColumn("_ok", F.when(bad, F.raise_error(F.lit("a period has a null end, or one that is not after its start"))).otherwise(F.lit(True))).where("_ok").drop("_ok")
    if table.is_temporal:
        first = next(iter(table.periods.values()))
        n = parallel if parallel > 0 else int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartitionByRange(n, first.start).sortWithinPartitions(first.start, first.end)
    elif parallel > 0:
        rows = rows.repartition(parallel)
    writer = rows.write.format(table.storage_format)
    for key, value in table.conf.items():
        if key != "format":
            writer = writer.option(key, value)
    writer.mode(mode).save(target)
    if target not in table.paths:
        table.paths.append(target)
    return table
