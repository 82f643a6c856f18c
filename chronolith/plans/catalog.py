"""Temporal tables, their periods and the catalog."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_PRIMITIVE = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)
_INSTANT = (T.DateType, T.TimestampType, T.TimestampNTZType)


_NAMES = {
    "boolean": T.BooleanType, "tinyint": T.ByteType, "byte": T.ByteType, "smallint": T.ShortType, "short": T.ShortType, "int": T.IntegerType, "integer": T.IntegerType,
    "bigint": T.LongType, "long": T.LongType, "float": T.FloatType, "double": T.DoubleType, "string": T.StringType, "binary": T.BinaryType,
    "date": T.DateType, "timestamp": T.TimestampType, "timestamp_ltz": T.TimestampType, "timestamp_ntz": T.TimestampNTZType,
}


def parse_type(kind: str | T.DataType) -> T.DataType:
    """A Spark type from its name; CHAR and VARCHAR are strings without padding."""
    if isinstance(kind, T.DataType):
        return kind
    name = re.sub(r"\s", "", kind.lower())
    if name in _NAMES:
        return _NAMES[name]()
    if re.fullmatch(r"(var)?char\(\d+\)", name):
        return T.StringType()
    if found := re.fullmatch(r"decimal(?:\((\d+)(?:,(\d+))?\))?", name):
        return T.DecimalType(int(found[1] or 38), int(found[2] or 0)) if found[1] else T.DecimalType(38, 10)
    raise ValueError(f"unknown or compound type {kind}")


@dataclass(frozen=True)
class Period:
    """An application period ``[start, end)`` over two columns."""

    name: str
    start: str
    end: str


@dataclass
class TemporalTable:
    """A schema with application periods, over loads or over any DataFrame."""

    name: str
    schema: T.StructType
    periods: Mapping[str, Period]
    conf: dict[str, str] = field(default_factory=dict)
    location: str | None = None
    paths: list[str] = field(default_factory=list)
    source: DataFrame | None = None

    @classmethod
    def over(cls, name: str, df: DataFrame, **periods: tuple[str, str]) -> TemporalTable:
        """A table over a DataFrame; ``periods`` maps names to (start, end) columns."""
        builder = TableBuilder().create_table(name)
        for f in df.schema.fields:
            builder.add_column(f.name, f.dataType)
        for period, (start, end) in periods.items():
            builder.period_for(period, start, end)
        table = builder.build()
        table.source = df
        return table

    @property
    def is_temporal(self) -> bool:
        return bool(self.periods)

    @property
    def column_count(self) -> int:
        return len(self.schema.fields)

    @property
    def schema_string(self) -> str:
        return self.schema.simpleString()

    @property
    def storage_format(self) -> str:
        return self.conf.get("format", "parquet")

    def period(self, name: str) -> Period:
        if not self.is_temporal:
            raise ValueError(f"table {self.name} has no period")
        if name not in self.periods:
            raise ValueError(f"table {self.name} has no period {name}")
        return self.periods[name]

    def loads(self, spark: SparkSession) -> list[str]:
        """The folders of all finished loads: those below the table's location, whoever loaded them, and those told of in ``paths``."""
        found = set(self.paths)
        if self.location is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.location}/load-*/_SUCCESS")
            files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            done = (str(f.getPath().getParent().getName()) for f in files.globStatus(path) or ())
            found |= {f"{self.location}/{name}" for name in done if not name.endswith("-rejected")}
        return sorted(found)

    def df(self, spark: SparkSession | None = None) -> DataFrame:
        """All rows: the union of the loads, or the source."""
        if self.source is not None:
            return self.source
        spark = spark or SparkSession.active()
        paths = self.loads(spark)
        if not paths:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).format(self.storage_format).load(paths)

    def count(self, spark: SparkSession | None = None) -> int:
        return self.df(spark).count()


class TableBuilder:
    """``create_table(n).add_column(...).period_for(...).with_conf(...).build()``."""

    def __init__(self) -> None:
        self._name: str | None = None
        self._fields: list[T.StructField] = []
        self._periods: dict[str, Period] = {}
        self._conf: dict[str, str] = {}
        self._location: str | None = None

    def create_table(self, name: str) -> TableBuilder:
        if not name:
            raise ValueError("a table needs a name")
        self._name = name
        return self

    def add_column(self, name: str, kind: str | T.DataType) -> TableBuilder:
        if self._name is None:
            raise ValueError("create_table comes first")
        found = parse_type(kind)
        if not isinstance(found, _PRIMITIVE):
            raise ValueError(f"column {name}: only primitive types are supported, not {found.simpleString()}")
        if any(f.name == name for f in self._fields):
            raise ValueError(f"column {name} exists")
        self._fields.append(T.StructField(name, found))
        return self

    def period_for(self, name: str, start: str, end: str) -> TableBuilder:
        kinds = {f.name: f.dataType for f in self._fields}
        for column in (start, end):
            if column not in kinds:
                raise ValueError(f"period {name}: no column {column}")
            if not isinstance(kinds[column], _INSTANT):
                raise ValueError(f"period {name}: {column} is neither a date nor a timestamp")
        if kinds[start] != kinds[end]:
            raise ValueError(f"period {name}: {start} and {end} differ in type")
        if name in self._periods:
            raise ValueError(f"period {name} exists")
        self._periods[name] = Period(name, start, end)
        return self

    def with_conf(self, **conf: str) -> TableBuilder:
        self._conf |= {k: str(v) for k, v in conf.items()}
        return self

    def at(self, location: str) -> TableBuilder:
        """The folder that loads are written below."""
        self._location = location
        return self

    def build(self) -> TemporalTable:
        if self._name is None or not self._fields:
            raise ValueError("a table needs a name and columns")
        return TemporalTable(self._name, T.StructType(self._fields), dict(self._periods), dict(self._conf), self._location)


class Catalog:
    """Tables by name."""

    def __init__(self) -> None:
        self._tables: dict[str, TemporalTable] = {}

    def register(self, table: TemporalTable, spark: SparkSession | None = None) -> TemporalTable:
        self._tables[table.name] = table
        if spark is not None:
            table.df(spark).createOrReplaceTempView(table.name)
        return table

    def table(self, name: str) -> TemporalTable:
        if name not in self._tables:
            raise ValueError(f"no table {name}")
        return self._tables[name]

    def __contains__(self, name: str) -> bool:
        return name in self._tables
