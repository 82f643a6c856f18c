"""Registered queries of the temporal engine and the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
import tempfile
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aggregates import Aggregate, avg_, count_, max_, min_, sum_
from ..operators.temporal_grouping import TemporalGrouping, coalesced
from ..operators.time_travel import TimeTravel
from ..operators.timeline import build_index, event_counts, period_report
from ..sources.clean import clean_trips
from ..sources.csv_load import Load
from .catalog import Catalog, TableBuilder, TemporalTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

D = dt.date
TS = dt.datetime
MONEY = "decimal(12,2)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- relations -------------------------------------------------------------------------


def bih_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a validity period in days."""
    begin = F.col("l_shipdate").cast("date")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_quantity").cast(MONEY).alias("quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("price"),
        F.col("l_discount").cast(MONEY).alias("discount"),
        F.col("l_tax").cast(MONEY).alias("tax"),
        F.col("l_returnflag").alias("return_flag"),
        F.col("l_linestatus").alias("line_status"),
        begin.alias("active_begin"),
        F.date_add(begin, (F.col("l_linenumber") * 7 + F.col("l_quantity")).cast("int")).alias("active_end"),
        F.date_add(begin, F.col("l_linenumber").cast("int")).alias("commit_date"),
        F.date_add(begin, F.col("l_quantity").cast("int")).alias("receipt_date"),
    )


def bih(spark: SparkSession, sf_dir: str) -> TemporalTable:
    return TemporalTable.over("lineitem_bih", bih_rows(spark, sf_dir), active=("active_begin", "active_end"), ship=("active_begin", "receipt_date"))


BIH = """bih AS (SELECT l_orderkey AS order_key, l_linenumber AS line_number, l_quantity::DECIMAL(12,2) AS quantity, l_extendedprice::DECIMAL(12,2) AS price,
    l_discount::DECIMAL(12,2) AS discount, l_tax::DECIMAL(12,2) AS tax, l_returnflag AS return_flag, l_linestatus AS line_status, l_shipdate::DATE AS active_begin,
    l_shipdate::DATE + (l_linenumber * 7 + l_quantity)::INT AS active_end, l_shipdate::DATE + l_linenumber::INT AS commit_date, l_shipdate::DATE + l_quantity::INT AS receipt_date FROM lineitem)"""


def validity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are valid until the next one of the user."""
    from pyspark.sql.window import Window

    until = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("value").cast(MONEY).alias("value"), F.col("value").alias("raw"), F.col("ts").alias("valid_from"), F.coalesce(until, F.expr("TIMESTAMP_NTZ'2024-02-01 00:00:00'")).alias("valid_to"))
    return rows.where("valid_from < valid_to")


def validity(spark: SparkSession, sf_dir: str) -> TemporalTable:
    return TemporalTable.over("event_validity", validity_rows(spark, sf_dir), valid=("valid_from", "valid_to"))


VALIDITY = """ev AS (SELECT * FROM (SELECT event_id, user_id, event_type, value::DECIMAL(12,2) AS value, value AS raw, ts AS valid_from,
    coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '2024-02-01 00:00:00') AS valid_to FROM events) WHERE valid_from < valid_to)"""


# --- SQL templates ---------------------------------------------------------------------


def _literal(x: dt.date) -> str:
    return f"TIMESTAMP '{x}'" if isinstance(x, dt.datetime) else f"DATE '{x}'"


def travel_sql(source: str, relation: str, start: str, end: str, at: dt.date, items: str, where: str = "true") -> str:
    return f"WITH {source} SELECT {items} FROM {relation} WHERE {start} <= {_literal(at)} AND {end} > {_literal(at)} AND ({where})"


def grouping_sql(source: str, relation: str, start: str, end: str, low: dt.date | None, high: dt.date | None, items: str, where: str = "true", by: str = "", gaps: bool = False) -> str:
    b = start if low is None else f"greatest({start}, {_literal(low)})"
    e = end if high is None else f"least({end}, {_literal(high)})"
    inside = " AND ".join([f"({where})"] + ([] if low is None else [f"{end} > {_literal(low)}"]) + ([] if high is None else [f"{start} < {_literal(high)}"]))
    key, part, same = (f"{by}, ", f"PARTITION BY {by} ", f"iv.{by} IS NOT DISTINCT FROM r.{by} AND ") if by else ("", "", "")
    out = f"iv.{by} AS {by}, " if by else ""
    return f"""WITH {source}, r AS (SELECT *, {b} AS b_, {e} AS e_ FROM {relation} WHERE {inside}),
        pts AS (SELECT {key}b_ AS t_ FROM r UNION SELECT {key}e_ FROM r),
        iv AS (SELECT {key}t_, lead(t_) OVER ({part}ORDER BY t_) AS te_ FROM pts)
        SELECT {out}t_ AS period_start, te_ AS period_end, {items} FROM iv {"LEFT " if gaps else ""}JOIN r ON {same}b_ <= t_ AND e_ > t_
        WHERE te_ IS NOT NULL GROUP BY {f"iv.{by}, " if by else ""}t_, te_"""


_SQL_KIND = {"decimal(38,2)": "DECIMAL(38,2)", "decimal(12,2)": "DECIMAL(12,2)", "decimal(38,6)": "DECIMAL(38,6)", "bigint": "BIGINT", "double": "DOUBLE", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def items_sql(aggregates: Sequence[Aggregate]) -> str:
    out = []
    for a in aggregates:
        kind = a.type.simpleString() if a.type is not None else ""
        value = f"({a.expression})::{_SQL_KIND.get(kind, kind)}" if kind else f"({a.expression})"
        if a.kind == "sum":
            out.append(f"coalesce(sum({value}), 0)::{_SQL_KIND[a.sum_type().simpleString()]} AS {a.name}")
        elif a.kind == "avg":
            out.append(f"(sum({value})::DOUBLE / count({value})) AS {a.name}")
        else:
            out.append(f"{a.kind}({value}) AS {a.name}")
    return ", ".join(out)


def plain(df: DataFrame) -> DataFrame:
    """Dates as text and decimals as doubles, so that results of two engines compare as values."""
    kinds = {"date": "string", "decimal": "double"}
    return df.select(*(F.col(c).cast(kinds[k]) if (k := kind.split("(")[0]) in kinds else F.col(c) for c, kind in df.dtypes))


def plain_sql(sql: str, kinds: dict[str, str]) -> str:
    """The same for SQL: ``kinds`` names the columns that are dates or decimals."""
    casts = {"date": "VARCHAR", "decimal": "DOUBLE"}
    swapped = ", ".join(f"CAST({c} AS {casts[k]}) AS {c}" for c, k in kinds.items())
    return f"SELECT * REPLACE ({swapped}) FROM ({sql})" if swapped else sql


_COLUMN_KINDS = {"quantity": "decimal", "price": "decimal", "discount": "decimal", "tax": "decimal", "value": "decimal", "active_begin": "date", "active_end": "date", "commit_date": "date", "receipt_date": "date"}


def _kinds(aggregates: Sequence[Aggregate], dates: bool = False) -> dict[str, str]:
    out = {"period_start": "date", "period_end": "date"} if dates else {}
    for a in aggregates:
        kind = a.type.simpleString().split("(")[0] if a.type is not None and a.kind not in ("count", "avg") else ""
        if kind in ("date", "decimal"):
            out[a.name] = kind
    return out


# --- registration ----------------------------------------------------------------------


def _travel(name: str, table: Callable, period: tuple[str, str, str], source: tuple[str, str], at: dt.date, aggregates: Sequence[Aggregate] = (), select: Sequence[tuple[str, str, str | None]] = (), where: str = "true") -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = TimeTravel(table(spark, sf_dir)).contains(period[0], at).where(where).agg(*aggregates)
        for item in select:
            q.select(*item)
        return plain(q.df())

    QUERIES[name] = query
    items = items_sql(aggregates) if aggregates else ", ".join(f"{f'({e})::{_SQL_KIND[t]}' if t else e} AS {n}" for e, n, t in select)
    kinds = _kinds(aggregates) | {n: k for e, n, t in select if (k := "decimal" if t and t.startswith("decimal") else _COLUMN_KINDS.get(e, ""))}
    ORACLES[name] = plain_sql(travel_sql(*source, period[1], period[2], at, items, where), kinds)


def _grouping(
    name: str, table: Callable, period: tuple[str, str, str], source: tuple[str, str], low: dt.date | None, high: dt.date | None, aggregates: Sequence[Aggregate], where: str = "true", by: str = "", gaps: bool = False, windows: int = 0
) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = TemporalGrouping(table(spark, sf_dir)).overlaps(period[0], low, high).where(where).agg(*aggregates).include_gaps(gaps).windows(windows)
        return plain((q.by(by) if by else q).df())

    QUERIES[name] = query
    ORACLES[name] = plain_sql(grouping_sql(*source, period[1], period[2], low, high, items_sql(aggregates), where, by, gaps), _kinds(aggregates, source[1] != "ev"))


_B = (bih, ("active", "active_begin", "active_end"), (BIH, "bih"))
_SHIP = (bih, ("ship", "active_begin", "receipt_date"), (BIH, "bih"))
_V = (validity, ("valid", "valid_from", "valid_to"), (VALIDITY, "ev"))
_MID, _EARLY, _LATE = D(1998, 6, 12), D(1995, 3, 12), D(2001, 10, 3)

_travel("tt_select_date", *_B, D(1996, 2, 12), select=[("order_key", "order_key", None), ("quantity", "quantity", None), ("price * (1 - discount)", "net", "decimal(38,6)"), ("active_begin", "active_begin", None), ("active_end", "active_end", None)], where="line_number = 6 AND discount > 0.03")
_travel("tt_sum", *_B, D(1996, 2, 12), [sum_("price", MONEY, "sum_price")], where="line_number < 4")
_travel("tt_max", *_B, D(1996, 2, 12), [max_("price", MONEY, "max_price")], where="line_number < 6")
_travel("tt_min", *_B, D(1996, 2, 12), [min_("price", MONEY, "min_price")], where="line_number < 6")
_travel("tt_multi_agg", *_B, D(1997, 7, 1), [sum_("quantity", MONEY, "sum_quantity"), min_("price", MONEY, "min_price"), max_("discount", MONEY, "max_discount"), count_("1", "n")])
_travel("tt_expr_agg", *_B, D(1996, 2, 12), [max_("price * (1 - discount)", "decimal(38,6)", "net"), max_("price * (1 - discount) * (1 + tax)", "decimal(38,6)", "gross")], where="return_flag = 'N' OR line_number <= 3")
_travel("tt_bounds", *_B, D(1996, 1, 1), [count_("1", "n"), count_("CASE WHEN active_begin = DATE '1996-01-01' THEN 1 END", "starting"), count_("CASE WHEN active_end = DATE '1996-01-01' THEN 1 END", "ended")])
_travel("tt_empty", *_B, D(1970, 1, 1), [sum_("price", MONEY, "sum_price"), max_("price", MONEY, "max_price")])
_travel("tt_empty_select", *_B, D(1970, 1, 1), select=[("order_key", "order_key", None)])
_travel("tt_string", *_B, D(1999, 5, 5), select=[("return_flag", "return_flag", None), ("line_status", "line_status", None), ("line_number", "line_number", None)], where="line_number = 7")
_travel("tt_ts_select", *_V, TS(2024, 1, 10), select=[("event_id", "event_id", None), ("user_id", "user_id", None), ("event_type", "event_type", None), ("value", "value", None), ("valid_from", "valid_from", None), ("valid_to", "valid_to", None)])
_travel("tt_ts_agg", *_V, TS(2024, 1, 10), [max_("value", MONEY, "max_value"), sum_("value", MONEY, "sum_value")], where="event_type <> 'view' AND value > 5")
_travel(
    "tt_expression_language", *_B, D(1997, 7, 1),
    select=[
        ("order_key", "order_key", None), ("line_number", "line_number", None), ("CAST(price AS double) / CAST(quantity AS double)", "unit_price", "double"), ("power(CAST(quantity AS double), 2)", "squared", "double"),
        ("CASE WHEN return_flag = 'N' THEN 'kept' ELSE 'returned' END", "state", None), ("order_key % 7 + line_number * 2 - 1", "mixed", None),
    ],
    where="quantity BETWEEN 10 AND 12 AND regexp_extract(return_flag, '[AR]', 0) = '' AND (price > 20000 OR discount <= 0.02)",
)
_travel("tt_second_period", *_SHIP, D(1996, 2, 12), [sum_("price", MONEY, "sum_price"), count_("1", "n")])

_SUM_QUANTITY = [sum_("quantity", MONEY, "sum_quantity")]
_MIN_PRICE = [min_("price", MONEY, "min_price")]
_EIGHT = [
    max_("quantity", MONEY, "a1"), max_("price", MONEY, "a2"), max_("discount", MONEY, "a3"), max_("tax", MONEY, "a4"), max_("price * (1 - discount)", "decimal(38,6)", "a5"),
    max_("price * (1 - discount) * (1 + tax)", "decimal(38,6)", "a6"), max_("commit_date", "date", "a7"), max_("receipt_date", "date", "a8"),
]
_grouping("tg_a1", *_B, _MID, _MID + dt.timedelta(26), _SUM_QUANTITY)
_grouping("tg_a2", *_B, _MID, _MID + dt.timedelta(26), _MIN_PRICE)
_grouping("tg_b1", *_B, _EARLY, _EARLY + dt.timedelta(3), _SUM_QUANTITY)
_grouping("tg_b2", *_B, _LATE, _LATE + dt.timedelta(3), _SUM_QUANTITY)
_grouping("tg_b3", *_B, _EARLY, _EARLY + dt.timedelta(26), _SUM_QUANTITY)
_grouping("tg_b4", *_B, _LATE, _LATE + dt.timedelta(26), _SUM_QUANTITY)
_grouping("tg_b5", *_B, D(1995, 1, 1), D(2001, 12, 31), _SUM_QUANTITY)
_grouping("tg_c1", *_B, _MID, _MID + dt.timedelta(3), _EIGHT)
_grouping("tg_where", *_B, D(1996, 2, 12), D(1996, 3, 12), [sum_("quantity", MONEY, "sum_quantity"), min_("price", MONEY, "min_price"), max_("discount", MONEY, "max_discount")], where="return_flag = 'N'")
_grouping("tg_minmax_whole", *_B, None, None, [min_("price", MONEY, "min_price"), max_("price", MONEY, "max_price"), sum_("quantity", MONEY, "sum_quantity")])
_grouping("tg_tail", *_B, D(2001, 9, 1), D(2003, 1, 1), [sum_("quantity", MONEY, "sum_quantity"), max_("price", MONEY, "max_price")])
_grouping("tg_head", *_B, D(1990, 1, 1), D(1995, 2, 1), [sum_("quantity", MONEY, "sum_quantity"), max_("price", MONEY, "max_price")])
_grouping("tg_gaps", *_B, D(1995, 1, 1), D(2001, 12, 31), [sum_("quantity", MONEY, "sum_quantity"), min_("price", MONEY, "min_price"), count_("price", "n")], where="quantity = 1 AND discount = 0.05", gaps=True)
_grouping("tg_no_gaps", *_B, D(1995, 1, 1), D(2001, 12, 31), [sum_("quantity", MONEY, "sum_quantity"), min_("price", MONEY, "min_price")], where="quantity = 1 AND discount = 0.05")
_grouping("tg_windows", *_B, D(1995, 1, 1), D(2001, 12, 31), _SUM_QUANTITY, windows=8)
_grouping("tg_nulls", *_B, _MID, _MID + dt.timedelta(90), [sum_("CASE WHEN line_number <> 3 THEN quantity END", MONEY, "sum_quantity"), max_("CASE WHEN line_number <> 3 THEN price END", MONEY, "max_price"), count_("CASE WHEN line_number <> 3 THEN price END", "n")], where="line_number IN (3, 5)")
_grouping("tg_ts_sum", *_V, TS(2024, 1, 3), TS(2024, 1, 20, 12, 30), [sum_("value", MONEY, "sum_value")])
_grouping("tg_ts_minmax", *_V, TS(2024, 1, 10), TS(2024, 1, 12), [min_("value", MONEY, "min_value"), max_("value", MONEY, "max_value")])
_grouping("tg_ts_c1", *_V, TS(2024, 1, 10), TS(2024, 1, 10, 16, 45, 36), [max_("value", MONEY, "a1"), max_("value * 2 - 1", "decimal(12,2)", "a2"), max_("valid_to", "timestamp_ntz", "a3"), min_("valid_from", "timestamp_ntz", "a4"), max_("user_id", "bigint", "a5"), sum_("user_id", "bigint", "a6")])
_grouping("tg_where_none", *_B, _MID, _MID + dt.timedelta(26), _SUM_QUANTITY, where="quantity < 0")
_grouping("tg_multi_period", *_SHIP, _MID, _MID + dt.timedelta(60), [sum_("price", MONEY, "sum_price"), max_("quantity", MONEY, "max_quantity")])
_grouping("tg_by", *_B, _MID, _MID + dt.timedelta(60), [sum_("quantity", MONEY, "sum_quantity"), max_("price", MONEY, "max_price"), count_("1", "n")], by="return_flag")
_grouping("tg_count", *_B, D(1995, 1, 1), D(2001, 12, 31), [count_("1", "n")], where="line_number = 1")
_grouping("tg_avg", *_B, _MID, _MID + dt.timedelta(26), [avg_("quantity", MONEY, "avg_quantity")])


def _tg_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = TemporalGrouping(bih(spark, sf_dir)).overlaps("active").agg(max_("price", MONEY, "max_price")).df()
    return plain(coalesced(found))


QUERIES["tg_coalesced"] = _tg_coalesced
ORACLES["tg_coalesced"] = f"""WITH q AS ({ORACLES["tg_minmax_whole"]}),
    m AS (SELECT *, CASE WHEN lag(period_end) OVER (ORDER BY period_start) = period_start AND lag(max_price) OVER (ORDER BY period_start) IS NOT DISTINCT FROM max_price THEN 0 ELSE 1 END AS new_ FROM q),
    g AS (SELECT *, sum(new_) OVER (ORDER BY period_start) AS run_ FROM m)
    SELECT min(period_start) AS period_start, max(period_end) AS period_end, max_price FROM g GROUP BY run_, max_price"""


def _scratch(spark: SparkSession) -> str:
    import uuid

    shared, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not shared and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared or tempfile.gettempdir()}/chronolith-{uuid.uuid4().hex}"


def _loaded_table(spark: SparkSession) -> tuple[Catalog, TemporalTable, str]:
    folder = _scratch(spark)
    builder = TableBuilder().create_table("loaded").add_column("order_key", "bigint").add_column("line_number", "int").add_column("price", MONEY).add_column("return_flag", "char(3)")
    table = builder.add_column("active_begin", "date").add_column("active_end", "date").period_for("active", "active_begin", "active_end").with_conf(compression="snappy").at(f"{folder}/table").build()
    catalog = Catalog()
    catalog.register(table)
    return catalog, table, folder


def load_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write two CSV files, one with a header, load both, and read the table."""
    catalog, table, folder = _loaded_table(spark)
    rows = bih_rows(spark, sf_dir).select("order_key", "line_number", F.when(F.col("line_number") != 3, F.col("price")).alias("price"), "return_flag", "active_begin", "active_end")
    writer = lambda k, header: rows.where(f"line_number % 2 = {k}").write.option("sep", "|").option("nullValue", "null").option("header", header).csv(f"{folder}/csv{k}")
    writer(0, "false")
    writer(1, "true")
    load = lambda k: Load(catalog).into_table("loaded").from_path(f"{folder}/csv{k}", "csv").with_properties(separator="|", has_header_line=("false", "true")[k]).with_parallelism(4)
    load(0).execute(spark)
    load(1).execute(spark)
    return plain(table.df(spark))


QUERIES["load_csv"] = load_csv
ORACLES["load_csv"] = plain_sql(f"WITH {BIH} SELECT order_key, line_number, CASE WHEN line_number <> 3 THEN price END AS price, return_flag, active_begin, active_end FROM bih", {"price": "decimal", "active_begin": "date", "active_end": "date"})


def load_then_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time travel over a loaded table, clustered by period start."""
    catalog, table, folder = _loaded_table(spark)
    bih_rows(spark, sf_dir).select(*table.schema.names).write.option("nullValue", "null").csv(f"{folder}/csv")
    Load(catalog).into_table("loaded").from_path(f"{folder}/csv", "csv").execute(spark)
    return TimeTravel("loaded", catalog).contains("active", D(1996, 2, 12)).where("return_flag = 'N'").agg(sum_("price", MONEY, "sum_price"), count_("1", "n")).df().transform(plain)


QUERIES["load_then_travel"] = load_then_travel
ORACLES["load_then_travel"] = plain_sql(travel_sql(BIH, "bih", "active_begin", "active_end", D(1996, 2, 12), items_sql([sum_("price", MONEY, "sum_price"), count_("1", "n")]), "return_flag = 'N'"), {"sum_price": "decimal"})

QUERIES["index_events"] = lambda spark, sf_dir: plain(event_counts(bih(spark, sf_dir), "active"))
QUERIES["index_build"] = lambda spark, sf_dir: plain(build_index(bih(spark, sf_dir), "active", "order_key", "line_number"))
ORACLES["index_build"] = plain_sql(f"WITH {BIH} SELECT active_begin AS version, 0 AS flag, order_key, line_number FROM bih UNION ALL SELECT active_end, 1, order_key, line_number FROM bih", {"version": "date"})

ORACLES["index_events"] = plain_sql(f"WITH {BIH} SELECT version, flag, count(*) AS rows FROM (SELECT active_begin AS version, 0 AS flag FROM bih UNION ALL SELECT active_end, 1 FROM bih) GROUP BY version, flag", {"version": "date"})


def broken(spark: SparkSession, sf_dir: str) -> TemporalTable:
    """Line items, of which some have a period without end, of no length, or that ends before it starts."""
    key = F.col("order_key") % 10
    end = F.when(key == 1, None).when(key == 2, F.col("active_begin")).when(key == 3, F.date_sub("active_begin", 5)).otherwise(F.col("active_end"))
    return TemporalTable.over("broken", bih_rows(spark, sf_dir).withColumn("active_end", end), active=("active_begin", "active_end"))


BROKEN = f"""{BIH}, broken AS (SELECT * REPLACE (CASE order_key % 10 WHEN 1 THEN NULL WHEN 2 THEN active_begin WHEN 3 THEN active_begin - 5 ELSE active_end END AS active_end) FROM bih)"""


def validate_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_report(broken(spark, sf_dir), "active")


QUERIES["validate_periods"] = validate_periods
ORACLES["validate_periods"] = f"""WITH {BROKEN}
    SELECT CASE WHEN active_begin IS NULL OR active_end IS NULL THEN 'null' WHEN active_begin < active_end THEN 'valid' ELSE 'inverted' END AS state, count(*) AS rows FROM broken GROUP BY 1"""

_BROKEN = (broken, ("active", "active_begin", "active_end"), (BROKEN, "(SELECT * FROM broken WHERE active_begin < active_end)"))
_grouping("tg_broken", *_BROKEN, None, None, [sum_("quantity", MONEY, "sum_quantity"), max_("price", MONEY, "max_price"), count_("1", "n")], where="line_number = 2", gaps=True)
_grouping("tg_broken_range", *_BROKEN, _MID, _MID + dt.timedelta(26), [sum_("quantity", MONEY, "sum_quantity"), min_("price", MONEY, "min_price")])

QUERIES["tbl_count"] = lambda spark, sf_dir: spark.createDataFrame([(bih(spark, sf_dir).count(),)], "n long")
ORACLES["tbl_count"] = "SELECT count(*) AS n FROM lineitem"


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", F.col("ts").alias("pickup"), F.expr("ts + make_dt_interval(0, 0, cast(event_id % 90 - 5 AS int), 0)").alias("dropoff"))
    return clean_trips(rows, "pickup", "dropoff", TS(2024, 1, 5), TS(2024, 1, 12))


QUERIES["clean_trips"] = trips
ORACLES["clean_trips"] = """SELECT * FROM (SELECT event_id, ts AS pickup, ts + to_minutes(event_id % 90 - 5) AS dropoff FROM events)
    WHERE pickup < TIMESTAMP '2024-01-12' AND dropoff > TIMESTAMP '2024-01-05' AND pickup < dropoff"""


def float_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of doubles do not drift: rounded, they equal the direct sums."""
    found = TemporalGrouping(validity(spark, sf_dir)).overlaps("valid", TS(2024, 1, 3), TS(2024, 1, 6)).agg(sum_("raw", "double", "sum_raw"), avg_("raw", "double", "avg_raw"), max_("raw", "double", "max_raw")).df()
    return found.withColumns({c: F.round(c, 6) for c in ("sum_raw", "avg_raw")})


QUERIES["tg_float_sum"] = float_sum
ORACLES["tg_float_sum"] = grouping_sql(VALIDITY, "ev", "valid_from", "valid_to", TS(2024, 1, 3), TS(2024, 1, 6), "round(sum(raw), 6) AS sum_raw, round(avg(raw), 6) AS avg_raw, max(raw) AS max_raw")
