"""Catalog, loads, cleaning, the command line and continuous loads."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith import Catalog, Load, TableBuilder, TimeTravel, cli, sum_
from chronolith.operators.timeline import build_index, event_counts
from chronolith.sources.clean import prepare
from chronolith.sources.csv_load import append, read_csv, typed
from chronolith.streaming.ingest import follow_csv


def builder(folder):
    out = TableBuilder().create_table("t").add_column("id", "bigint").add_column("ok", "boolean").add_column("name", "varchar(9)").add_column("x", "decimal(10,2)")
    return out.add_column("b", "timestamp_ntz").add_column("e", "timestamp_ntz").period_for("p", "b", "e").with_conf(compression="gzip").at(str(folder))


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_builder_errors():
    with pytest.raises(ValueError, match="first"):
        TableBuilder().add_column("x", "int")
    with pytest.raises(ValueError, match="compound"):
        TableBuilder().create_table("t").add_column("x", "array<int>")
    b = TableBuilder().create_table("t").add_column("x", "int").add_column("d", "date").add_column("s", "timestamp")
    for start, end, text in (("x", "d", "neither"), ("d", "y", "no column"), ("d", "s", "differ")):
        with pytest.raises(ValueError, match=text):
            b.period_for("p", start, end)
    with pytest.raises(ValueError, match="exists"):
        b.add_column("x", "int")
    with pytest.raises(ValueError):
        TableBuilder().build()
    with pytest.raises(ValueError, match="no table"):
        Catalog().table("t")


def test_table_properties(tmp_path):
    t = builder(tmp_path).build()
    assert t.is_temporal and t.column_count == 6 and "decimal(10,2)" in t.schema_string and t.schema["name"].dataType.simpleString() == "string"


def test_load(spark, tmp_path):
    catalog = Catalog()
    t = catalog.register(builder(tmp_path / "table").build())
    assert t.count(spark) == 0
    one = write(tmp_path / "one.csv", "1,T,null,1.50,2022-01-01 00:00:00,2022/01/02T00:00:00.5", '2,0,"a,b",null,2022-01-01 10:00:00,2022-01-03 00:00:00')
    two = write(tmp_path / "two.csv", "id|ok|name|x|b|e", "3|true|c|2|2022-01-05 00:00:00|2022-01-06 00:00:00")
    Load(catalog).into_table("t").from_path(one, "csv").execute(spark)
    Load(catalog).into_table("t").from_path(two).with_properties(separator="|", has_header_line="true").with_parallelism(2).execute(spark)
    rows = {r["id"]: r for r in t.df(spark).collect()}
    assert len(t.paths) == 2 and t.count(spark) == 3
    assert rows[1]["ok"] is True and rows[1]["name"] is None and rows[1]["e"] == dt.datetime(2022, 1, 2, 0, 0, 0, 500000)
    assert rows[2]["ok"] is False and rows[2]["name"] == "a,b" and rows[2]["x"] is None
    assert TimeTravel("t", catalog).contains("p", dt.datetime(2022, 1, 1, 12)).agg(sum_("x", "decimal(10,2)", "s")).df().first()["s"] == 1.5


@pytest.mark.parametrize("line", ["1,T,n,1,2022-01-02 00:00:00,2022-01-02 00:00:00", "1,T,n,1,null,2022-01-02 00:00:00", "x,T,n,1,2022-01-01 00:00:00,2022-01-02 00:00:00", "1,T,n,1,2022-01-01 00:00:00,soon"])
def test_bad_rows_fail(spark, tmp_path, line):
    catalog = Catalog()
    t = catalog.register(builder(tmp_path / "table").build())
    with pytest.raises(Exception, match=r"."):
        Load(catalog).into_table("t").from_path(write(tmp_path / "x.csv", line)).execute(spark)
    assert t.paths == []


def test_quarantine(spark, tmp_path):
    catalog = Catalog()
    t = catalog.register(builder(tmp_path / "table").build())
    path = write(tmp_path / "x.csv", "1,T,n,1,2022-01-02 00:00:00,2022-01-02 00:00:00", "2,T,n,1,2022-01-01 00:00:00,2022-01-02 00:00:00")
    Load(catalog).into_table("t").from_path(path).quarantine().execute(spark)
    assert [r["id"] for r in t.df(spark).collect()] == [2]
    assert [r["id"] for r in spark.read.parquet(f"{t.paths[0]}-rejected").collect()] == [1]


def test_load_errors(tmp_path):
    catalog = Catalog()
    catalog.register(TableBuilder().create_table("bare").add_column("x", "int").build())
    catalog.register(builder(tmp_path).build())
    with pytest.raises(ValueError, match="location"):
        Load(catalog).into_table("bare")
    with pytest.raises(ValueError, match="not supported"):
        Load(catalog).into_table("t").from_path("x", "json")
    with pytest.raises(ValueError, match="missing"):
        Load(catalog).execute(None)


def test_index(spark, tmp_path):
    catalog = Catalog()
    t = catalog.register(builder(tmp_path / "table").build())
    path = write(tmp_path / "x.csv", *(f"{k},T,n,1,2022-01-0{1 + k % 5} 00:00:00,2022-01-0{7 + k % 2} 00:00:00" for k in range(20)))
    Load(catalog).into_table("t").from_path(path).execute(spark)
    rows = build_index(t, "p", "id", partitions=3).collect()
    assert len(rows) == 40 and [r["version"] for r in rows] == sorted(r["version"] for r in rows)
    assert sum(r["rows"] for r in event_counts(t, "p").collect()) == 40


def test_follow_csv(spark, tmp_path):
    t = builder(tmp_path / "table").build()
    write(tmp_path / "in/a.csv", "1,T,n,1,2022-01-01 00:00:00,2022-01-02 00:00:00", "2,T,n,1,2022-01-03 00:00:00,2022-01-02 00:00:00")
    follow_csv(spark, t, str(tmp_path / "in"), str(tmp_path / "state")).awaitTermination()
    write(tmp_path / "in/b.csv", "3,T,n,1,2022-01-01 00:00:00,2022-01-02 00:00:00")
    follow_csv(spark, t, str(tmp_path / "in"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["id"] for r in t.df(spark).collect()) == [1, 3] and len(t.paths) == 2


def test_loads_outlive_the_table_object(spark, tmp_path):
    catalog = Catalog()
    catalog.register(builder(tmp_path / "table").build())
    line = "1,T,n,1,2022-01-01 00:00:00,2022-01-02 00:00:00"
    Load(catalog).into_table("t").from_path(write(tmp_path / "x.csv", line, line.replace("1,T", "2,T").replace("01-02", "01-01"))).quarantine().execute(spark)
    again = builder(tmp_path / "table").build()
    assert [r["id"] for r in again.df(spark).collect()] == [1] and again.paths == []


def test_replayed_batch_is_loaded_once(spark, tmp_path):
    t = builder(tmp_path / "table").build()
    rows = read_csv(spark, write(tmp_path / "x.csv", "1,T,n,1,2022-01-01 00:00:00,2022-01-02 00:00:00"), t.schema)
    for _ in range(2):
        append(spark, t, rows, quarantine=True, name="batch-7")
    assert t.count(spark) == 1 and len(t.paths) == 1


def test_follow_csv_fails_on_malformed_values(spark, tmp_path):
    t = builder(tmp_path / "table").build()
    write(tmp_path / "in/a.csv", "id|ok|name|x|b|e", "x|T|n|1|2022-01-01 00:00:00|2022-01-02 00:00:00")
    with pytest.raises(Exception, match=r"."):
        follow_csv(spark, t, str(tmp_path / "in"), str(tmp_path / "state"), separator="|", has_header_line="true").awaitTermination()
    assert t.count(spark) == 0


def test_timestamp_forms(spark):
    """Dates with hyphens, slashes or nothing between; offsets make instants, shown in the session's zone (UTC)."""
    forms = {
        "2022-01-01 00:00:00": "00:00:00", "2022/01/01T00:00:00": "00:00:00", "20220101T00:00:00": "00:00:00", "2022010100:00:00": "00:00:00", "2022-01-01T00:00:00+01:00": "-1", "2022-01-01 02:00:00 +02": "00:00:00",
        "2022-01-01T00:00:00Z": "00:00:00", "2022-01-01T00:00:00Z.5": "00:00:00.500000", "2022-01-01 00:00:00.25": "00:00:00.250000", " 2022-01-01T01:00:00.5+0100 ": "00:00:00.500000", "2022-01-01": "00:00:00",
    }
    for kind in (T.TimestampNTZType(), T.TimestampType()):
        d = spark.createDataFrame([(k,) for k in forms], "x string").select("x", typed(F.col("x"), kind).cast("timestamp_ntz").alias("t"))
        for r in d.collect():
            want = forms[r["x"]]
            assert r["t"] == (dt.datetime(2021, 12, 31, 23) if want == "-1" else dt.datetime.fromisoformat(f"2022-01-01 {want}")), (r, kind)
    with pytest.raises(Exception, match=r"."):
        spark.createDataFrame([("2022-01-01T00:00:00 soon",)], "x string").select(typed(F.col("x"), T.TimestampNTZType())).collect()


def test_prepare(spark, tmp_path):
    rows = [(1, dt.datetime(2022, 1, 1), dt.datetime(2022, 1, 2), None), (2, dt.datetime(2021, 1, 1), dt.datetime(2021, 1, 2), 1.0), (3, dt.datetime(2022, 5, 2), dt.datetime(2022, 5, 1), 1.0), (4, dt.datetime(2022, 12, 31, 23), dt.datetime(2023, 1, 1, 1), 2.0)]
    spark.createDataFrame(rows, "id int, a timestamp_ntz, b timestamp_ntz, x double").write.parquet(str(tmp_path / "in"))
    prepare(spark, str(tmp_path / "in"), str(tmp_path / "out"), "a", "b", 2022)
    lines = sorted(x for f in (tmp_path / "out").glob("*.csv") for x in f.read_text().splitlines())
    assert lines == ["1,2022-01-01 00:00:00,2022-01-02 00:00:00,null", "4,2022-12-31 23:00:00,2023-01-01 01:00:00,2.0"]


def test_cli(capsys):
    assert cli.main([]) == 0 and "prepare-data" in capsys.readouterr().out
    assert cli.main(["-p", "lineitembih"]) == 0 and "not supported" in capsys.readouterr().out
    assert cli.main(["-p", "other"]) == 1 and "unknown" in capsys.readouterr().err
    assert cli.main(["-p", "yttr2022"]) == 1
    with pytest.raises(SystemExit):
        cli.main(["--nonsense"])
