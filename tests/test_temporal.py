"""Time travel and temporal aggregation against brute force."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from chronolith import TemporalGrouping, TemporalTable, TimeTravel, aggregate, avg_, coalesced, count_, max_, min_, sum_
from chronolith.operators.metrics import observed
from chronolith.plans import queries

DAY0 = dt.date(2020, 1, 1)
day = lambda k: None if k is None else DAY0 + dt.timedelta(k)
at = lambda k: dt.datetime(2020, 1, 1) + dt.timedelta(microseconds=k)


def table(spark, rows, kind="date"):
    """Rows (begin, end, value, key) with integer times."""
    to = day if kind == "date" else at
    data = [(to(b), to(e), v, None if v is None else float(v), k) for b, e, v, k in rows]
    df = spark.createDataFrame(data, f"b {kind}, e {kind}, v int, d double, k string").withColumn("m", F.col("v").cast("decimal(12,2)"))
    return TemporalTable.over("t", df, p=("b", "e"))


def brute(rows, low, high, gaps=False):
    """(start, end, sum, min, max, count) for every constant interval."""
    inside = [(b if low is None else max(b, low), e if high is None else min(e, high), v) for b, e, v, _ in rows if (low is None or e > low) and (high is None or b < high)]
    points = sorted({x for b, e, _ in inside for x in (b, e)})
    out = []
    for s, e in zip(points, points[1:], strict=False):
        valid = [v for b, c, v in inside if b <= s < c]
        known = [v for v in valid if v is not None]
        if valid or gaps:
            out.append((s, e, sum(known), min(known, default=None), max(known, default=None), len(known)))
    return out


AGGREGATES = [sum_("m", "decimal(12,2)", "s"), min_("v", "int", "lo"), max_("v", "int", "hi"), count_("v", "n")]


def grouped(t, low, high, kind="date", gaps=False, windows=0, by=()):
    to = (lambda x: None if x is None else (day if kind == "date" else at)(x))
    back = (lambda x: (x - DAY0).days) if kind == "date" else (lambda x: round((x - dt.datetime(2020, 1, 1)) / dt.timedelta(microseconds=1)))
    df = TemporalGrouping(t).overlaps("p", to(low), to(high)).agg(*AGGREGATES).include_gaps(gaps).windows(windows).by(*by).df()
    return sorted((*(r[c] for c in by), back(r["period_start"]), back(r["period_end"]), int(r["s"]), r["lo"], r["hi"], r["n"]) for r in df.collect())


FIXTURES = [
    ([(1, 5, 10), (3, 5, 1), (2, 9, 100), (4, 12, 1000)], 0, 20),
    ([(1, 19, 7), (18, 25, 1)], 0, 20),
    ([(1, 2, 5), (4, 6, 7)], 0, 20),
    ([(1, 5, 1), (5, 9, 2), (9, 12, 3)], 5, 9),
    ([(0, 3, 1), (0, 3, 2), (0, 4, 3), (2, 4, 4)], -5, 3),
    ([(0, 3, None), (1, 5, None), (2, 4, 4)], 0, 10),
    ([(0, 3, 1)], 1, 2),
    ([(0, 3, 1)], 10, 20),
]


@pytest.mark.parametrize(("rows", "low", "high"), FIXTURES)
def test_fixtures(spark, rows, low, high):
    rows = [(*r, "a") for r in rows]
    for gaps in (False, True):
        assert grouped(table(spark, rows), low, high, gaps=gaps) == brute(rows, low, high, gaps)


def test_staggered_ends(spark):
    rows = [(1, 5, 10, "a"), (3, 5, 1, "a"), (2, 9, 100, "b"), (4, 12, 1000, "b")]
    assert [(s, v) for s, _, v, *_ in grouped(table(spark, rows), 0, 20)] == [(1, 10), (2, 110), (3, 111), (4, 1111), (5, 1100), (9, 1000)]


def random_rows(seed, n=60, span=100):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        b = rnd.randrange(-20, span)
        out.append((b, b + rnd.choice([1, 2, 5, 30, 90]), rnd.choice([None, *range(-5, 50)]), rnd.choice("xyz")))
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("kind", ["date", "timestamp_ntz"])
def test_random(spark, seed, kind):
    rows = random_rows(seed)
    t = table(spark, rows, kind)
    for low, high in ((0, 50), (None, None), (7, None)):
        want = brute(rows, low, high)
        for windows in (0, 1, 7):
            assert grouped(t, low, high, kind, windows=windows) == want


def test_by_keys(spark):
    rows = random_rows(3)
    rows = [(b, e, v, None if k == "z" else k) for b, e, v, k in rows]
    got = TemporalGrouping(table(spark, rows)).overlaps("p", day(0), day(80)).agg(*AGGREGATES).by("k").df().collect()
    for key in ("x", "y", None):
        mine = [r for r in rows if r[3] == key]
        assert sorted((((r["period_start"] - DAY0).days, (r["period_end"] - DAY0).days, int(r["s"]), r["lo"], r["hi"], r["n"]) for r in got if r["k"] == key)) == brute(mine, 0, 80)


def test_doubles_skip_nan_and_do_not_drift(spark):
    df = spark.createDataFrame([(day(0), day(9), 1e16), (day(1), day(2), 1.0), (day(3), day(5), math.nan), (day(4), day(6), None), (day(10), day(12), 0.1)], "b date, e date, d double")
    t = TemporalTable.over("t", df, p=("b", "e"))
    rows = TemporalGrouping(t).overlaps("p").agg(sum_("d", "double", "s"), min_("d", "double", "lo"), max_("d", "double", "hi"), avg_("d", "double", "m")).df().orderBy("period_start").collect()
    assert rows[-1]["s"] == 0.1 and rows[-1]["m"] == 0.1
    assert all(r["hi"] == 1e16 for r in rows[:-1])
    assert any(math.isnan(r["s"]) for r in rows) and rows[1]["lo"] == 1.0


def test_null_sum_is_zero(spark):
    t = table(spark, [(0, 3, None, "a")])
    r = TemporalGrouping(t).overlaps("p").agg(sum_("m", "decimal(12,2)", "s"), sum_("d", "double", "x"), min_("v", "int", "lo"), avg_("v", "int", "a")).df().first()
    assert (r["s"], r["x"], r["lo"], r["a"]) == (0, 0.0, None, None)


def test_coalesced(spark):
    t = table(spark, [(0, 4, 1, "a"), (2, 6, 1, "a"), (6, 8, 2, "a"), (9, 10, 2, "a")])
    out = coalesced(TemporalGrouping(t).overlaps("p").agg(max_("v", "int", "hi")).df())
    assert sorted(((r["period_start"] - DAY0).days, (r["period_end"] - DAY0).days, r["hi"]) for r in out.collect()) == [(0, 6, 1), (6, 8, 2), (9, 10, 2)]


def test_travel(spark):
    rows = random_rows(4)
    t = table(spark, rows)
    for k in (-21, 0, 13, 50, 500):
        valid = [v for b, e, v, _ in rows if b <= k < e]
        known = [v for v in valid if v is not None]
        r = TimeTravel(t).contains("p", day(k)).agg(*AGGREGATES).df().first()
        assert (int(r["s"]), r["lo"], r["hi"], r["n"]) == (sum(known), min(known, default=None), max(known, default=None), len(known))
        assert TimeTravel(t).contains("p", day(k)).where("v > 3").select("v + 1", "w", "bigint").df().count() == sum(v > 3 for v in known)


def test_errors(spark):
    t = table(spark, [(0, 1, 1, "a")])
    bare = TemporalTable.over("u", t.df())
    with pytest.raises(ValueError, match="no period"):
        TimeTravel(bare)
    with pytest.raises(ValueError, match="no period"):
        TemporalGrouping(bare)
    with pytest.raises(ValueError, match="no period q"):
        TimeTravel(t).contains("q", day(0))
    with pytest.raises(ValueError, match="date or a datetime"):
        TimeTravel(t).contains("p", "2020-01-01")
    with pytest.raises(ValueError, match="contains is missing"):
        TimeTravel(t).select("v").df()
    with pytest.raises(ValueError, match="selects nothing"):
        TimeTravel(t).contains("p", day(0)).df()
    with pytest.raises(ValueError, match="aggregates or none"):
        TimeTravel(t).contains("p", day(0)).select("v").agg(count_()).df()
    with pytest.raises(ValueError, match="overlaps is missing"):
        TemporalGrouping(t).agg(count_()).df()
    with pytest.raises(ValueError, match="empty"):
        TemporalGrouping(t).overlaps("p", day(3), day(3))
    with pytest.raises(ValueError, match="unknown aggregate"):
        aggregate("median", "v")
    with pytest.raises(ValueError, match="not numeric"):
        aggregate("SUM", "k", type="string")
    with pytest.raises(ValueError, match="not supported"):
        aggregate("max", "k", type="string")


def plan(df):
    return df._jdf.queryExecution().toString()


def test_plans(spark, sf, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    text = plan(queries.QUERIES["tt_sum"](spark, sf))
    spark.createDataFrame([(day(0), day(3), 1, "x")], "b date, e date, v int, other string").write.parquet(str(tmp_path / "t"))
    t = TemporalTable.over("t", spark.read.parquet(str(tmp_path / "t")), p=("b", "e"))
    for df in (TimeTravel(t).contains("p", day(1)).where("v < 4").agg(sum_("v", "int", "s")).df(), TemporalGrouping(t).overlaps("p", day(0), day(2)).where("v < 4").agg(sum_("v", "int", "s")).df()):
        scan = plan(df).split("== Physical Plan ==")[-1]
        assert "LessThan" in scan and "GreaterThan(e," in scan and "LessThan(v,4)" in scan
        assert "other" not in scan
    assert "NestedLoop" not in text
    for name in ("tg_b5", "tg_minmax_whole", "tg_ts_minmax", "tg_by"):
        text = plan(queries.QUERIES[name](spark, sf))
        assert "NestedLoop" not in text and "Cartesian" not in text, name


def test_all_queries_run(spark, sf):
    assert set(queries.ORACLES) == set(queries.QUERIES)
    for name in ("tg_where_none", "tt_empty_select"):
        assert queries.QUERIES[name](spark, sf).count() == 0


def test_observed(spark):
    m = observed(TimeTravel(table(spark, [(0, 3, 1, "a"), (1, 3, 2, "b")])).contains("p", day(2)).select("v").df())
    m.df.collect()
    assert m.get()["rows"] == 2 and m.get()["seconds"] > 0


def test_option_holds_while_planned(spark):
    q = TimeTravel(table(spark, [(0, 3, 1, "a")])).contains("p", day(2)).option("spark.sql.shuffle.partitions", "3").select("v")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert q.df().count() == 1 and q.run_options == {"spark.sql.shuffle.partitions": "3"}
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_one_scan_for_sums_two_with_extremes(spark, sf):
    """The changes by instant are exchanged once and reused."""
    for name, scans in (("tg_b5", 1), ("tg_a2", 2)):
        df = queries.QUERIES[name](spark, sf)
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert text.count("Scan parquet") == scans and "ReusedExchange" in text, name


BROKEN = [(1, 5, 1, "a"), (2, None, 10, "a"), (9, 3, 100, "a"), (None, 4, 1000, "a"), (3, 3, 10000, "a")]


@pytest.mark.parametrize(("low", "high"), [(None, None), (0, 20)])
def test_broken_periods_are_valid_at_no_instant(spark, low, high):
    for gaps in (False, True):
        q = TemporalGrouping(table(spark, BROKEN)).overlaps("p", None if low is None else day(low), None if high is None else day(high)).include_gaps(gaps)
        got = q.agg(sum_("v", "bigint", "s"), max_("v", "bigint", "m"), count_("1", "n")).df().collect()
        assert [tuple(r) for r in got] == [(day(1), day(5), 1, 1, 1)]
    assert TimeTravel(table(spark, BROKEN)).contains("p", day(3)).agg(sum_("v", "bigint", "s")).df().first()["s"] == 1


def test_coalesced_across_windows(spark):
    """As one pass over all intervals, whatever the number of windows; no task gets all of them."""
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(4)
    rows, at = [], 0
    for _ in range(120):
        at += rnd.choice([0, 0, 0, 2])
        end = at + rnd.randrange(1, 4)
        rows.append((rnd.choice("xy"), day(at), day(end), rnd.choice([1, 1, 1, None])))
        at = end
    want = []
    for key in "xy":
        for _, b, e, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            if want and want[-1][0] == key and want[-1][2] == b and want[-1][3] == v:
                want[-1] = (key, want[-1][1], e, v)
            else:
                want.append((key, b, e, v))
    d = spark.createDataFrame(rows, "k string, period_start date, period_end date, v int")
    assert sorted(map(tuple, coalesced(d, ["k"]).collect()), key=str) == sorted(want, key=str)
    one = d.where("k = 'x'").drop("k")
    found = coalesced(one)
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted((w[1:] for w in want if w[0] == "x"), key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") > 0 and coalesced(d.where(F.lit(False))).count() == 0


def test_options_hold_while_it_runs(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = lambda df: (df.count(), spark.conf.get("spark.sql.shuffle.partitions"))
    rows = table(spark, [(0, 3, 1, "a")])
    for q in (TimeTravel(rows).contains("p", day(2)).select("v"), TemporalGrouping(rows).overlaps("p").agg(sum_("v", "bigint", "s"))):
        assert q.option("spark.sql.shuffle.partitions", "3").run(seen) == (1, "3")
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
