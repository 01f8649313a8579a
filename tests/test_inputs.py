"""Inputs that the fixtures don't show: other date shapes, column orders,
repeated days, weekend rows, short histories."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from platewise import api
from platewise.functions.calendar import parse_date
from platewise.functions.formats import sign_class, to_flag
from platewise.operators import compare as C
from platewise.operators import ml as ML
from platewise.operators import rollup as R
from platewise.schemas import ACTUAL_SALES
from platewise.sinks.reports import rejected_dates, us_short_date
from platewise.sources import files as SRC
from platewise.streaming.ingest import ingest_paths, landing_layout, start_ingest
from platewise.sinks.tables import publish, read_table

DAY = dt.date(2026, 7, 13)


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", f(F.col("v"))).orderBy("i").collect()]


@pytest.mark.parametrize("text", [
    "2026-07-13", "2026-07-13T08:00:00.5", "2026-07-13T08:00:00Z", "2026-07-13 08:00", "07/13/2026", "7/13/26",
    "13 July 2026", "July 13, 2026", "Jul 13 2026", "13-Jul-26", "Mon, 13 Jul 2026 08:00:00 GMT", "13th July 2026", "20260713",
    "20260713T080000Z", "2026/7/13", "2026.07.13", "13.07.2026", "13/07/26", "07-13-2026", "07/13/2026 8:05 PM", "2026-Jul-13",
    " 2026-07-13 ", "2026-07-13T23:30:00-05:00", "2026-07-13T00:30:00+0200", "7/13/2026 08:00"])
def test_dates_of_other_shapes(spark, text):
    assert column(spark, [text], "string", lambda v: parse_date(v, strict=False)) == [DAY]
    assert column(spark, [text], "string", parse_date) == [DAY]


def test_months_and_years_alone_and_the_first_number_is_the_month(spark):
    texts = ["2026-07", "July 2026", "2026", "3/4/2026", "03.04.26", "1/2/69", "1/2/68"]
    assert column(spark, texts, "string", parse_date) == [
        dt.date(2026, 7, 1), dt.date(2026, 7, 1), dt.date(2026, 1, 1), dt.date(2026, 3, 4), dt.date(2026, 3, 4),
        dt.date(1969, 1, 2), dt.date(2068, 1, 2)]
    assert column(spark, [DAY], "date", parse_date) == [DAY]
    assert column(spark, [dt.datetime(2026, 7, 13, 23, 59)], "timestamp_ntz", parse_date) == [DAY]


@pytest.mark.parametrize("text", ["", "soon", "13/13/2026", "2026-02-30", "July 2, 26 later", "2026-7-", "13 Juli 2026", "1234567",
                                  "2026-07/13", "12:30"])
def test_strict_raises_exactly_where_lenient_is_null(spark, text):
    assert column(spark, [text, None], "string", lambda v: parse_date(v, strict=False)) == [None, None]
    with pytest.raises(Exception, match="no date"):
        column(spark, [text], "string", parse_date)


def test_what_is_no_date_is_null_and_listed(spark):
    bad = ["", "13.17.2026", "soon", "13/13/2026", None]
    assert column(spark, bad, "string", lambda v: parse_date(v, strict=False)) == [None] * 5
    df = spark.createDataFrame([("4/1/26",), ("04/01/26",), ("1.4.26",), (None,)], "date string")
    assert [r[0] for r in df.select(us_short_date("date")).collect()] == [dt.date(2026, 4, 1)] * 2 + [None] * 2
    assert [r["date"] for r in rejected_dates(df).collect()] == ["1.4.26"]


def test_flags_and_signs(spark):
    assert column(spark, [1.0, 2.0, 0.0, None, 0.5], "double", to_flag) == [True, True, False, False, True]
    assert column(spark, [2, 0, -1, None], "int", to_flag) == [True, False, True, False]
    assert column(spark, ["TRUE", "no", "1.0", "x", None], "string", to_flag) == [True, False, True, False, False]
    assert column(spark, [1, 0, None], "int", sign_class) == ["green", "red", "red"]


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_files_are_read_by_name(spark, tmp_dir):
    sales = write(f"{tmp_dir}/s/a.csv", "date;veg;non_veg;total_day;note\n4/1/26;20;30;50;x\n")
    write(f"{tmp_dir}/s/b.csv", '"total_day";"date";"non_veg";"veg"\n"7";"04/02/26";"4";"3"\n')
    got = sorted(tuple(r) for r in SRC.read_sales(spark, os.path.dirname(sales)).collect())
    assert got == [(dt.date(2026, 4, 1), 50, 20, 30), (dt.date(2026, 4, 2), 7, 3, 4)]
    hol = write(f"{tmp_dir}/h.csv", "is_bridge_day,description,is_bank_holiday,date,is_school_break\n"
                                    'FALSE,"May, first",TRUE,2026-05-01,FALSE\n')
    r = SRC.read_holidays(spark, hol).first()
    assert (r["date"], r["description"], r["is_bank_holiday"], r["is_school_break"], r["is_bridge_day"]) == (
        dt.date(2026, 5, 1), "May, first", True, False, False)
    with pytest.raises(ValueError, match="no column veg"):
        SRC.read_sales(spark, write(f"{tmp_dir}/n.csv", "date;non_veg;total_day\n4/1/26;1;1\n"))


UPLOAD = '"Datum";"Gesamt";"Veg";"Non-Veg";"Salat"\n'


def actuals(spark, root):
    publish(spark.createDataFrame([], ACTUAL_SALES), root)
    return root


def test_the_last_row_of_a_day_wins(spark, tmp_dir):
    p = landing_layout(tmp_dir)
    actuals(spark, p["table"])
    one = write(f"{p['landing']}/one.csv", UPLOAD + "2026-06-01;10;4;6;1\n2026-06-01;5;2;3;1\n2026-06-02;9;4;5;1\n")
    two = write(f"{p['landing']}/two.csv", UPLOAD + "2026-06-02;3;1;2;1\n")
    os.utime(one, (1_000_000, 1_000_000))
    os.utime(two, (2_000_000, 2_000_000))
    assert ingest_paths(spark, [two, one], p["table"], p["quarantine"]) == (True, None)
    got = {r["date"].day: r["actual_meals"] for r in read_table(spark, p["table"]).collect()}
    assert got == {1: 5, 2: 3}


def test_every_bad_row_is_listed(spark, tmp_dir):
    p = landing_layout(tmp_dir)
    actuals(spark, p["table"])
    write(f"{p['landing']}/X.CSV", UPLOAD + "2026-06-01;10;4;5;1\n2026-06-02;9;4;5;1\n2026-06-03;1;1;1;1\n2026-06-04;7;7;7;0\n")
    q = start_ingest(spark, p["landing"], p["table"], p["quarantine"], p["checkpoint"])
    q.awaitTermination()
    bad = spark.read.parquet(p["quarantine"] + "_rows").collect()
    assert sorted((r["ordinal"], r["errors"]) for r in bad) == [(0, "sum"), (2, "sum"), (3, "sum")]
    assert read_table(spark, p["table"]).count() == 0


def test_a_batch_with_a_repeated_key_needs_an_order(spark, tmp_dir):
    store = api.Store(spark, tmp_dir)
    rows = spark.createDataFrame([(DAY, 10, 4, 6, 0.0, 1), (DAY, 5, 2, 3, 0.0, 2)],
                                 "date date, actual_meals long, actual_meals_veg long, actual_meals_non_veg long, "
                                 "actual_meals_salad double, n int")
    ok, message = api.save_actuals(store, rows)
    assert not ok and "order_col" in message
    assert api.save_actuals(store, rows, order_col="n") == (True, None)
    assert [r["actual_meals"] for r in store.actuals().collect()] == [5]


def test_seeding_keeps_the_key(spark, tmp_dir):
    path = write(f"{tmp_dir}/in/s.csv", "date;total_day;veg;non_veg\n4/1/26;50;20;30\n")
    store = api.Store(spark, f"{tmp_dir}/one")
    assert api.seed_actuals_from_file(store, path) == (True, None)
    assert not api.seed_actuals_from_file(store, path)[0] and store.actuals().count() == 1
    sites = api.Store(spark, f"{tmp_dir}/sites", keys=["site_id", "date"])
    assert not api.seed_actuals_from_file(sites, path)[0]
    assert api.seed_actuals_from_file(sites, path, site={"site_id": 3})[0]
    assert [r["site_id"] for r in sites.actuals().collect()] == [3]
    broken = write(f"{tmp_dir}/in/b.csv", "date;total_day;veg;non_veg\nsoon;50;20;30\n")
    assert not api.seed_actuals_from_file(api.Store(spark, f"{tmp_dir}/two"), broken)[0]


def test_weekend_rows_are_in_no_working_week(spark):
    p = spark.createDataFrame([(dt.date(2026, 7, 17), 10, "2026-07-01 00:00:00"), (dt.date(2026, 7, 18), 10, "2026-07-01 00:00:00")],
                              "date date, final_prediction long, prediction_timestamp string")
    p = p.select("date", "final_prediction", F.to_timestamp("prediction_timestamp").alias("prediction_timestamp"),
                 F.lit("Fish").alias("day_theme"), *[F.lit(0).cast("long").alias(f"predicted_meals_{x}") for x in ("veg", "non_veg")],
                 F.lit(0.0).alias("predicted_meals_salad"))
    a = spark.createDataFrame([(dt.date(2026, 7, 17), 10, 5, 5, 0.0), (dt.date(2026, 7, 18), 20, 5, 15, 0.0)], ACTUAL_SALES)
    out = C.period_over_period_all(p, a, unit="week").collect()
    assert [(r["period_start"], r["rows"], r["mae"]) for r in out] == [(DAY, 1, 0.0)]


def test_sites_with_a_short_history_stay(spark):
    rows = [(s, DAY - dt.timedelta(days=i), 10.0 * s, "train" if s < 3 and i > 2 else "test") for s in (1, 2, 3) for i in range(6)]
    f = spark.createDataFrame(rows, f"site_id int, date date, {ML.LABEL} double, split string")
    got = {r["site_id"]: (r["site_mean"], r["fallback"]) for r in ML.site_scale(f).collect()}
    assert got == {1: (10.0, False), 2: (20.0, False), 3: (15.0, True)}


def test_lines_of_an_unknown_site_stay(spark):
    lines = spark.createDataFrame([(1, DAY, True), (9, DAY, False)], "k int, d date, veg boolean")
    sites = spark.createDataFrame([(1, 7)], "k int, s int")
    out = R.daily_demand_by_site(lines, sites, "k", "k", "s", F.col("d"), F.col("veg")).collect()
    assert sorted((str(r["site_id"]), r["actual_meals"]) for r in out) == [("7", 1), ("None", 1)]
