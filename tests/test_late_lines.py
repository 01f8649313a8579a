"""The maintained rollup: lines that arrive late, however late."""

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from platewise.operators import rollup as R
from platewise.sinks.tables import read_table

D, TS = dt.date, dt.datetime
S = "ordered_at timestamp_ntz, arrived_at timestamp_ntz, is_veg boolean"


def daily(lines):
    return R.daily_demand(lines, F.col("ordered_at").cast("date"), F.col("is_veg"))


def line(day, late, veg=True):
    at = TS(2026, 1, 5, 12) + dt.timedelta(days=day)
    return at, at + dt.timedelta(days=late), veg


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def write(spark, path, rows, schema=S):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def test_a_line_200_days_late_is_counted(spark, tmp_dir):
    path, root = os.path.join(tmp_dir, "lines"), os.path.join(tmp_dir, "daily")
    first = [line(d, 1, d % 2 == 0) for d in range(0, 240) for _ in range(2)]
    lines = write(spark, path, first)
    done = R.refresh_daily(root, lines, "ordered_at", "arrived_at", daily)
    assert done["lines"] == 480 and rows_of(read_table(spark, root)) == rows_of(daily(lines))
    late = TS(2026, 1, 5, 12)
    lines = write(spark, path, [line(45, 200), line(45, 200, False), line(240, 1)])
    done = R.refresh_daily(root, lines, "ordered_at", "arrived_at", daily)
    assert done == {"days": [(late + dt.timedelta(days=d)).date() for d in (45, 240)], "lines": 3}
    assert rows_of(read_table(spark, root)) == rows_of(daily(lines))
    day = read_table(spark, root).filter(F.col("date") == (late + dt.timedelta(days=45)).date()).first()
    assert (day["actual_meals"], day["actual_meals_veg"]) == (4, 1)
    assert R.refresh_daily(root, lines, "ordered_at", "arrived_at", daily) == {"days": [], "lines": 0}


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_any_kind_of_time_and_lines_without(spark, tmp_dir, kind):
    path, root = os.path.join(tmp_dir, "lines"), os.path.join(tmp_dir, "daily")
    schema = f"ordered_at {kind}, arrived_at {kind}, is_veg boolean"
    as_kind = (lambda t: t.date()) if kind == "date" else (lambda t: t)
    rows = [(as_kind(a), as_kind(b), v) for a, b, v in [line(1, 1), line(1, 2), line(2, 30)]] + [(None, None, True)]
    lines = write(spark, path, rows, schema)
    R.refresh_daily(root, lines.filter(F.col("arrived_at") < F.lit(D(2026, 1, 20))), "ordered_at", "arrived_at", daily)
    assert read_table(spark, root).count() == 1
    done = R.refresh_daily(root, lines, "ordered_at", "arrived_at", daily)
    assert done["days"] == [D(2026, 1, 7)] and {r["actual_meals"] for r in read_table(spark, root).collect()} == {1, 2}


def test_only_the_touched_days_are_read(spark, tmp_dir):
    lines = write(spark, os.path.join(tmp_dir, "lines"), [line(d, 1) for d in range(300)])
    days = [D(2026, 1, 10), D(2026, 1, 11), D(2026, 6, 1)]
    read = R.lines_of_days(lines, "ordered_at", days)
    assert {r["ordered_at"].date() for r in read.collect()} == set(days)
    plan = read._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan, re.S)[1]
    assert "Or" in pushed and pushed.count("GreaterThanOrEqual(ordered_at") == 2 and "2026-06-01" in pushed
    since = R.touched_days(lines, "ordered_at", "arrived_at", F.lit("2026-05-01").cast("timestamp_ntz"))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    assert "GreaterThan(arrived_at" in since._jdf.queryExecution().explainString(mode)


def test_ranges_hold_all_days_and_join_the_nearest():
    days = [D(2026, 1, 1), D(2026, 1, 2), D(2026, 1, 9), D(2026, 3, 1), D(2026, 3, 3), D(2026, 3, 1)]
    assert R.day_ranges(days) == [(days[0], days[1]), (days[2], days[2]), (days[3], days[3]), (days[4], days[4])]
    assert R.day_ranges(days, 2) == [(days[0], days[2]), (days[3], days[4])]
    assert R.day_ranges(days, 1) == [(days[0], days[4])] and R.day_ranges([]) == []
