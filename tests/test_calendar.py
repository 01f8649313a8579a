import datetime as dt

import pytest
from pyspark.sql import functions as F

from platewise.functions.calendar import (business_days, date_label, last_full_week, previous_period,
                                          weather_mode)
from platewise.operators.features import add_calendar, dates_frame, require_working_days

D = dt.date


def _days(spark, start, n):
    return spark.range(1).select(business_days(start, n).alias("d")).first()["d"]


def test_seven_business_days_from_friday(spark):
    days = _days(spark, "2026-02-06", 7)
    assert len(days) == 7 and days[0] == D(2026, 2, 6) and days[-1] == D(2026, 2, 16)


def test_weekend_start_rolls_forward(spark):
    assert _days(spark, "2026-07-11", 2) == [D(2026, 7, 13), D(2026, 7, 14)]


def test_business_days_per_row(spark):
    starts = spark.createDataFrame([(D(2026, 2, 6), 3), (D(2026, 7, 11), 5)], "start_date date, n int")
    out = dates_frame(starts, "n").groupBy("start_date").count().orderBy("start_date").collect()
    assert [r["count"] for r in out] == [3, 5]


def test_weather_mode(spark):
    r = spark.range(1).select(weather_mode(F.lit(D(2026, 2, 6)), "2026-02-06").alias("same"),
                              weather_mode(F.lit(D(2026, 2, 5)), "2026-02-06").alias("before")).first()
    assert r["same"] == "forecast" and r["before"] == "past"


def test_calendar_features(spark):
    df = spark.createDataFrame([(D(2026, 2, 6),), (D(2026, 2, 9),)], "date date")
    rows = add_calendar(df).orderBy("date").collect()
    assert (rows[0]["weekday"], rows[0]["month"], rows[0]["day_theme"]) == ("Friday", "February", "Fish")
    assert (rows[1]["weekday"], rows[1]["day_theme"]) == ("Monday", "Sausage")


def test_weekend_guard(spark):
    df = spark.createDataFrame([(D(2026, 2, 6),), (D(2026, 2, 8),)], "date date")
    with pytest.raises(Exception, match="Mon"):
        require_working_days(df, strict=True).collect()
    assert require_working_days(df, strict=False).count() == 1


def test_periods(spark):
    r = spark.range(1).select(previous_period("2026-07-13", "2026-07-17").alias("p"),
                              last_full_week("2026-07-15").alias("w")).first()
    assert (r["p"]["prev_start"], r["p"]["prev_end"]) == (D(2026, 7, 8), D(2026, 7, 12))
    assert (r["w"]["start"], r["w"]["end"]) == (D(2026, 7, 6), D(2026, 7, 10))


def test_date_labels(spark):
    r = spark.range(1).select(date_label(F.lit(D(2026, 2, 6)), "long", "EN").alias("en"),
                              date_label(F.lit(D(2026, 2, 6)), "long", "DE").alias("de"),
                              date_label(F.lit(D(2026, 2, 6)), "chart", "DE").alias("chart")).first()
    assert r["en"] == "Friday, 06. February"
    assert r["de"] == "Freitag, 06. Februar"
    assert r["chart"] == "Fr. 06/02"


def test_parse_date(spark):
    from pyspark.errors import PySparkException
    from pyspark.sql.utils import AnalysisException  # noqa: F401

    from platewise.functions.calendar import parse_date
    df = spark.createDataFrame([("2026-02-06T10:00:00",), ("2026-02-06",), ("not-a-date",)], "s string")
    assert [r[0] for r in df.select(parse_date("s", strict=False)).collect()] == [D(2026, 2, 6), D(2026, 2, 6), None]
    with pytest.raises((PySparkException, Exception)):
        df.select(parse_date("s", strict=True)).collect()


def test_weather_left_join_keeps_rows(spark):
    from platewise.operators.features import join_weather
    df = spark.createDataFrame([(D(2026, 2, 6),), (D(2026, 2, 7),)], "date date")
    w = spark.createDataFrame([(D(2026, 2, 6), "sun", 10.0, "clear")],
                              "date date, weather_icon string, temperature_max double, weather_condition string")
    rows = {r["date"]: r for r in join_weather(df, w).collect()}
    assert len(rows) == 2 and rows[D(2026, 2, 7)]["weather_icon"] is None


def test_holiday_flags_from_ints_and_dedupe(spark):
    from platewise.operators.features import clean_holidays
    h = spark.createDataFrame([(D(2026, 6, 4), "x", 0, 0, 0), (D(2026, 6, 5), "y", 0, 0, 1),
                               (D(2026, 6, 5), "y", 0, 0, 1)],
                              "date date, description string, is_bank_holiday int, is_school_break int, is_bridge_day int")
    rows = sorted(clean_holidays(h).collect())
    assert [r["is_bridge_day"] for r in rows] == [False, True]  # one row per date after the dedupe
