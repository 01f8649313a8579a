import pytest
from pyspark.sql import functions as F

from platewise.functions.formats import pct_display, sign_class
from platewise.operators.compare import metrics


def _m(spark, rows, **kw):
    df = spark.createDataFrame(rows, "actual_meals long, final_prediction long")
    return metrics(df, **kw).first()


def test_basic_metrics(spark):
    r = _m(spark, [(100, 100), (103, 100), (130, 100)])
    assert r["mae"] == pytest.approx(11.0)
    assert (r["over_predicted"], r["under_predicted"]) == (0, 2)


def test_zero_forecast_counts_as_miss(spark):
    r = _m(spark, [(5, 0)])
    assert r["mae"] == 5 and r["accuracy_rate"] == 0.0


def test_tolerance_on_percent_scale(spark):
    # 3 % error with tolerance 0.05 is a miss: the tolerance is read in percent points
    assert _m(spark, [(103, 100)])["accuracy_rate"] == 0.0
    assert _m(spark, [(103, 100)], tolerance=0.05, tolerance_unit="fraction")["accuracy_rate"] == 100.0


def test_default_rows(spark):
    r = _m(spark, [(100, 100), (120, 100), (80, 100)])
    assert r["mae"] == pytest.approx(40 / 3)
    assert r["accuracy_rate"] == pytest.approx(100 / 3)


def test_sign_class(spark):
    df = spark.createDataFrame([(5,), (-5,), (0,)], "v int")
    assert [r[0] for r in df.select(sign_class("v")).collect()] == ["green", "red", "red"]


def test_percent_display_half_even(spark):
    df = spark.createDataFrame([(0.005,), (0.015,), (-0.025,)], "r double")
    assert [r[0] for r in df.select(pct_display("r")).collect()] == [0.0, 2.0, -2.0]
    assert df.select(F.round(F.lit(0.5), 0)).first()[0] == 1.0  # round is half-up; display uses bround


def test_period_over_period_empty_previous(spark):
    import datetime as dt

    from platewise.operators.compare import period_over_period, period_over_period_all
    D = dt.date
    p = spark.createDataFrame(
        [(D(2026, 7, 13), 100, None, "Sausage", 50, 50, 0.0), (D(2026, 7, 14), 110, None, "Vital", 50, 60, 0.0),
         (D(2026, 7, 8), 100, None, "Chicken", 50, 50, 0.0)],
        "date date, final_prediction long, prediction_timestamp timestamp_ntz, day_theme string, "
        "predicted_meals_veg long, predicted_meals_non_veg long, predicted_meals_salad double")
    a = spark.createDataFrame([(D(2026, 7, 13), 90, 45, 45, 0.0), (D(2026, 7, 14), 120, 60, 60, 0.0),
                               (D(2026, 7, 8), 100, 50, 50, 0.0)],
                              "date date, actual_meals long, actual_meals_veg long, actual_meals_non_veg long, "
                              "actual_meals_salad double")
    r = period_over_period(p, a, "2026-07-13", "2026-07-17").first()
    # previous span: 2026-07-08 .. 2026-07-12 holds one exact day
    assert (r["rows"], r["prev_rows"], r["mae"], r["mae_delta"]) == (2, 1, 10.0, 10.0)
    r2 = period_over_period(p.filter("date > '2026-07-10'"), a, "2026-07-13", "2026-07-17").first()
    assert r2["prev_rows"] == 0 and r2["mae_delta"] is None and r2["over_delta"] is None
    weeks = {x["period_start"]: x for x in period_over_period_all(p, a, unit="week").collect()}
    assert weeks[D(2026, 7, 13)]["prev_rows"] == 1 and weeks[D(2026, 7, 6)]["mae_delta"] is None


def test_latest_batch_and_info(spark):
    import datetime as dt

    from platewise.operators.compare import last_prediction_info, latest_batch, peak_day
    D, T = dt.date, dt.datetime
    p = spark.createDataFrame(
        [(D(2026, 7, 6), T(2026, 7, 1, 8), 60, 30, 30), (D(2026, 7, 7), T(2026, 7, 1, 8), 70, 30, 40),
         (D(2026, 7, 13), T(2026, 7, 8, 8), 70, 35, 35), (D(2026, 7, 14), T(2026, 7, 8, 8), 70, 30, 40),
         (D(2026, 7, 15), T(2026, 7, 8, 8), 65, 30, 35)],
        "date date, prediction_timestamp timestamp_ntz, final_prediction long, predicted_meals_veg long, "
        "predicted_meals_non_veg long")
    assert sorted(r["date"] for r in latest_batch(p).collect()) == [D(2026, 7, 13), D(2026, 7, 14), D(2026, 7, 15)]
    info = last_prediction_info(p).first()
    assert (info["timestamp"], info["start_date"], info["end_date"]) == (T(2026, 7, 8, 8), D(2026, 7, 13),
                                                                         D(2026, 7, 15))
    peak = peak_day(p).first()  # 70 on three days: the earliest wins
    assert (peak["date"], peak["final_prediction"]) == (D(2026, 7, 7), 70)
    empty = last_prediction_info(p.limit(0)).first()
    assert empty["timestamp"] is None
