import datetime as dt

import pytest
from pyspark.sql import functions as F

from platewise.constants import THEME_RATIOS, WEEKDAY_THEMES
from platewise.functions.split import split_total
from platewise.operators.split import apply_overrides, theme_ratios, with_final_prediction, with_theme_ratio

D = dt.date


def test_fixed_ratios_sum_to_one():
    for veg, non_veg in THEME_RATIOS.values():
        assert veg + non_veg == pytest.approx(1.0)
    assert set(WEEKDAY_THEMES.values()) == set(THEME_RATIOS)
    assert [THEME_RATIOS[t][0] for t in ["Sausage", "Vital", "Chicken", "Schnitzel", "Fish"]] == [
        0.50, 0.43, 0.43, 0.37, 0.50]


def test_split_double_ceil(spark):
    r = spark.range(1).select(split_total(F.lit(100), F.lit(0.07)).alias("s")).first()["s"]
    assert (r["veg"], r["non_veg"]) == (8, 92)


def test_override_wins(spark):
    df = spark.createDataFrame([(60, 45), (60, None)], "predicted_meals long, override_meal_prediction long")
    assert [r["final_prediction"] for r in with_final_prediction(df).collect()] == [45, 60]


def test_ratio_fallbacks(spark):
    hist = spark.createDataFrame([(D(2026, 7, 13), 30, 30, 60), (D(2026, 7, 14), 0, 0, 0)],
                                 "date date, actual_meals_veg long, actual_meals_non_veg long, actual_meals long")
    ratios = theme_ratios(hist)
    days = spark.createDataFrame([("Sausage",), ("Vital",), ("Fish",), (None,)], "day_theme string")
    got = {r["day_theme"]: r["veg_ratio"] for r in with_theme_ratio(days, ratios).collect()}
    # empirical for Monday, zero history on Tuesday falls back to the fixed ratio, unknown -> 0.5
    assert got == {"Sausage": 0.5, "Vital": 0.43, "Fish": 0.5, None: 0.5}


def test_apply_override_resplits(spark):
    hist = spark.createDataFrame([(D(2026, 7, 13), 30, 30)],
                                 "date date, actual_meals_veg long, actual_meals_non_veg long")
    fc = spark.createDataFrame([(D(2026, 7, 13), "Sausage", 60, 30, 30), (D(2026, 7, 14), "Vital", 70, 31, 39)],
                               "date date, day_theme string, predicted_meals long, predicted_meals_veg long, "
                               "predicted_meals_non_veg long")
    ov = spark.createDataFrame([(D(2026, 7, 13), 45, "event", 2.5)],
                               "date date, override_meal_prediction long, override_reason string, "
                               "predicted_meals_salad double")
    rows = {r["date"]: r for r in apply_overrides(fc, ov, theme_ratios(hist)).collect()}
    a, b = rows[D(2026, 7, 13)], rows[D(2026, 7, 14)]
    assert (a["final_prediction"], a["predicted_meals_veg"], a["predicted_meals_non_veg"]) == (45, 23, 22)
    assert a["predicted_meals_salad"] == 2.5 and a["override_reason"] == "event"
    assert (b["final_prediction"], b["override_meal_prediction"], b["predicted_meals_salad"]) == (70, None, 0.0)
