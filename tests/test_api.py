import datetime as dt

from platewise import api
from platewise.schemas import ACTUAL_SALES

D = dt.date


def test_workflow_round_trip(spark, tmp_dir):
    store = api.Store(spark, tmp_dir)
    fc = spark.createDataFrame(
        [(D(2026, 7, 13), "Monday", "July", "Sausage", 22.5, "Sunny", False, False, "", 60, 30, 30, 0.0,
          dt.datetime(2026, 7, 6, 8), 45, "event"),
         (D(2026, 7, 14), "Tuesday", "July", "Vital", 19.0, "Rainy", False, False, "", 70, 31, 39, 0.0,
          dt.datetime(2026, 7, 6, 8), None, None)],
        "date date, weekday string, month string, day_theme string, temperature_max double, "
        "weather_condition string, is_bridge_day boolean, is_school_break boolean, holiday_desc string, "
        "predicted_meals long, predicted_meals_veg long, predicted_meals_non_veg long, "
        "predicted_meals_salad double, prediction_timestamp timestamp_ntz, override_meal_prediction long, "
        "override_reason string")
    assert api.save_prediction(store, fc) == (True, None)
    preds = {r["date"]: r["final_prediction"] for r in store.predictions().collect()}
    assert preds == {D(2026, 7, 13): 45, D(2026, 7, 14): 70}

    assert [r["date"] for r in api.get_missing_actuals(store).collect()] == [D(2026, 7, 13), D(2026, 7, 14)]
    act = spark.createDataFrame([(D(2026, 7, 13), 50, 25, 25, 1.5)], ACTUAL_SALES)
    assert api.save_actuals(store, act)[0]
    assert [r["date"] for r in api.get_missing_actuals(store).collect()] == [D(2026, 7, 14)]

    cmp = api.get_actuals_and_predictions(store, "2026-07-13", "2026-07-17")
    m = api.calculate_metrics(cmp).first()
    assert (m["mae"], m["under_predicted"]) == (5.0, 1)
    assert [r["date"] for r in api.get_future_predictions(store, "2026-07-15").collect()] == [
        D(2026, 7, 13), D(2026, 7, 14)]
    ratios = {r["day_theme"]: r["veg_ratio"] for r in api.get_empirical_veg_ratio(store).collect()}
    assert ratios["Sausage"] == 0.5 and ratios["Vital"] == 0.43
    info = api.get_last_prediction_info(store).first()
    assert (info["start_date"], info["end_date"]) == (D(2026, 7, 13), D(2026, 7, 14))
    period = api.compare_periods(store, "2026-07-13", "2026-07-17").first()
    assert (period["rows"], period["mae"], period["prev_rows"], period["mae_delta"]) == (1, 5.0, 0, None)


def test_csv_validation(spark):
    ok_df = spark.createDataFrame([("2026-07-13", "10", "4", "6", "1")], "Datum string, Gesamt string, "
                                  "veg string, `non-veg` string, salat string")
    ok, msg, rows = api.csv_validation(ok_df)
    assert ok and msg is None and rows.first()["actual_meals"] == 10
    bad = spark.createDataFrame([("2026-07-13", "10", "4", "5", "1")], "date string, total string, veg string, "
                                "`non-veg` string, salad string")
    ok, msg, rows = api.csv_validation(bad)
    assert not ok and "row 0" in msg
    assert [(r["ordinal"], r["errors"]) for r in rows.collect()] == [(0, "sum")]  # all offending rows
    missing = spark.createDataFrame([("2026-07-13", "10")], "date string, total string")
    ok, msg, _ = api.csv_validation(missing)
    assert not ok and "missing columns" in msg


def test_seed_scripts(spark, tmp_dir):
    import os
    store = api.Store(spark, os.path.join(tmp_dir, "store"))
    sales = os.path.join(tmp_dir, "sales.csv")
    with open(sales, "w") as f:
        f.write("date;total_day;veg;non_veg\n04/01/26;60;30;30\n04/02/26;50;20;30\n")
    hol = os.path.join(tmp_dir, "hol.csv")
    with open(hol, "w") as f:
        f.write("date,description,is_bank_holiday,is_school_break,is_bridge_day\n2026-04-03,Good Friday,TRUE,TRUE,FALSE\n")
    assert api.seed_actuals_from_file(store, sales) == (True, None)
    assert api.seed_holidays_from_file(store, hol) == (True, None)
    assert sorted(r["actual_meals"] for r in store.actuals().collect()) == [50, 60]
    assert api.get_holidays(store, "2026-04-01", "2026-04-30").first()["description"] == "Good Friday"
    assert api.delete_all_actuals(store)[0] and store.actuals().count() == 0


def test_prepare_and_score(spark, tmp_dir):
    import os


    from platewise.operators import ml as ML
    store = api.Store(spark, os.path.join(tmp_dir, "s2"))
    # history: 60 working days with a weekday pattern
    rows, d = [], D(2026, 3, 2)
    while len(rows) < 60:
        if d.weekday() < 5:
            rows.append((d, 50 + 10 * d.weekday(), 25, 25 + 10 * d.weekday(), 0.0))
        d += dt.timedelta(days=1)
    assert api.save_actuals(store, spark.createDataFrame(rows, ACTUAL_SALES))[0]
    weather = spark.createDataFrame([(D(2026, 3, 2) + dt.timedelta(days=i), 15.0, "Sunny", "x") for i in range(120)],
                                    "date date, temperature_max double, weather_condition string, weather_icon string")
    hol = spark.createDataFrame([(D(2026, 5, 1), "Labour Day", True, False, False)],
                                "date date, description string, is_bank_holiday boolean, is_school_break boolean, "
                                "is_bridge_day boolean")
    frame = ML.training_frame(store.actuals(), weather, hol)
    cats = ML.categories(frame)
    feats = ML.feature_columns(cats)
    model = ML.fit_forest(ML.one_hot(frame, cats), feats, numTrees=10)
    prep = api.prepare_data(spark, "2026-04-30", 3, weather, hol)  # Thu, (Fri bank holiday), Mon
    assert [r["date"] for r in prep.orderBy("date").collect()] == [D(2026, 4, 30), D(2026, 5, 4)]
    scored = api.get_prediction(store, model, feats, prep, dt.datetime(2026, 4, 29, 8)).orderBy("date").collect()
    assert all(r["predicted_meals_veg"] + r["predicted_meals_non_veg"] == r["predicted_meals"] for r in scored)
    assert scored[0]["prediction_timestamp"] == dt.datetime(2026, 4, 29, 8)


def test_site_keyed_store(spark, tmp_dir):
    import os
    store = api.Store(spark, os.path.join(tmp_dir, "s3"), keys=["site_id", "date"])
    rows = spark.createDataFrame([(1, D(2026, 7, 13), 10, 4, 6, 0.0), (2, D(2026, 7, 13), 20, 8, 12, 0.0)],
                                 "site_id int, date date, actual_meals long, actual_meals_veg long, "
                                 "actual_meals_non_veg long, actual_meals_salad double")
    assert api.save_actuals(store, rows)[0]
    fix = spark.createDataFrame([(2, D(2026, 7, 13), 21, 9, 12, 0.0)], rows.schema)
    assert api.save_actuals(store, fix)[0]
    got = {(r["site_id"], r["actual_meals"]) for r in store.actuals().collect()}
    assert got == {(1, 10), (2, 21)}
    ratios = api.get_empirical_veg_ratio(store).collect()
    assert {r["site_id"] for r in ratios} == {1, 2}
