import datetime as dt

from pyspark.sql import functions as F

from platewise.operators.insights import bias_insights, health, plan_anomalies, series_long

D = dt.date
CMP = ("date date, month date, weekday string, actual_meals long, final_prediction long, actual_meals_veg long, "
       "predicted_meals_veg long, actual_meals_non_veg long, predicted_meals_non_veg long, "
       "actual_meals_salad double, predicted_meals_salad double")


def _cmp(spark):
    m = D(2026, 7, 1)
    rows = [(D(2026, 7, 6), m, "Monday", 110, 100, 50, 50, 60, 50, 1.0, 1.0),    # total +10 %, non-veg +20 %
            (D(2026, 7, 7), m, "Tuesday", 100, 100, 52, 50, 48, 50, 2.0, 2.0),   # veg +4 %, non-veg -4 %
            (D(2026, 7, 8), m, "Wednesday", 100, 100, 50, 50, 50, 50, 0.0, 0.0)]  # exact
    return spark.createDataFrame(rows, CMP)


def test_bias_insights_rules(spark):
    out = bias_insights(_cmp(spark), period="month", by=["weekday"], top=3).orderBy("rank").collect()
    assert len(out) == 3  # at most three per period, worst first
    assert (out[0]["weekday"], out[0]["category"], out[0]["type"]) == ("Monday", "non_veg", "error")
    assert (out[1]["weekday"], out[1]["category"], out[1]["type"]) == ("Monday", "total", "error")
    assert out[2]["type"] == "warning" and out[2]["weekday"] == "Tuesday"
    assert out[0]["message"] == "Monday non_veg: under-forecast by +20% over 1 days"


def test_series_long_shape(spark):
    s = series_long(_cmp(spark))
    assert s.count() == 3 * 12
    r = s.filter((F.col("date") == D(2026, 7, 6)) & (F.col("series") == "difference_total")).first()
    assert r["value"] == 10.0


FC = ("date date, day_theme string, final_prediction long, is_school_break boolean, is_bridge_day boolean, "
      "weather_condition string")


def test_plan_anomalies(spark):
    themes = ["Sausage", "Vital", "Chicken", "Schnitzel", "Fish"]
    hist = spark.createDataFrame(
        [(D(2026, 6, d), themes[D(2026, 6, d).weekday()], 100 + d % 4, False, False, "Sunny")
         for d in range(1, 29) if D(2026, 6, d).weekday() < 5], FC.replace("final_prediction", "actual_meals"))
    fc = spark.createDataFrame(
        [(D(2026, 7, 6), "Sausage", 250, False, False, "Sunny"),   # far above history
         (D(2026, 7, 7), "Vital", 101, True, False, "Sunny"),      # school break
         (D(2026, 7, 8), "Chicken", 101, False, False, "Rainy"),   # bad weather
         (D(2026, 7, 9), "Schnitzel", 101, False, False, "Sunny"),  # nothing special
         (D(2026, 7, 10), "Unknown", 101, False, False, "Snowy")],  # no history
        FC).withColumn("week_start", F.lit(D(2026, 7, 6)))
    out = {r["date"].day: r for r in plan_anomalies(fc, hist, top=9).collect()}
    assert set(out) == {6, 7, 8, 10} and out[6]["rank"] == 1 and out[10]["z"] is None
    assert out[6]["reasons"] == "more than such days had" and out[7]["reasons"] == "school break"
    assert {r["date"].day for r in plan_anomalies(fc, hist, top=2).collect()} < set(out)


def test_expectation_follows_the_conditions_and_shrinks_to_the_theme(spark):
    from platewise.operators.insights import SHRINKAGE, conditional_expectation
    rows = [("Fish", 100, False, False, "Sunny")] * 8 + [("Fish", 60, False, False, "Rainy")] * 4 + [
        ("Fish", 20, True, False, None)] + [("Fish", None, False, False, "Sunny"), (None, 9, False, False, "Sunny")]
    schema = "day_theme string, actual_meals long, is_school_break boolean, is_bridge_day boolean, weather_condition string"
    hist = spark.createDataFrame([(D(2026, 6, 1 + i), *r) for i, r in enumerate(rows)], "date date, " + schema)
    ask = spark.createDataFrame([("Fish", 1, False, None, "Sunny"), ("Fish", 2, False, False, "Rainy"), ("Fish", 3, True, False, None),
                                 ("Fish", 4, False, True, "Sunny"), ("Vital", 5, False, False, "Sunny")],
                                schema.replace("actual_meals", "k"))
    got = {r["k"]: r for r in conditional_expectation(hist, ask).collect()}
    mean = (800 + 240 + 20) / 13
    want = {1: (8, 100), 2: (4, 60), 3: (1, 20), 4: (0, 0)}
    for k, (n, m) in want.items():
        assert abs(got[k]["expected"] - (n * m + SHRINKAGE * mean) / (n + SHRINKAGE)) < 1e-9
    assert got[5]["expected"] is None and got[1]["spread"] == 0.0


def test_bias_patterns_rank_by_significance(spark):
    from platewise.operators.insights import bias_patterns
    rows, d = [], D(2026, 6, 1)
    while d.month == 6:
        if d.weekday() < 5:
            i = d.day
            rain = 30 if i == 12 else 0  # one large miss
            monday = 6 + i % 2 if d.weekday() == 0 else 0  # a steady one
            rows.append((d, D(2026, 6, 1), d.strftime("%A"), "t", "normal", 100 + i % 2 + monday + rain, 100, 50, 50, 50, 50, 0.0, 0.0))
        d += dt.timedelta(days=1)
    cmp_ = spark.createDataFrame(rows, CMP.replace("weekday string", "weekday string, day_theme string, day_kind string"))
    out = bias_patterns(cmp_, top=5).orderBy("rank").collect()
    assert (out[0]["pattern"], out[0]["value"], out[0]["category"]) == ("weekday", "Monday", "total")
    diffs = [r[5] - r[6] for r in rows if r[2] == "Monday"]
    n, m = len(diffs), sum(diffs) / len(diffs)
    sd = (sum((x - m) ** 2 for x in diffs) / (n - 1)) ** 0.5
    assert abs(out[0]["t"] - m / (sd / n ** 0.5)) < 1e-3 and out[0]["days"] == n and out[0]["type"] == "error"
    assert all(abs(r["t"]) >= 2 for r in out) and "Friday" not in {r["value"] for r in out}  # one day's miss is no pattern


def test_health(spark):
    a = spark.createDataFrame([(D(2026, 7, 6),), (D(2026, 7, 10),)], "date date")
    r = health({"actual_sales": a}, "2026-07-13").first()
    assert (r["rows"], r["last_date"], r["days_since_last"]) == (2, D(2026, 7, 10), 3)
