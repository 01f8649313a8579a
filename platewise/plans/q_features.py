"""Queries: calendar, weather and holiday features (GEN-1, PRJ-1, PRJ-2,
FN-1, FN-2, SRC-5, JON-1, JON-2, FLT-3, FLT-4, FLT-6, PRJ-8, ML-7)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from platewise import fixtures as fx
from platewise.fixtures_sql import theme_case
from platewise.functions.calendar import business_days, parse_date, weather_mode
from platewise.operators import features as FE
from platewise.plans.catalog import register
from platewise.sources import files as SRC

AS_OF = dt.date(2000, 1, 1)


def forecast_requests(spark, sf):
    """One forecast request per order date; the number of days cycles through
    the app's choices 3 / 5 / 7 by month."""
    days = fx.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("start_date"))
    return days.distinct().withColumn("n_days", (F.lit(3) + F.lit(2) * (F.month("start_date") % 3)).cast("int"))


_REQ_SQL = """
req AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS start_date,
               CAST(3 + 2 * (month(o_orderdate) % 3) AS INTEGER) AS n_days
        FROM orders),
bd AS (SELECT start_date, n_days, date,
              CAST(row_number() OVER (PARTITION BY start_date ORDER BY date) AS INTEGER) AS day_index
       FROM (SELECT start_date, n_days, start_date + CAST(i AS INTEGER) AS date
             FROM req, range(0, 19) t(i)) c
       WHERE isodow(date) <= 5)"""


@register("gen_business_days", f"""
, {_REQ_SQL.strip()}
SELECT start_date, n_days, date, day_index FROM bd WHERE day_index <= n_days""")
def gen_business_days(spark, sf):
    """GEN-1 / WIN-3: n business days per request, weekend starts roll forward."""
    r = forecast_requests(spark, sf)
    return r.select("start_date", "n_days",
                    F.posexplode(business_days(F.col("start_date"), F.col("n_days"))).alias("pos", "date")) \
            .select("start_date", "n_days", "date", (F.col("pos") + 1).cast("int").alias("day_index"))


@register("fn_weather_mode", f"""
, {_REQ_SQL.strip()}
SELECT start_date, min(date) AS first_day, max(date) AS last_day,
       CASE WHEN max(date) < DATE '{AS_OF}' THEN 'past' ELSE 'forecast' END AS weather_mode
FROM bd WHERE day_index <= n_days GROUP BY start_date""")
def fn_weather_mode(spark, sf):
    """FN-1: archive or forecast weather per request, relative to ``as_of``."""
    b = gen_business_days(spark, sf)
    g = b.groupBy("start_date").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    return g.withColumn("weather_mode", weather_mode("last_day", AS_OF))


@register("prj_calendar", f"""
SELECT DISTINCT CAST(l_shipdate AS DATE) AS date, dayname(l_shipdate) AS weekday,
       monthname(l_shipdate) AS month, {theme_case("CAST(l_shipdate AS DATE)")} AS day_theme
FROM lineitem""")
def prj_calendar(spark, sf):
    """PRJ-2 / FN-6: weekday, month, theme for every ship date (weekends: no theme)."""
    d = fx.table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")).distinct()
    return FE.add_calendar(d)


@register("fn_weather_category", "SELECT date, weather_code, weather_icon, weather_condition FROM weather")
def fn_weather_category(spark, sf):
    """FN-2: weather code -> (icon, condition) for every day."""
    return fx.build_weather(spark, sf).select("date", "weather_code", "weather_icon", "weather_condition")


def landed_weather_json(spark, sf):
    """Weather as landed API documents: one JSON response per month with
    parallel arrays under ``daily``; February responses are API errors
    (``reason`` only). Each group is one month of days: bounded."""
    w = fx.weather(spark, sf)
    per_month = (w.groupBy(F.date_trunc("month", "date").cast("date").alias("month"))
                  .agg(F.array_sort(F.collect_list(F.struct(
                      F.col("date"), F.col("temperature_max"), F.col("weather_code")))).alias("days")))
    daily = F.struct(
        F.transform("days", lambda x: F.date_format(x["date"], "yyyy-MM-dd")).alias("time"),
        F.transform("days", lambda x: x["temperature_max"]).alias("temperature_2m_max"),
        F.transform("days", lambda x: x["weather_code"]).alias("weather_code"))
    good = F.struct(F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"), daily.alias("daily"))
    bad = F.struct(F.lit("No data is available for this location").alias("reason"))
    doc = F.when(F.month("month") == 2, F.to_json(bad)).otherwise(F.to_json(good))
    return per_month.select("month", doc.alias("json"))


@register("src_weather_json", """
SELECT CAST(date AS VARCHAR) AS time, temperature_max AS temperature_2m_max, weather_code,
       weather_icon, weather_condition, date, temperature_max
FROM weather WHERE month(date) <> 2""")
def src_weather_json(spark, sf):
    """SRC-5: landed JSON response files (one document per line) read with
    the fixed schema -> daily rows; error responses dropped (kept apart by
    ``weather_quarantine``)."""
    from platewise.session import scratch_dir
    path = scratch_dir(spark, "weather")
    landed_weather_json(spark, sf).select(F.col("json").alias("value")).write.text(path)
    return SRC.weather_rows(SRC.read_weather_responses(spark, path))


@register("src_weather_quarantine", """
SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS month,
       'No data is available for this location' AS reason
FROM weather WHERE month(date) = 2""")
def src_weather_quarantine(spark, sf):
    """SRC-5 / Q4: responses without ``daily`` kept apart with their reason."""
    docs = SRC.parse_weather_json(landed_weather_json(spark, sf))
    return SRC.weather_quarantine(docs).select("month", "reason")


_GAPS_SQL = """
, gaps AS (SELECT date, weather_icon, temperature_max, CASE WHEN day(date) <> 14 THEN weather_condition END AS weather_condition
           FROM weather WHERE day(date) <> 13)"""


def weather_with_gaps(spark, sf):
    """The weather without every 13th, and without the 14th's condition."""
    w = fx.weather(spark, sf).filter(F.dayofmonth("date") != 13)
    return w.withColumn("weather_condition", F.when(F.dayofmonth("date") != 14, F.col("weather_condition")))


@register("jon_weather", _GAPS_SQL + """
SELECT a.date, a.actual_meals, w.weather_icon, w.temperature_max, w.weather_condition
FROM actual_sales a LEFT JOIN gaps w ON a.date = w.date""")
def jon_weather(spark, sf):
    """JON-1: every working day with its weather; days without weather keep nulls."""
    a = fx.actual_sales(spark, sf).select("date", "actual_meals")
    return FE.join_weather(a, weather_with_gaps(spark, sf))


@register("jon_holidays", """
SELECT a.date, a.actual_meals, h.description AS holiday_desc, h.is_bank_holiday,
       h.is_school_break, h.is_bridge_day
FROM actual_sales a LEFT JOIN holidays h ON a.date = h.date""")
def jon_holidays(spark, sf):
    """JON-2: every working day with its holiday row (nulls when none)."""
    a = fx.actual_sales(spark, sf).select("date", "actual_meals")
    return FE.join_holidays(a, fx.holidays(spark, sf))


@register("flt_weekdays", """
SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders
WHERE isodow(CAST(o_orderdate AS DATE)) <= 5""")
def flt_weekdays(spark, sf):
    """FLT-3 (lenient mode): drop weekend dates."""
    d = fx.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return FE.require_working_days(d, strict=False)


@register("flt_no_bank_holiday", """
SELECT a.date, a.actual_meals FROM actual_sales a LEFT JOIN holidays h ON a.date = h.date
WHERE h.is_bank_holiday IS NULL OR NOT h.is_bank_holiday""")
def flt_no_bank_holiday(spark, sf):
    """FLT-4: working days that are not bank holidays."""
    a = fx.actual_sales(spark, sf).select("date", "actual_meals")
    j = FE.join_holidays(a, fx.holidays(spark, sf))
    return FE.exclude_bank_holidays(j).select("date", "actual_meals")


@register("prj_flags", """
SELECT a.date, COALESCE(h.description, '') AS holiday_desc,
       COALESCE(h.is_school_break, false) AS is_school_break,
       COALESCE(h.is_bridge_day, false) AS is_bridge_day,
       COALESCE(h.is_bank_holiday, false) AS is_bank_holiday
FROM actual_sales a LEFT JOIN holidays h ON a.date = h.date""")
def prj_flags(spark, sf):
    """PRJ-8: flags to boolean (null -> false), description null -> ''."""
    a = fx.actual_sales(spark, sf).select("date")
    j = FE.join_holidays(a, fx.holidays(spark, sf))
    return FE.fill_day_flags(j, flags=("is_school_break", "is_bridge_day", "is_bank_holiday"))


@register("flt_missing_weather", _GAPS_SQL + """
SELECT a.date FROM actual_sales a LEFT JOIN gaps w ON a.date = w.date
WHERE w.temperature_max IS NULL OR w.weather_condition IS NULL""")
def flt_missing_weather(spark, sf):
    """FLT-6: training days lacking weather, reported (lenient mode)."""
    a = fx.actual_sales(spark, sf).select("date")
    return FE.missing_weather(FE.join_weather(a, weather_with_gaps(spark, sf))).select("date")


@register("flow_prepare", f"""
, {_REQ_SQL.strip()}
SELECT b.start_date, b.date, dayname(b.date) AS weekday, monthname(b.date) AS month,
       {theme_case("b.date")} AS day_theme,
       w.weather_icon, w.temperature_max, w.weather_condition,
       COALESCE(h.description, '') AS holiday_desc,
       COALESCE(h.is_school_break, false) AS is_school_break,
       COALESCE(h.is_bridge_day, false) AS is_bridge_day
FROM bd b LEFT JOIN weather w ON b.date = w.date LEFT JOIN holidays h ON b.date = h.date
WHERE b.day_index <= b.n_days AND (h.is_bank_holiday IS NULL OR NOT h.is_bank_holiday)""")
def flow_prepare(spark, sf):
    """ML-7: the inference frame for every forecast request."""
    dates = gen_business_days(spark, sf).select("start_date", "date")
    return FE.prepare_features(dates, fx.weather(spark, sf), fx.holidays(spark, sf))


@register("prj_parse_date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 12 <> 11 THEN CAST(o_orderdate AS DATE) END AS date FROM orders""")
def prj_parse_date(spark, sf):
    """PRJ-1: the order days as text of eleven shapes, and one that is no
    date (null when not strict)."""
    o = fx.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    d = F.col("o_orderdate")
    texts = [d.cast("string"), *[F.date_format(d, f) for f in (
        "yyyy-MM-dd", "yyyyMMdd", "MM/dd/yyyy", "M/d/yy", "d MMMM yyyy", "MMMM d, yyyy", "EEE, dd MMM yyyy HH:mm:ss",
        "d-MMM-yy", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy/M/d hh:mm a")], F.lit("soon")]
    raw = F.element_at(F.array(*texts), (F.pmod(F.col("o_orderkey"), F.lit(len(texts))) + 1).cast("int"))
    return o.select("o_orderkey", parse_date(raw, strict=False).alias("date"))
