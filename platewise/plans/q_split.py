"""Queries: split, overrides and keyed writes (AGG-5, JON-5, FN-3, PRJ-3,
PRJ-11, WIN-4, SNK-1, SNK-2, SNK-3, SNK-5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise import fixtures as fx
from platewise.fixtures_sql import ratio_fallback, theme_case
from platewise.functions.calendar import day_theme, month_name, weekday_name
from platewise.functions.split import split_total
from platewise.operators import split as SP
from platewise.operators import upsert as UP
from platewise.operators.rollup import daily_demand
from platewise.plans.catalog import register
from platewise.schemas import PREDICTION_COLUMNS
from platewise.session import scratch_dir
from platewise.sinks.tables import read_table, upsert_into


@register("agg_theme_ratio", f"""
SELECT site_id, {theme_case("date")} AS day_theme,
       avg(actual_meals_veg) / NULLIF(avg(actual_meals_veg) + avg(actual_meals_non_veg), 0) AS veg_ratio,
       avg(actual_meals_non_veg) / NULLIF(avg(actual_meals_veg) + avg(actual_meals_non_veg), 0) AS non_veg_ratio
FROM site_sales
WHERE actual_meals_veg IS NOT NULL AND actual_meals_non_veg IS NOT NULL AND day(date) <> 5
GROUP BY 1, 2""")
def agg_theme_ratio(spark, sf):
    """AGG-5 / FLT-5: empirical veg share per (site, theme) from the whole
    history; days with a null count (here every 5th) don't count."""
    sales = fx.site_sales(spark, sf).withColumn("actual_meals_veg",
                                                F.when(F.dayofmonth("date") != 5, F.col("actual_meals_veg")))
    return SP.theme_ratios(sales, keys=["site_id", "date"])


def _all_days(spark, sf):
    return fx.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()


@register("jon_theme_ratio", f"""
, d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT d.date, {theme_case("d.date")} AS day_theme,
       COALESCE(r.veg_ratio, {ratio_fallback(theme_case("d.date"), 0)}) AS veg_ratio,
       COALESCE(r.non_veg_ratio, {ratio_fallback(theme_case("d.date"), 1)}) AS non_veg_ratio
FROM d LEFT JOIN theme_ratio r ON r.day_theme = {theme_case("d.date")}""")
def jon_theme_ratio(spark, sf):
    """JON-5: ratio per day, empirical -> fixed theme ratio -> (0.5, 0.5)."""
    d = _all_days(spark, sf).withColumn("day_theme", day_theme("date"))
    return SP.with_theme_ratio(d, SP.theme_ratios(fx.actual_sales(spark, sf)))


@register("fn_split", """
SELECT date, predicted_meals,
       CAST(ceil(CAST(predicted_meals AS DOUBLE) * veg_ratio) AS BIGINT) AS veg,
       predicted_meals - CAST(ceil(CAST(predicted_meals AS DOUBLE) * veg_ratio) AS BIGINT) AS non_veg
FROM (SELECT p.date, p.predicted_meals,
             COALESCE(r.veg_ratio, """ + ratio_fallback("p.day_theme", 0) + """) AS veg_ratio
      FROM predictions p LEFT JOIN theme_ratio r ON r.day_theme = p.day_theme) x""")
def fn_split(spark, sf):
    """FN-3: split each model total (before overrides) by the theme ratio."""
    a = fx.actual_sales(spark, sf)
    p = SP.with_theme_ratio(fx.predictions(spark, sf, a).select("date", "day_theme", "predicted_meals"),
                            SP.theme_ratios(a))
    s = split_total(F.col("predicted_meals"), F.col("veg_ratio"))
    return p.select("date", "predicted_meals", s["veg"].alias("veg"), s["non_veg"].alias("non_veg"))


@register("prj_final_prediction", """
SELECT date, predicted_meals, override_meal_prediction,
       COALESCE(override_meal_prediction, predicted_meals) AS final_prediction
FROM predictions""")
def prj_final_prediction(spark, sf):
    """PRJ-3: final = override when present, else the prediction."""
    p = fx.predictions(spark, sf).select("date", "predicted_meals", "override_meal_prediction")
    return SP.with_final_prediction(p).drop("override_reason")


_OVERRIDE_COLS = ", ".join(c for c in PREDICTION_COLUMNS)


@register("prj_apply_override", f"""
, src AS (
  SELECT p.*, COALESCE(r.veg_ratio, {ratio_fallback("p.day_theme", 0)}) AS vr,
         CASE WHEN day(p.date) % 7 = 0 THEN p.predicted_meals * 2 END AS ov
  FROM predictions p LEFT JOIN theme_ratio r ON r.day_theme = p.day_theme)
SELECT date, weekday, month, day_theme, temperature_max, weather_condition, is_bridge_day,
       is_school_break, holiday_desc, predicted_meals,
       CASE WHEN ov IS NOT NULL THEN CAST(ceil(CAST(ov AS DOUBLE) * vr) AS BIGINT)
            ELSE CAST(ceil(CAST(predicted_meals AS DOUBLE) * vr) AS BIGINT) END AS predicted_meals_veg,
       CASE WHEN ov IS NOT NULL THEN ov - CAST(ceil(CAST(ov AS DOUBLE) * vr) AS BIGINT)
            ELSE predicted_meals - CAST(ceil(CAST(predicted_meals AS DOUBLE) * vr) AS BIGINT) END
         AS predicted_meals_non_veg,
       predicted_meals_salad + 1 AS predicted_meals_salad,
       prediction_timestamp,
       ov AS override_meal_prediction,
       CASE WHEN ov IS NOT NULL THEN 'Catering' END AS override_reason,
       COALESCE(ov, predicted_meals) AS final_prediction
FROM src""")
def prj_apply_override(spark, sf):
    """PRJ-11: a reviewed forecast (model split, no overrides) plus a review
    sheet: salad for every day, a doubled total with a reason on days
    divisible by 7. Overridden days are re-split on the new total."""
    a = fx.actual_sales(spark, sf)
    ratios = SP.theme_ratios(a)
    p = fx.predictions(spark, sf, a)
    forecast = SP.split_forecast(
        p.drop("predicted_meals_veg", "predicted_meals_non_veg", "override_meal_prediction",
               "override_reason", "final_prediction"), ratios)
    review = p.select(
        "date",
        F.when(F.dayofmonth("date") % 7 == 0, F.col("predicted_meals") * 2).alias("override_meal_prediction"),
        F.when(F.dayofmonth("date") % 7 == 0, F.lit("Catering")).alias("override_reason"),
        (F.col("predicted_meals_salad") + F.lit(1.0)).alias("predicted_meals_salad"))
    return SP.apply_overrides(forecast, review, ratios).select(*PREDICTION_COLUMNS)


def _prediction_batch(spark, sf):
    """A re-saved forecast batch: every Friday twice (ordinal 1: +1, ordinal
    2: +5 meals, no override) and a new Saturday row after each Friday.
    The three versions come from one scan (a bounded explode)."""
    p = fx.predictions(spark, sf)
    fri = p.filter(F.col("weekday") == "Friday")
    versions = F.array(*[F.struct(F.lit(add).alias("add"), F.lit(o).alias("ord"), F.lit(shift).alias("shift"))
                         for add, o, shift in ((1, 1, 0), (5, 2, 0), (5, 3, 1))])
    v = fri.select("*", F.inline(versions))
    d = F.date_add("date", F.col("shift"))
    pm = F.col("predicted_meals") + F.col("add")
    batch = v.withColumns({
        "date": d, "weekday": weekday_name(d), "month": month_name(d), "day_theme": day_theme(d),
        "predicted_meals": pm, "override_meal_prediction": F.lit(None).cast("bigint"),
        "override_reason": F.lit(None).cast("string"), "final_prediction": pm,
    }).withColumnRenamed("ord", "_ord").drop("add", "shift")
    return p, batch


_BATCH_SQL = """
, fri AS (SELECT * FROM predictions WHERE weekday = 'Friday'),
batch AS (
  SELECT date, weekday, month, day_theme, predicted_meals + 1 AS pm, 1 AS ord, * EXCLUDE (date, weekday, month, day_theme) FROM fri
  UNION ALL
  SELECT date, weekday, month, day_theme, predicted_meals + 5 AS pm, 2 AS ord, * EXCLUDE (date, weekday, month, day_theme) FROM fri
  UNION ALL
  SELECT date + 1, dayname(date + 1), monthname(date + 1), NULL, predicted_meals + 5 AS pm, 3 AS ord,
         * EXCLUDE (date, weekday, month, day_theme) FROM fri),
last AS (
  SELECT date, weekday, month, day_theme, temperature_max, weather_condition, is_bridge_day,
         is_school_break, holiday_desc, pm AS predicted_meals, predicted_meals_veg,
         predicted_meals_non_veg, predicted_meals_salad, prediction_timestamp,
         CAST(NULL AS BIGINT) AS override_meal_prediction, CAST(NULL AS VARCHAR) AS override_reason,
         pm AS final_prediction
  FROM batch QUALIFY row_number() OVER (PARTITION BY date ORDER BY ord DESC) = 1)"""


@register("win_last_wins", _BATCH_SQL + "\nSELECT * FROM last")
def win_last_wins(spark, sf):
    """WIN-4: duplicate keys in one batch, the last row wins."""
    _, batch = _prediction_batch(spark, sf)
    return UP.last_wins(batch, ["date"], "_ord").drop("_ord").select(*PREDICTION_COLUMNS)


@register("snk_upsert_predictions", _BATCH_SQL + f"""
SELECT {_OVERRIDE_COLS} FROM predictions WHERE date NOT IN (SELECT date FROM last)
UNION ALL SELECT {_OVERRIDE_COLS} FROM last""")
def snk_upsert_predictions(spark, sf):
    """SNK-1: upsert of the batch into predictions (full-row replace)."""
    target, batch = _prediction_batch(spark, sf)
    return UP.upsert(target, batch, ["date"], order_col="_ord")


def weekend_sales(spark, sf):
    """Weekend order days rolled up like the weekdays (rows to insert)."""
    o = fx.table(spark, sf, "orders")
    d = daily_demand(o, F.col("o_orderdate").cast("date"), F.col("o_orderpriority").isin(*fx.VEG_PRIORITIES),
                     fx._salad_cents(), fx.SALAD_DIVISOR, working_days_only=False)
    return d.filter(F.weekday("date") >= 5)


def edits(spark, sf):
    """The ``edits`` view: actual_sales with cells changed by ``day(date) % 5``:
    0 -> one more veg meal (total follows), 1 -> half a kilo more salad,
    2 -> veg and non-veg swapped; other days unchanged."""
    a = fx.actual_sales(spark, sf)
    k = F.dayofmonth("date") % 5
    return a.select(
        "date",
        F.when(k == 0, F.col("actual_meals") + 1).otherwise(F.col("actual_meals")).alias("actual_meals"),
        F.when(k == 0, F.col("actual_meals_veg") + 1)
         .when(k == 2, F.col("actual_meals_non_veg")).otherwise(F.col("actual_meals_veg")).alias("actual_meals_veg"),
        F.when(k == 2, F.col("actual_meals_veg")).otherwise(F.col("actual_meals_non_veg")).alias("actual_meals_non_veg"),
        F.when(k == 1, F.col("actual_meals_salad") + F.lit(0.5)).otherwise(F.col("actual_meals_salad"))
         .alias("actual_meals_salad"))


_WEEKEND_SQL = f"""
weekend AS (
  SELECT CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS BIGINT) AS actual_meals,
         CAST(count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS BIGINT) AS actual_meals_veg,
         CAST(count(*) - count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS BIGINT)
           AS actual_meals_non_veg,
         CAST((CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END)
                 AS BIGINT) * 200 + {fx.SALAD_DIVISOR}) // {2 * fx.SALAD_DIVISOR} AS DOUBLE) / 100 AS actual_meals_salad
  FROM orders WHERE isodow(CAST(o_orderdate AS DATE)) >= 6 GROUP BY 1)"""

EDITS_SQL = """
edits AS (
  SELECT date,
         CASE WHEN day(date) % 5 = 0 THEN actual_meals + 1 ELSE actual_meals END AS actual_meals,
         CASE WHEN day(date) % 5 = 0 THEN actual_meals_veg + 1
              WHEN day(date) % 5 = 2 THEN actual_meals_non_veg ELSE actual_meals_veg END AS actual_meals_veg,
         CASE WHEN day(date) % 5 = 2 THEN actual_meals_veg ELSE actual_meals_non_veg END AS actual_meals_non_veg,
         CASE WHEN day(date) % 5 = 1 THEN actual_meals_salad + 0.5 ELSE actual_meals_salad END AS actual_meals_salad
  FROM actual_sales)"""


@register("snk_upsert_actuals", f"""
, {_WEEKEND_SQL.strip()}, {EDITS_SQL.strip()},
changed AS (
  SELECT e.* FROM edits e JOIN actual_sales a ON e.date = a.date
  WHERE e.actual_meals IS DISTINCT FROM a.actual_meals OR e.actual_meals_veg IS DISTINCT FROM a.actual_meals_veg
     OR e.actual_meals_non_veg IS DISTINCT FROM a.actual_meals_non_veg
     OR e.actual_meals_salad IS DISTINCT FROM a.actual_meals_salad),
upd AS (SELECT * FROM changed UNION ALL SELECT * FROM weekend)
SELECT * FROM actual_sales WHERE date NOT IN (SELECT date FROM upd)
UNION ALL SELECT * FROM upd""")
def snk_upsert_actuals(spark, sf):
    """SNK-2: actuals upsert of every corrected weekday (the rows that differ
    from the stored ones) plus the new weekend days."""
    from platewise.operators.validate import changed_rows
    a = fx.actual_sales(spark, sf)
    upd = changed_rows(edits(spark, sf), a).unionByName(weekend_sales(spark, sf))
    return UP.upsert(a, upd, ["date"])


@register("snk_upsert_nan", """
SELECT date, actual_meals, actual_meals_veg, actual_meals_non_veg,
       CASE WHEN day(date) % 7 <> 0 THEN actual_meals_salad END AS actual_meals_salad FROM actual_sales""")
def snk_upsert_nan(spark, sf):
    """SNK-11: a batch whose salad is NaN on every seventh day of a month
    arrives with nulls there."""
    a = fx.actual_sales(spark, sf)
    d = F.dayofmonth("date") % 7
    nan = a.filter(d == 0).withColumn("actual_meals_salad", F.lit(float("nan")))
    return UP.upsert(a, nan, ["date"])


@register("snk_append", f"""
, {_WEEKEND_SQL.strip()}
SELECT * FROM actual_sales UNION ALL SELECT * FROM weekend""")
def snk_append(spark, sf):
    """SNK-3: seed append of weekend days to the weekday table."""
    return UP.append(fx.actual_sales(spark, sf), weekend_sales(spark, sf))


@register("snk_delete_keys", """
SELECT * FROM actual_sales
WHERE date NOT IN (SELECT date FROM holidays WHERE is_bank_holiday)""")
def snk_delete_keys(spark, sf):
    """SNK-5: delete the actuals of bank holidays by key."""
    doomed = fx.holidays(spark, sf).filter("is_bank_holiday")
    return UP.delete_keys(fx.actual_sales(spark, sf), doomed)


@register("snk_upsert_site", """
, upd AS (SELECT site_id, date + 7 AS date, day_theme, predicted_meals, predicted_meals_veg, predicted_meals_non_veg,
                 predicted_meals_salad, prediction_timestamp, final_prediction + 1 AS final_prediction
          FROM site_predictions WHERE date >= (SELECT max(date) FROM site_predictions) - 27)
SELECT * FROM site_predictions p
WHERE NOT EXISTS (SELECT 1 FROM upd u WHERE u.site_id = p.site_id AND u.date = p.date)
UNION ALL SELECT * FROM upd""")
def snk_upsert_site(spark, sf):
    """SNK-1 with keys (site_id, date): every site re-saves its last four
    weeks one week ahead (+1 meal): overlapping days are replaced, the
    newest week is inserted. The published table is kept by month: only the
    months of those weeks are read and written."""
    keys, root = ["site_id", "date"], scratch_dir(spark, "upsert-site")
    p = fx.site_predictions(spark, sf)
    last = p.agg(F.max("date")).first()[0]  # one scalar
    upd = (p.filter(F.col("date") >= F.date_sub(F.lit(last), 27))
            .withColumns({"date": F.date_add("date", 7), "final_prediction": F.col("final_prediction") + 1}))
    for rows in (p, upd):
        ok, error = upsert_into(spark, root, rows, keys)
        if not ok:
            raise RuntimeError(error)
    return read_table(spark, root)
