"""Queries: daily rollup and actual-vs-predicted analysis (AIM-1, JON-3,
PRJ-5/6, AGG-1...4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise import fixtures as fx
from platewise.operators import compare as C
from platewise.operators.rollup import daily_demand, refresh_daily, touched_days
from platewise.plans.catalog import register
from platewise.session import scratch_dir
from platewise.sinks.tables import read_table

_PA = "FROM predictions p JOIN actual_sales a ON p.date = a.date"


@register("aim_daily_rollup", "SELECT * FROM site_sales")
def aim_daily_rollup(spark, sf):
    """AIM-1: order lines -> daily demand per (site, date)."""
    return fx.build_site_sales(spark, sf)


@register("aim_daily_rollup_total", "SELECT * FROM actual_sales")
def aim_daily_rollup_total(spark, sf):
    """AIM-1 without a site: one row per working day."""
    return fx.build_actual_sales(spark, sf)


_CMP_SQL = f"""
SELECT p.date, p.final_prediction, p.prediction_timestamp, p.day_theme,
       p.predicted_meals_veg, p.predicted_meals_non_veg, p.predicted_meals_salad,
       a.actual_meals, a.actual_meals_veg, a.actual_meals_non_veg, a.actual_meals_salad,
       dayname(p.date) AS weekday,
       a.actual_meals - p.final_prediction AS difference,
       CAST(a.actual_meals - p.final_prediction AS DOUBLE) / CAST(NULLIF(p.final_prediction, 0) AS DOUBLE) AS pct_error,
       a.actual_meals_veg - p.predicted_meals_veg AS difference_veg,
       CAST(a.actual_meals_veg - p.predicted_meals_veg AS DOUBLE) / CAST(NULLIF(p.predicted_meals_veg, 0) AS DOUBLE) AS pct_error_veg,
       a.actual_meals_non_veg - p.predicted_meals_non_veg AS difference_non_veg,
       CAST(a.actual_meals_non_veg - p.predicted_meals_non_veg AS DOUBLE) / CAST(NULLIF(p.predicted_meals_non_veg, 0) AS DOUBLE) AS pct_error_non_veg,
       a.actual_meals_salad - p.predicted_meals_salad AS difference_salad,
       (a.actual_meals_salad - p.predicted_meals_salad) / NULLIF(p.predicted_meals_salad, 0) AS pct_error_salad
{_PA}"""


@register("cmp_daily", _CMP_SQL)
def cmp_daily(spark, sf):
    """JON-3 + PRJ-5 + PRJ-6 over the whole history."""
    a = fx.actual_sales(spark, sf)
    return C.join_actuals(fx.predictions(spark, sf, a), a)


def _metrics_sql(tol_pct: float) -> str:
    return f"""
SELECT dayname(p.date) AS weekday,
       avg(abs(a.actual_meals - p.final_prediction)) AS mae,
       count(*) FILTER (WHERE p.final_prediction > a.actual_meals) AS over_predicted,
       count(*) FILTER (WHERE p.final_prediction < a.actual_meals) AS under_predicted,
       avg(CASE WHEN CAST(abs(a.actual_meals - p.final_prediction) AS DOUBLE)
                     / CAST(NULLIF(p.final_prediction, 0) AS DOUBLE) * 100 <= {tol_pct}
                THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) * 100 AS accuracy_rate
{_PA}
GROUP BY 1"""


@register("agg_metrics", _metrics_sql(0.05))
def agg_metrics(spark, sf):
    """AGG-1...4 per weekday; tolerance 0.05 on the percent scale (Q1)."""
    a = fx.actual_sales(spark, sf)
    j = C.join_actuals(fx.predictions(spark, sf, a), a)
    return C.metrics(j, by=["weekday"])


@register("agg_metrics_zero", """
SELECT dayname(date) AS weekday, avg(abs(a - p)) AS mae, count(*) FILTER (WHERE p > a) AS over_predicted,
       count(*) FILTER (WHERE p < a) AS under_predicted,
       avg(CASE WHEN abs(a - p) / NULLIF(p, 0) * 100 <= 0.05 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) * 100
         AS accuracy_rate
FROM (SELECT p.date, CAST(a.actual_meals AS DOUBLE) AS a,
             CAST(CASE WHEN day(p.date) % 10 = 0 THEN 0 WHEN day(p.date) % 10 <> 1 THEN p.final_prediction END AS DOUBLE) AS p
      FROM predictions p JOIN actual_sales a ON p.date = a.date) x
GROUP BY 1""")
def agg_metrics_zero(spark, sf):
    """AGG-1...4 where some predictions are zero (a miss) or null."""
    a, d = fx.actual_sales(spark, sf), F.dayofmonth("date") % 10
    p = fx.predictions(spark, sf, a).withColumn(
        "final_prediction", F.when(d == 0, F.lit(0).cast("bigint")).when(d != 1, F.col("final_prediction")))
    return C.metrics(C.join_actuals(p, a), by=["weekday"])


@register("agg_metrics_fraction", _metrics_sql(5.0))
def agg_metrics_fraction(spark, sf):
    """AGG-1...4 per weekday; tolerance read as a fraction (5 %)."""
    a = fx.actual_sales(spark, sf)
    j = C.join_actuals(fx.predictions(spark, sf, a), a)
    return C.metrics(j, by=["weekday"], tolerance=0.05, tolerance_unit="fraction")


# --- FLT-1 / FLT-2 / SRC-4 ----------------------------------------------------
RANGE = ("1996-01-01", "1999-12-31")
AS_OF = "2001-06-13"


@register("flt_date_range", f"""
SELECT * FROM predictions WHERE date BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}'""")
def flt_date_range(spark, sf):
    """FLT-1: inclusive date range, pushed to the scan."""
    return C.date_range(fx.predictions(spark, sf), *RANGE)


@register("flt_from_monday", f"""
SELECT * FROM predictions WHERE date >= CAST(date_trunc('week', DATE '{AS_OF}') AS DATE)""")
def flt_from_monday(spark, sf):
    """FLT-2: from Monday of the as-of week on, no upper bound (Q16)."""
    return C.from_week_start(fx.predictions(spark, sf), AS_OF)


@register("src_param_sql", f"""
SELECT * FROM holidays WHERE date >= DATE '{RANGE[0]}' AND date <= DATE '{RANGE[1]}'""")
def src_param_sql(spark, sf):
    """SRC-4: parameterised SQL over a catalog view with bound named args."""
    from platewise.sources.tables import param_sql
    fx.holidays(spark, sf).createOrReplaceTempView("pw_holidays")
    return param_sql(spark, "SELECT * FROM pw_holidays WHERE date >= :start_date AND date <= :end_date",
                     start_date=RANGE[0], end_date=RANGE[1])


# --- JON-4 / JON-8 / AGG-11 -----------------------------------------------------
@register("jon_missing_actuals", """
SELECT p.date, p.final_prediction, p.day_theme, p.predicted_meals_veg, p.predicted_meals_non_veg,
       p.predicted_meals_salad, CAST(NULL AS BIGINT) AS actual_meals, CAST(NULL AS BIGINT) AS actual_meals_veg,
       CAST(NULL AS BIGINT) AS actual_meals_non_veg, CAST(NULL AS DOUBLE) AS actual_meals_salad
FROM predictions p LEFT JOIN actual_sales a ON p.date = a.date AND NOT (day(a.date) = 1)
WHERE a.date IS NULL""")
def jon_missing_actuals(spark, sf):
    """JON-4: predicted days without actuals; the actuals table here lacks
    the first day of every month (not yet imported)."""
    a = fx.actual_sales(spark, sf)
    imported = a.filter(F.dayofmonth("date") != 1)
    return C.missing_actuals(fx.predictions(spark, sf, a), imported)


def batched_predictions(spark, sf):
    """Predictions saved in monthly batches: the batch timestamp is the last
    day of the previous month, 08:00."""
    p = fx.predictions(spark, sf)
    ts = F.date_sub(F.date_trunc("month", "date").cast("date"), 1).cast("timestamp_ntz") + F.expr("INTERVAL 8 HOURS")
    return p.withColumn("prediction_timestamp", ts)


_BATCHED = """
, batched AS (SELECT * REPLACE (CAST(CAST(date_trunc('month', date) AS DATE) - 1 AS TIMESTAMP)
                                 + INTERVAL 8 HOUR AS prediction_timestamp) FROM predictions)"""


@register("jon_latest_batch", _BATCHED + """
SELECT * FROM batched WHERE prediction_timestamp = (SELECT max(prediction_timestamp) FROM batched)""")
def jon_latest_batch(spark, sf):
    """JON-8: rows of the most recent batch (scalar-subquery equality)."""
    return C.latest_batch(batched_predictions(spark, sf))


@register("agg_last_prediction", _BATCHED + """
SELECT max(prediction_timestamp) AS timestamp,
       min(date) FILTER (WHERE prediction_timestamp = (SELECT max(prediction_timestamp) FROM batched)) AS start_date,
       max(date) FILTER (WHERE prediction_timestamp = (SELECT max(prediction_timestamp) FROM batched)) AS end_date
FROM batched""")
def agg_last_prediction(spark, sf):
    """AGG-11 / SRT-2: latest batch timestamp, its first and last date."""
    return C.last_prediction_info(batched_predictions(spark, sf))


# --- AGG-6...9 ------------------------------------------------------------------
@register("agg_kpis", """
SELECT CAST(date_trunc('month', date) AS DATE) AS month_start,
       CAST(sum(final_prediction) AS BIGINT) AS total_meals,
       CAST(sum(predicted_meals_veg) AS BIGINT) AS total_veg,
       CAST(sum(predicted_meals_non_veg) AS BIGINT) AS total_non_veg,
       round(sum(predicted_meals_salad), 2) AS total_salad,
       avg(final_prediction) AS avg_meals,
       CAST(trunc(avg(final_prediction)) AS BIGINT) AS avg_meals_display,
       count(*) AS days
FROM predictions GROUP BY 1""")
def agg_kpis(spark, sf):
    """AGG-6 / AGG-7: forecast totals and daily mean per month."""
    p = fx.predictions(spark, sf).withColumn("month_start", F.date_trunc("month", "date").cast("date"))
    k = C.forecast_kpis(p, by=["month_start"])
    return k.withColumn("total_salad", F.round("total_salad", 2))


@register("agg_peak_day", """
SELECT week_start, date, final_prediction, predicted_meals_veg, predicted_meals_non_veg FROM (
  SELECT CAST(date_trunc('week', date) AS DATE) AS week_start, date, final_prediction,
         predicted_meals_veg, predicted_meals_non_veg,
         row_number() OVER (PARTITION BY date_trunc('week', date) ORDER BY final_prediction DESC, date) AS rn
  FROM predictions) t WHERE rn = 1""")
def agg_peak_day(spark, sf):
    """AGG-8: peak day per planning week, earliest day on ties."""
    p = fx.predictions(spark, sf).withColumn("week_start", F.date_trunc("week", "date").cast("date"))
    return C.peak_day(p, by=["week_start"])


@register("agg_date_bounds", """
SELECT site_id, min(date) AS min_date, max(date) AS max_date FROM site_sales GROUP BY 1""")
def agg_date_bounds(spark, sf):
    """AGG-9: first and last day of history per site."""
    return C.date_bounds(fx.site_sales(spark, sf), by=["site_id"])


# --- AGG-10 / FN-5 / FLOW-2 -------------------------------------------------------
def _pop_sql(unit: str) -> str:
    start = "CAST(date_trunc('month', date) AS DATE)" if unit == "month" else "CAST(date_trunc('week', date) AS DATE)"
    end = "CAST(last_day(period_start) AS DATE)" if unit == "month" else "period_start + 4"
    return f"""
, j AS (SELECT p.date, p.final_prediction AS pr, a.actual_meals AS ac {_PA}),
per AS (SELECT DISTINCT {start} AS period_start FROM j),
per2 AS (SELECT period_start, {end} AS period_end, period_start - 1 AS prev_end,
                period_start - 1 - CAST({end} - period_start AS INTEGER) AS prev_start FROM per),
t AS (SELECT per2.period_start, per2.period_end, j.date >= per2.period_start AS cur, j.ac, j.pr,
             CASE WHEN COALESCE(CAST(abs(j.ac - j.pr) AS DOUBLE) / CAST(NULLIF(j.pr, 0) AS DOUBLE) * 100 <= 0.05, false)
                  THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS hit
      FROM per2 JOIN j ON j.date BETWEEN per2.prev_start AND per2.period_end),
g AS (SELECT period_start, period_end,
             count(*) FILTER (WHERE cur) AS cur_rows, count(*) FILTER (WHERE NOT cur) AS prev_rows,
             avg(abs(ac - pr)) FILTER (WHERE cur) AS cur_mae, avg(abs(ac - pr)) FILTER (WHERE NOT cur) AS prev_mae,
             count(*) FILTER (WHERE cur AND pr > ac) AS cur_over, count(*) FILTER (WHERE NOT cur AND pr > ac) AS prev_over,
             count(*) FILTER (WHERE cur AND pr < ac) AS cur_under, count(*) FILTER (WHERE NOT cur AND pr < ac) AS prev_under,
             avg(hit) FILTER (WHERE cur) * 100 AS cur_acc, avg(hit) FILTER (WHERE NOT cur) * 100 AS prev_acc
      FROM t GROUP BY 1, 2)
SELECT period_start, period_end, cur_rows AS rows, prev_rows, cur_mae AS mae, cur_acc AS accuracy_rate,
       cur_over AS over_predicted, cur_under AS under_predicted,
       CASE WHEN prev_rows > 0 THEN cur_mae - prev_mae END AS mae_delta,
       CASE WHEN prev_rows > 0 THEN cur_acc - prev_acc END AS accuracy_delta,
       CASE WHEN prev_rows > 0 THEN cur_over - prev_over END AS over_delta,
       CASE WHEN prev_rows > 0 THEN cur_under - prev_under END AS under_delta
FROM g WHERE cur_rows > 0"""


@register("agg_period_delta", _pop_sql("month"))
def agg_period_delta(spark, sf):
    """AGG-10: every month against the equally long span before it."""
    a = fx.actual_sales(spark, sf)
    return C.period_over_period_all(fx.predictions(spark, sf, a), a, unit="month")


@register("flow_compare", _pop_sql("week"))
def flow_compare(spark, sf):
    """FLOW-2: the analysis page for every Mon-Fri week: join, errors,
    metrics, previous equally long period, deltas."""
    a = fx.actual_sales(spark, sf)
    return C.period_over_period_all(fx.predictions(spark, sf, a), a, unit="week")


@register("fn_periods", """
SELECT as_of, last_week_start, last_week_start + 4 AS last_week_end,
       last_week_start - 1 - 4 AS prev_start, last_week_start - 1 AS prev_end
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS as_of,
             CAST(date_trunc('week', CAST(o_orderdate AS DATE)) AS DATE) - 7 AS last_week_start
      FROM orders) t""")
def fn_periods(spark, sf):
    """FN-5: default window (last full Mon-Fri week) and its previous period
    for every order date taken as the as-of day."""
    from platewise.functions.calendar import last_full_week, previous_period
    d = fx.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("as_of")).distinct()
    w = d.withColumn("_w", last_full_week(F.col("as_of")))
    w = w.withColumn("_p", previous_period(F.col("_w.start"), F.col("_w.end")))
    return w.select("as_of", F.col("_w.start").alias("last_week_start"), F.col("_w.end").alias("last_week_end"),
                    F.col("_p.prev_start").alias("prev_start"), F.col("_p.prev_end").alias("prev_end"))


# --- PRJ-7 / FN-10 ----------------------------------------------------------------
@register("cmp_table", f"""
SELECT p.date, p.final_prediction, a.actual_meals,
       round_even(CAST(a.actual_meals - p.final_prediction AS DOUBLE) / CAST(NULLIF(p.final_prediction, 0) AS DOUBLE) * 100, 0) AS pct_error,
       round_even(CAST(a.actual_meals_veg - p.predicted_meals_veg AS DOUBLE) / CAST(NULLIF(p.predicted_meals_veg, 0) AS DOUBLE) * 100, 0) AS pct_error_veg,
       round_even(CAST(a.actual_meals_non_veg - p.predicted_meals_non_veg AS DOUBLE) / CAST(NULLIF(p.predicted_meals_non_veg, 0) AS DOUBLE) * 100, 0) AS pct_error_non_veg,
       round_even((a.actual_meals_salad - p.predicted_meals_salad) / NULLIF(p.predicted_meals_salad, 0) * 100, 0) AS pct_error_salad
{_PA}""")
def cmp_table(spark, sf):
    """PRJ-7: the comparison table with whole-percent errors (half-even)."""
    from platewise.functions.formats import pct_display
    a = fx.actual_sales(spark, sf)
    j = C.join_actuals(fx.predictions(spark, sf, a), a)
    return j.select("date", "final_prediction", "actual_meals",
                    *[pct_display(c).alias(c) for c in
                      ("pct_error", "pct_error_veg", "pct_error_non_veg", "pct_error_salad")])


@register("fn_sign_class", f"""
SELECT date, difference, CASE WHEN difference > 0 THEN 'green' ELSE 'red' END AS difference_class
FROM (SELECT p.date, CASE WHEN day(p.date) <> 9 THEN a.actual_meals - p.final_prediction END AS difference {_PA}) d""")
def fn_sign_class(spark, sf):
    """FN-10: colour class of each day's difference (0 is red, and so is the
    null of every 9th)."""
    from platewise.functions.formats import sign_class
    a = fx.actual_sales(spark, sf)
    j = C.join_actuals(fx.predictions(spark, sf, a), a)
    j = j.select("date", F.when(F.dayofmonth("date") != 9, F.col("difference")).alias("difference"))
    return j.withColumn("difference_class", sign_class("difference"))


@register("prj_casts", """
SELECT p.date, CAST(COALESCE(p.final_prediction, 0) AS BIGINT) AS final_prediction,
       CAST(COALESCE(p.predicted_meals_veg, 0) AS BIGINT) AS predicted_meals_veg,
       CAST(COALESCE(p.predicted_meals_non_veg, 0) AS BIGINT) AS predicted_meals_non_veg,
       CAST(NULL AS BIGINT) AS actual_meals, CAST(NULL AS BIGINT) AS actual_meals_veg,
       CAST(NULL AS BIGINT) AS actual_meals_non_veg
FROM predictions p LEFT JOIN actual_sales a ON p.date = a.date AND NOT (day(a.date) = 1)
WHERE a.date IS NULL""")
def prj_casts(spark, sf):
    """PRJ-9: the missing-actuals grid as displayed: predicted counts filled
    with 0 and whole, actual counts nullable whole numbers."""
    from platewise.functions.formats import int_or_zero
    m = jon_missing_actuals(spark, sf)
    return m.select("date", *[int_or_zero(c).alias(c) for c in
                              ("final_prediction", "predicted_meals_veg", "predicted_meals_non_veg")],
                    *[F.col(c).cast("bigint").alias(c) for c in
                      ("actual_meals", "actual_meals_veg", "actual_meals_non_veg")])


@register("srt_cmp_ordered", _CMP_SQL)
def srt_cmp_ordered(spark, sf):
    """SRT-1: the comparison in date order (distributed range sort)."""
    a = fx.actual_sales(spark, sf)
    return C.join_actuals(fx.predictions(spark, sf, a), a, ordered=True)


# --- per-site variants (keys = site_id, date) ------------------------------------------
_SPA = "FROM site_predictions p JOIN site_sales a ON p.site_id = a.site_id AND p.date = a.date"
SITE_KEYS = ["site_id", "date"]


@register("cmp_site_metrics", f"""
SELECT p.site_id,
       avg(abs(a.actual_meals - p.final_prediction)) AS mae,
       count(*) FILTER (WHERE p.final_prediction > a.actual_meals) AS over_predicted,
       count(*) FILTER (WHERE p.final_prediction < a.actual_meals) AS under_predicted,
       avg(CASE WHEN CAST(abs(a.actual_meals - p.final_prediction) AS DOUBLE)
                     / CAST(NULLIF(p.final_prediction, 0) AS DOUBLE) * 100 <= 5.0
                THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) * 100 AS accuracy_rate
{_SPA}
GROUP BY 1""")
def cmp_site_metrics(spark, sf):
    """JON-3 + AGG-1...4 per site (keys site_id, date): one grouped aggregate."""
    j = C.join_actuals(fx.site_predictions(spark, sf), fx.site_sales(spark, sf), keys=SITE_KEYS)
    return C.metrics(j, by=["site_id"], tolerance=0.05, tolerance_unit="fraction")


@register("agg_period_delta_site", f"""
, j AS (SELECT p.site_id, p.date, p.final_prediction AS pr, a.actual_meals AS ac {_SPA}),
per AS (SELECT DISTINCT site_id, CAST(date_trunc('month', date) AS DATE) AS period_start FROM j),
per2 AS (SELECT site_id, period_start, CAST(last_day(period_start) AS DATE) AS period_end,
                period_start - 1 - CAST(CAST(last_day(period_start) AS DATE) - period_start AS INTEGER) AS prev_start
         FROM per),
t AS (SELECT per2.site_id, per2.period_start, per2.period_end, j.date >= per2.period_start AS cur, j.ac, j.pr,
             CASE WHEN COALESCE(CAST(abs(j.ac - j.pr) AS DOUBLE) / CAST(NULLIF(j.pr, 0) AS DOUBLE) * 100 <= 0.05, false)
                  THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS hit
      FROM per2 JOIN j ON j.site_id = per2.site_id AND j.date BETWEEN per2.prev_start AND per2.period_end),
g AS (SELECT site_id, period_start, period_end,
             count(*) FILTER (WHERE cur) AS cur_rows, count(*) FILTER (WHERE NOT cur) AS prev_rows,
             avg(abs(ac - pr)) FILTER (WHERE cur) AS cur_mae, avg(abs(ac - pr)) FILTER (WHERE NOT cur) AS prev_mae,
             count(*) FILTER (WHERE cur AND pr > ac) AS cur_over, count(*) FILTER (WHERE NOT cur AND pr > ac) AS prev_over,
             count(*) FILTER (WHERE cur AND pr < ac) AS cur_under, count(*) FILTER (WHERE NOT cur AND pr < ac) AS prev_under,
             avg(hit) FILTER (WHERE cur) * 100 AS cur_acc, avg(hit) FILTER (WHERE NOT cur) * 100 AS prev_acc
      FROM t GROUP BY 1, 2, 3)
SELECT site_id, period_start, period_end, cur_rows AS rows, prev_rows, cur_mae AS mae, cur_acc AS accuracy_rate,
       cur_over AS over_predicted, cur_under AS under_predicted,
       CASE WHEN prev_rows > 0 THEN cur_mae - prev_mae END AS mae_delta,
       CASE WHEN prev_rows > 0 THEN cur_acc - prev_acc END AS accuracy_delta,
       CASE WHEN prev_rows > 0 THEN cur_over - prev_over END AS over_delta,
       CASE WHEN prev_rows > 0 THEN cur_under - prev_under END AS under_delta
FROM g WHERE cur_rows > 0""")
def agg_period_delta_site(spark, sf):
    """AGG-10 per (site, month): every site's months against the span before."""
    return C.period_over_period_all(fx.site_predictions(spark, sf), fx.site_sales(spark, sf), unit="month",
                                    keys=SITE_KEYS)


@register("fn_split_site", "SELECT site_id, date, day_theme, predicted_meals, predicted_meals_veg, "
                           "predicted_meals_non_veg FROM site_predictions")
def fn_split_site(spark, sf):
    """AGG-5 + JON-5 + FN-3 per site: each site's forecast split with the
    site's own empirical theme ratio (computed from that site's history)."""
    from platewise.operators import split as SP
    keys = SITE_KEYS
    a = fx.site_sales(spark, sf)
    p = fx.site_predictions(spark, sf).select("site_id", "date", "day_theme", "predicted_meals")
    return SP.split_forecast(p, SP.theme_ratios(a, keys), keys)


WINDOW = ("2000-03-06", "2000-03-10")


@register("agg_period_delta_window", f"""
, j AS (SELECT p.date, p.final_prediction AS pr, a.actual_meals AS ac {_PA}
        WHERE p.date BETWEEN DATE '{WINDOW[0]}' - 5 AND DATE '{WINDOW[1]}'),
t AS (SELECT date >= DATE '{WINDOW[0]}' AS cur, ac, pr,
             CASE WHEN COALESCE(CAST(abs(ac - pr) AS DOUBLE) / CAST(NULLIF(pr, 0) AS DOUBLE) * 100 <= 0.05, false)
                  THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS hit FROM j),
g AS (SELECT count(*) FILTER (WHERE cur) AS cur_rows, count(*) FILTER (WHERE NOT cur) AS prev_rows,
             avg(abs(ac - pr)) FILTER (WHERE cur) AS cur_mae, avg(abs(ac - pr)) FILTER (WHERE NOT cur) AS prev_mae,
             count(*) FILTER (WHERE cur AND pr > ac) AS cur_over, count(*) FILTER (WHERE NOT cur AND pr > ac) AS prev_over,
             count(*) FILTER (WHERE cur AND pr < ac) AS cur_under, count(*) FILTER (WHERE NOT cur AND pr < ac) AS prev_under,
             avg(hit) FILTER (WHERE cur) * 100 AS cur_acc, avg(hit) FILTER (WHERE NOT cur) * 100 AS prev_acc
      FROM t)
SELECT DATE '{WINDOW[0]}' AS period_start, DATE '{WINDOW[1]}' AS period_end,
       DATE '{WINDOW[0]}' - 5 AS prev_start, DATE '{WINDOW[0]}' - 1 AS prev_end,
       cur_rows AS rows, prev_rows, cur_mae AS mae, cur_acc AS accuracy_rate,
       cur_over AS over_predicted, cur_under AS under_predicted,
       CASE WHEN prev_rows > 0 THEN cur_mae - prev_mae END AS mae_delta,
       CASE WHEN prev_rows > 0 THEN cur_acc - prev_acc END AS accuracy_delta,
       CASE WHEN prev_rows > 0 THEN cur_over - prev_over END AS over_delta,
       CASE WHEN prev_rows > 0 THEN cur_under - prev_under END AS under_delta
FROM g""")
def agg_period_delta_window(spark, sf):
    """AGG-10 for one chosen window (Mon-Fri) and the equally long span before
    it (Wednesday to Sunday of the week before), one scan, one aggregate."""
    a = fx.actual_sales(spark, sf)
    return C.period_over_period(fx.predictions(spark, sf, a), a, *WINDOW)


def landed_orders(spark, sf):
    """The orders as they arrived: two days after the order, every ninth one
    up to 210 days late."""
    late = F.when(F.col("o_orderkey") % 9 == 0, F.col("o_orderkey") % 211).otherwise(F.lit(2)).cast("int")
    orders = fx.table(spark, sf, "orders").withColumn(
        "arrived_at", F.col("o_orderdate") + F.make_dt_interval(days=late))
    path = scratch_dir(spark, "landed-orders")
    orders.write.parquet(path)
    return spark.read.parquet(path)


def _earlier(lines, days):
    """The constant ``days`` days before the last arrival."""
    last = lines.agg((F.max("arrived_at") - F.make_dt_interval(days=F.lit(days))).cast("string")).first()[0]  # one scalar
    return F.lit(last).cast(lines.schema["arrived_at"].dataType)


def daily_of(lines):
    """The daily rows of order lines (AIM-1)."""
    return daily_demand(lines, F.col("o_orderdate").cast("date"), F.col("o_orderpriority").isin(*fx.VEG_PRIORITIES),
                        fx._salad_cents(), fx.SALAD_DIVISOR)


@register("aim_rollup_incremental", "SELECT * FROM actual_sales")
def aim_rollup_incremental(spark, sf):
    """AIM-1 maintained: the table is built from the lines that had arrived
    300 days before the last one, then brought up to date: the days that
    later lines touch, up to 210 days back, are recomputed and upserted by
    month. Equals the rollup of all lines."""
    lines, root = landed_orders(spark, sf), scratch_dir(spark, "maintained")
    before = lines.filter(F.col("arrived_at") <= _earlier(lines, 300))
    for arrived in (before, lines):
        refresh_daily(root, arrived, "o_orderdate", "arrived_at", daily_of)
    return read_table(spark, root)


@register("aim_late_days", """
, landed AS (
  SELECT CAST(o_orderdate AS DATE) AS date,
         o_orderdate + to_days(CAST(CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey % 211 ELSE 2 END AS INTEGER)) AS arrived_at
  FROM orders)
SELECT date, max(arrived_at) AS arrived_until, count(*) AS lines FROM landed
WHERE arrived_at > (SELECT max(arrived_at) FROM landed) - INTERVAL 300 DAY GROUP BY date""")
def aim_late_days(spark, sf):
    """AIM-1: the days that the lines of the last 300 days of arrivals touch."""
    lines = landed_orders(spark, sf)
    return touched_days(lines, "o_orderdate", "arrived_at", _earlier(lines, 300))
