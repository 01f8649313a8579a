"""The fixture views of ``platewise.fixtures`` in DuckDB SQL (oracle side).

``with_views(sql)`` prefixes a query with all views as CTEs; DuckDB only
evaluates the ones the query references. CASE expressions for the fixed
lookup tables are generated from ``platewise.constants`` so both sides use
one source of the fixed values.
"""

from __future__ import annotations

from platewise.constants import DEFAULT_RATIO, THEME_RATIOS, WEATHER_BANDS, WEATHER_DEFAULT, WEEKDAY_THEMES
from platewise.fixtures import BANK_DAYS, SALAD_DIVISOR, VEG_PRIORITIES

_ISO = {"Monday": 1, "Tuesday": 2, "Wednesday": 3, "Thursday": 4, "Friday": 5}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def theme_case(date_expr: str) -> str:
    arms = " ".join(f"WHEN {_ISO[d]} THEN {q(t)}" for d, t in WEEKDAY_THEMES.items())
    return f"(CASE isodow({date_expr}) {arms} END)"


def ratio_fallback(theme_expr: str, pick: int = 0) -> str:
    arms = " ".join(f"WHEN {q(t)} THEN {r[pick]}" for t, r in THEME_RATIOS.items())
    return f"COALESCE(CASE {theme_expr} {arms} END, {DEFAULT_RATIO[pick]})"


def weather_case(code_expr: str, pick: int) -> str:
    arms = " ".join(f"WHEN {code_expr} BETWEEN {lo} AND {hi} THEN {q((icon, label)[pick])}"
                    for lo, hi, icon, label in WEATHER_BANDS)
    return f"(CASE {arms} ELSE {q(WEATHER_DEFAULT[pick])} END)"


_VEG = ", ".join(q(p) for p in VEG_PRIORITIES)
_BANK = ", ".join(q(k) for k in BANK_DAYS)
_BANK_NAME = " ".join(f"WHEN strftime(date, '%m-%d') = {q(k)} THEN {q(v)}" for k, v in BANK_DAYS.items())


def _salad(sum_expr: str) -> str:
    # round(sum_cents / SALAD_DIVISOR, 2), half-up, exact integer arithmetic
    return (f"CAST((CAST({sum_expr} AS BIGINT) * 200 + {SALAD_DIVISOR}) // {2 * SALAD_DIVISOR} "
            f"AS DOUBLE) / 100")


_CENTS = "CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END"

VIEWS = {
    "actual_sales": f"""
SELECT CAST(o_orderdate AS DATE) AS date,
       CAST(count(*) AS BIGINT) AS actual_meals,
       CAST(count(*) FILTER (WHERE o_orderpriority IN ({_VEG})) AS BIGINT) AS actual_meals_veg,
       CAST(count(*) - count(*) FILTER (WHERE o_orderpriority IN ({_VEG})) AS BIGINT) AS actual_meals_non_veg,
       {_salad(f"sum({_CENTS})")} AS actual_meals_salad
FROM orders
WHERE isodow(CAST(o_orderdate AS DATE)) <= 5
GROUP BY 1""",
    "site_sales": f"""
SELECT c.c_nationkey AS site_id, CAST(o.o_orderdate AS DATE) AS date,
       CAST(count(*) AS BIGINT) AS actual_meals,
       CAST(count(*) FILTER (WHERE o.o_orderpriority IN ({_VEG})) AS BIGINT) AS actual_meals_veg,
       CAST(count(*) - count(*) FILTER (WHERE o.o_orderpriority IN ({_VEG})) AS BIGINT) AS actual_meals_non_veg,
       {_salad(f"sum({_CENTS})")} AS actual_meals_salad
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
WHERE isodow(CAST(o.o_orderdate AS DATE)) <= 5
GROUP BY 1, 2""",
    "weather": f"""
SELECT date, temperature_max, weather_code,
       {weather_case("weather_code", 0)} AS weather_icon,
       {weather_case("weather_code", 1)} AS weather_condition
FROM (
  SELECT CAST(l_shipdate AS DATE) AS date,
         CAST((CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) * 20 + count(*)) // (count(*) * 2) AS DOUBLE) / 10
           AS temperature_max,
         CAST(CAST(sum(l_linenumber) AS BIGINT) % 100 AS INTEGER) AS weather_code
  FROM lineitem GROUP BY 1) w""",
    "holidays": f"""
SELECT date,
       CASE {_BANK_NAME}
            WHEN is_bridge_day AND isodow(date) = 5 THEN 'Bridge Day (after Ascension)'
            WHEN is_bridge_day THEN 'Bridge Day (Heilige 3 K)'
            WHEN month(date) = 7 AND day(date) = 1 THEN 'Summer Break Start'
            WHEN month(date) = 7 AND day(date) = 31 THEN 'Summer Break End'
            WHEN month(date) = 7 THEN 'Summer Break'
            WHEN month(date) = 12 AND day(date) = 23 THEN 'Christmas Break Start'
            WHEN is_school_break THEN 'Christmas Break'
       END AS description,
       is_bank_holiday, is_school_break, is_bridge_day
FROM (
  SELECT date,
         strftime(date, '%m-%d') IN ({_BANK}) AS is_bank_holiday,
         (month(date) = 7 OR (month(date) = 12 AND day(date) >= 23)) AS is_school_break,
         ((isodow(date) = 5 AND strftime(date - 1, '%m-%d') IN ({_BANK}))
          OR (isodow(date) = 1 AND strftime(date + 1, '%m-%d') IN ({_BANK}))) AS is_bridge_day
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) d) h
WHERE is_bank_holiday OR is_school_break OR is_bridge_day""",
    "theme_ratio": f"""
SELECT day_theme,
       avg_veg / NULLIF(avg_veg + avg_non_veg, 0) AS veg_ratio,
       avg_non_veg / NULLIF(avg_veg + avg_non_veg, 0) AS non_veg_ratio
FROM (SELECT {theme_case("date")} AS day_theme,
             avg(actual_meals_veg) AS avg_veg, avg(actual_meals_non_veg) AS avg_non_veg
      FROM actual_sales
      WHERE actual_meals_veg IS NOT NULL AND actual_meals_non_veg IS NOT NULL
        AND {theme_case("date")} IS NOT NULL
      GROUP BY 1) t""",
    "pred_base": f"""
SELECT a.date, dayname(a.date) AS weekday, monthname(a.date) AS month,
       {theme_case("a.date")} AS day_theme,
       CAST(COALESCE(ceil(avg(a.actual_meals) OVER w4), 7) AS BIGINT) AS predicted_meals,
       COALESCE(lag(a.actual_meals_salad) OVER w1, CAST(0 AS DOUBLE)) AS predicted_meals_salad,
       CAST(a.date - 7 AS TIMESTAMP) AS prediction_timestamp,
       CASE WHEN day(a.date) = 15 THEN CAST(COALESCE(ceil(avg(a.actual_meals) OVER w4), 7) AS BIGINT) + 2 END
         AS override_meal_prediction
FROM actual_sales a
WINDOW w4 AS (PARTITION BY isodow(a.date) ORDER BY a.date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING),
       w1 AS (PARTITION BY isodow(a.date) ORDER BY a.date)""",
    "predictions": f"""
SELECT b.date, b.weekday, b.month, b.day_theme, w.temperature_max, w.weather_condition,
       COALESCE(h.is_bridge_day, false) AS is_bridge_day,
       COALESCE(h.is_school_break, false) AS is_school_break,
       COALESCE(h.description, '') AS holiday_desc,
       b.predicted_meals,
       CAST(ceil(CAST(COALESCE(b.override_meal_prediction, b.predicted_meals) AS DOUBLE)
                 * COALESCE(r.veg_ratio, {ratio_fallback("b.day_theme", 0)})) AS BIGINT) AS predicted_meals_veg,
       COALESCE(b.override_meal_prediction, b.predicted_meals)
         - CAST(ceil(CAST(COALESCE(b.override_meal_prediction, b.predicted_meals) AS DOUBLE)
                 * COALESCE(r.veg_ratio, {ratio_fallback("b.day_theme", 0)})) AS BIGINT) AS predicted_meals_non_veg,
       b.predicted_meals_salad, b.prediction_timestamp,
       b.override_meal_prediction,
       CASE WHEN b.override_meal_prediction IS NOT NULL THEN 'Event' END AS override_reason,
       COALESCE(b.override_meal_prediction, b.predicted_meals) AS final_prediction
FROM pred_base b
LEFT JOIN weather w ON w.date = b.date
LEFT JOIN holidays h ON h.date = b.date
LEFT JOIN theme_ratio r ON r.day_theme = b.day_theme""",
    "site_ratio": f"""
SELECT site_id, day_theme,
       avg_veg / NULLIF(avg_veg + avg_non_veg, 0) AS veg_ratio
FROM (SELECT site_id, {theme_case("date")} AS day_theme,
             avg(actual_meals_veg) AS avg_veg, avg(actual_meals_non_veg) AS avg_non_veg
      FROM site_sales
      WHERE actual_meals_veg IS NOT NULL AND actual_meals_non_veg IS NOT NULL
        AND {theme_case("date")} IS NOT NULL
      GROUP BY 1, 2) t""",
    "site_predictions": f"""
SELECT b.site_id, b.date, b.day_theme, b.predicted_meals,
       CAST(ceil(CAST(b.predicted_meals AS DOUBLE)
                 * COALESCE(r.veg_ratio, {ratio_fallback("b.day_theme", 0)})) AS BIGINT) AS predicted_meals_veg,
       b.predicted_meals - CAST(ceil(CAST(b.predicted_meals AS DOUBLE)
                 * COALESCE(r.veg_ratio, {ratio_fallback("b.day_theme", 0)})) AS BIGINT) AS predicted_meals_non_veg,
       b.predicted_meals_salad, b.prediction_timestamp, b.predicted_meals AS final_prediction
FROM (SELECT s.site_id, s.date, {theme_case("s.date")} AS day_theme,
             CAST(COALESCE(ceil(avg(s.actual_meals) OVER w4), 7) AS BIGINT) AS predicted_meals,
             COALESCE(lag(s.actual_meals_salad) OVER w1, CAST(0 AS DOUBLE)) AS predicted_meals_salad,
             CAST(s.date - 7 AS TIMESTAMP) AS prediction_timestamp
      FROM site_sales s
      WINDOW w4 AS (PARTITION BY s.site_id, isodow(s.date) ORDER BY s.date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING),
             w1 AS (PARTITION BY s.site_id, isodow(s.date) ORDER BY s.date)) b
LEFT JOIN site_ratio r ON r.site_id = b.site_id AND r.day_theme = b.day_theme""",
}


def with_views(sql: str) -> str:
    ctes = ",\n".join(f"{name} AS ({body}\n)" for name, body in VIEWS.items())
    return f"WITH {ctes}\n{sql}"
