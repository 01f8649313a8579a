"""Queries: labels, display formats, reports and rule-based insights
(SRC-6, SRC-7, SRC-8, SRC-11, JON-6, FN-7, FN-8, FN-9, FN-11, FN-13, SNK-6,
SNK-9, SNK-10, AIM-3...6, FLOW-6)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from platewise import fixtures as fx
from platewise.constants import GERMAN_MONTHS, GERMAN_MONTHS_SHORT, GERMAN_WEEKDAYS, GERMAN_WEEKDAYS_SHORT, LABELS
from platewise.fixtures_sql import q, theme_case
from platewise.functions.calendar import date_label
from platewise.functions.formats import day_label, thousands
from platewise.functions.weather import weather_label
from platewise.operators import compare as C
from platewise.operators import insights as INS
from platewise.operators import labels as LB
from platewise.plans.catalog import register
from platewise.schemas import PREDICTIONS, PREDICTIONS_BASE
from platewise.session import scratch_dir
from platewise.sinks import reports as REP
from platewise.sources import tables as TB

_PA = "FROM predictions p JOIN actual_sales a ON p.date = a.date"


def _labels_sql() -> str:
    rows = ", ".join(f"({q(layer)}, {prec}, {q(lang)}, {q(sec)}, {q(key)}, {q(label)})"
                     for layer, prec, lang, sec, key, label in LB.label_rows())
    return f"""
, ui_labels AS (SELECT * FROM (VALUES {rows}) t(layer, precedence, lang, section, key, label)),
eff AS (SELECT lang, section, key, label FROM ui_labels WHERE layer IN ('common', 'predictions')
        QUALIFY precedence = max(precedence) OVER (PARTITION BY lang, section))"""


def _lookup(lang: str, section: str, key_expr: str) -> str:
    return (f"(SELECT label FROM eff WHERE lang = {q(lang)} AND section = {q(section)} "
            f"AND key = {key_expr})")


def _eff(spark):
    return LB.effective_labels(LB.label_table(spark), page="predictions")


# --- SRC-8 / JON-6 ------------------------------------------------------------------
@register("jon_translate", _labels_sql() + f"""
SELECT date,
       {_lookup("DE", "weather_condition", "lower(weather_condition)")} AS weather_condition_label,
       {_lookup("DE", "day_themes", "day_theme")} AS day_theme_label,
       COALESCE({_lookup("DE", "holiday_descriptions", "holiday_desc")}, holiday_desc) AS holiday_desc_label
FROM predictions""")
def jon_translate(spark, sf):
    """SRC-8 + JON-6: German labels for every stored prediction; weather and
    theme miss -> null (``Sunny`` has no label, Q11), holiday miss -> text."""
    def section(name):
        return LB.label_map(LABELS, "DE", name, "predictions")

    return fx.predictions(spark, sf).select(
        "date", LB.lookup(F.lower("weather_condition"), section("weather_condition")).alias("weather_condition_label"),
        LB.lookup(F.col("day_theme"), section("day_themes")).alias("day_theme_label"),
        LB.lookup(F.col("holiday_desc"), section("holiday_descriptions"), "key").alias("holiday_desc_label"))


#: Dictionaries whose page has one section of the common one, without some of its keys.
LABEL_FILES = {
    "common": {"EN": {"weather_condition": {c: f"{c} (common)" for c in ("Sunny", "Rainy", "Stormy")},
                      "day_themes": {"Fish": "Fish day", "Vital": "Green day"}}},
    "plan": {"EN": {"weather_condition": {"Rainy": "Umbrella", "Snowy": "Sledge"}}},
}


@register("src_label_files", """
SELECT date, CASE weather_condition WHEN 'Rainy' THEN 'Umbrella' WHEN 'Snowy' THEN 'Sledge' END AS weather_label,
       CASE day_theme WHEN 'Fish' THEN 'Fish day' WHEN 'Vital' THEN 'Green day' ELSE day_theme END AS theme_label
FROM predictions""")
def src_label_files(spark, sf):
    """SRC-8 + JON-6: dictionaries read from files; the page's section stands
    in place of the common one, so what only the latter has is a miss."""
    root = scratch_dir(spark, "labels")
    for layer, doc in LABEL_FILES.items():
        spark.createDataFrame([(json.dumps(doc),)], "value string").write.text(f"{root}/{layer}")
    layers = LB.read_label_files(spark, {layer: f"{root}/{layer}" for layer in LABEL_FILES})
    labels = LB.effective_labels(LB.label_table(spark, layers), page="plan")
    p = LB.translate(fx.predictions(spark, sf), "weather_condition", labels, "EN", "weather_condition", out="weather_label")
    theme = LB.lookup(F.col("day_theme"), LB.label_map(layers, "EN", "day_themes", "plan"), "key")
    return p.select("date", "weather_label", theme.alias("theme_label"))


# --- FN-7 -------------------------------------------------------------------------------
def _de_case(mapping: dict, expr: str) -> str:
    arms = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {arms} END)"


_DE_WD = _de_case(GERMAN_WEEKDAYS, "dayname(date)")
_DE_WDS = _de_case(GERMAN_WEEKDAYS_SHORT, "dayname(date)")
_DE_MON = _de_case(GERMAN_MONTHS, "monthname(date)")
_DE_MONS = _de_case(GERMAN_MONTHS_SHORT, "monthname(date)")

STYLES = ["long", "peak", "chart", "table", "compare", "compact"]


@register("fn_date_labels", f"""
SELECT date,
       strftime(date, '%A, %d. %B') AS en_long, strftime(date, '%a, %b %d') AS en_peak,
       strftime(date, '%a %d/%m') AS en_chart, strftime(date, '%a, %d. %B') AS en_table,
       strftime(date, '%a %m/%d') AS en_compare, strftime(date, '%a, %d.%B') AS en_compact,
       {_DE_WD} || ', ' || strftime(date, '%d') || '. ' || {_DE_MON} AS de_long,
       {_DE_WDS} || ', ' || {_DE_MONS} || ' ' || strftime(date, '%d') AS de_peak,
       {_DE_WDS} || ' ' || strftime(date, '%d/%m') AS de_chart,
       {_DE_WDS} || ', ' || strftime(date, '%d') || '. ' || {_DE_MON} AS de_table,
       {_DE_WDS} || ' ' || strftime(date, '%m/%d') AS de_compare,
       {_DE_WDS} || ', ' || strftime(date, '%d') || '.' || {_DE_MON} AS de_compact,
       strftime(prediction_timestamp, '%Y-%m-%d %H:%M') AS stamp
FROM predictions""")
def fn_date_labels(spark, sf):
    """FN-7: every display date format, English and German."""
    p = fx.predictions(spark, sf)
    cols = [date_label("date", s, "EN").alias(f"en_{s}") for s in STYLES]
    cols += [date_label("date", s, "DE").alias(f"de_{s}") for s in STYLES]
    return p.select("date", *cols, date_label("prediction_timestamp", "stamp").alias("stamp"))


# --- FN-8 / FN-9 ---------------------------------------------------------------------------
_GEN = LABELS["common"]["DE"]["generic"]


@register("fn_day_label", _labels_sql() + f"""
, t AS (SELECT date, is_school_break, is_bridge_day,
               NULLIF(COALESCE({_lookup("DE", "holiday_descriptions", "holiday_desc")}, holiday_desc), '') AS txt
        FROM predictions)
SELECT date,
       CASE WHEN is_school_break THEN COALESCE(txt, {q(_GEN["is_school_break"])})
            WHEN is_bridge_day THEN COALESCE(txt, {q(_GEN["bridge_day"])})
            ELSE txt END AS day_label
FROM t""")
def fn_day_label(spark, sf):
    """FN-8: one badge text per day (German)."""
    p = fx.predictions(spark, sf).select("date", "is_school_break", "is_bridge_day", "holiday_desc")
    p = LB.translate(p, "holiday_desc", _eff(spark), "DE", "holiday_descriptions", on_miss="key", out="_tr")
    return p.select("date", day_label("is_school_break", "is_bridge_day", "holiday_desc", F.col("_tr"),
                                      _GEN["is_school_break"], _GEN["bridge_day"]).alias("day_label"))


@register("fn_weather_label", _labels_sql() + f"""
SELECT date,
       CASE WHEN temperature_max IS NOT NULL AND temperature_max <> 0
            THEN weather_icon || CAST(temperature_max AS VARCHAR) || '°C ' ||
                 COALESCE({_lookup("DE", "weather_condition", "lower(weather_condition)")}, lower(weather_condition))
       END AS weather_label
FROM weather""")
def fn_weather_label(spark, sf):
    """FN-9: the weather badge of every day, ``🌧️22.5°C Regen``; unknown
    conditions keep their lower-case key (``sunny``)."""
    w = fx.weather(spark, sf).select("date", "weather_icon", "temperature_max",
                                     F.lower("weather_condition").alias("cond"))
    w = LB.translate(w, "cond", _eff(spark), "DE", "weather_condition", on_miss="key", out="cond_label")
    return w.select("date", weather_label("temperature_max", "cond_label", "weather_icon").alias("weather_label"))


# --- FN-11 ---------------------------------------------------------------------------------
@register("fn_formats", f"""
, k AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month_start, CAST(sum(final_prediction) AS BIGINT) AS total
        FROM predictions GROUP BY 1),
d AS (SELECT CAST(date_trunc('month', p.date) AS DATE) AS month_start,
             count(*) FILTER (WHERE p.final_prediction > a.actual_meals) AS over_n,
             count(*) FILTER (WHERE p.final_prediction < a.actual_meals) AS under_n
      {_PA} GROUP BY 1)
SELECT k.month_start, format('{{:,}}', k.total) AS total_text,
       printf('%+d', d.over_n - d.under_n) AS balance_text
FROM k JOIN d ON k.month_start = d.month_start""")
def fn_formats(spark, sf):
    """FN-11: thousands separators and signed counts for the KPI tiles."""
    a = fx.actual_sales(spark, sf)
    p = fx.predictions(spark, sf, a).withColumn("month_start", F.date_trunc("month", "date").cast("date"))
    k = C.forecast_kpis(p, by=["month_start"]).select("month_start", thousands("total_meals").alias("total_text"))
    j = C.join_actuals(p, a).withColumn("month_start", F.date_trunc("month", "date").cast("date"))
    m = C.metrics(j, by=["month_start"])
    m = m.select("month_start", F.format_string("%+d", F.col("over_predicted") - F.col("under_predicted"))
                 .alias("balance_text"))
    return k.join(m, "month_start")


# --- AIM-3 / FN-13 ---------------------------------------------------------------------------
_LONG_SQL = f"""
, j AS (SELECT CAST(date_trunc('month', p.date) AS DATE) AS month, dayname(p.date) AS weekday,
               a.actual_meals, p.final_prediction, a.actual_meals_veg, p.predicted_meals_veg,
               a.actual_meals_non_veg, p.predicted_meals_non_veg, a.actual_meals_salad, p.predicted_meals_salad
        {_PA}),
long AS (
  SELECT month, weekday, 'total' AS category, actual_meals AS au, final_prediction AS pu FROM j
  UNION ALL SELECT month, weekday, 'veg', actual_meals_veg, predicted_meals_veg FROM j
  UNION ALL SELECT month, weekday, 'non_veg', actual_meals_non_veg, predicted_meals_non_veg FROM j
  UNION ALL SELECT month, weekday, 'salad', CAST(round(actual_meals_salad * 100) AS BIGINT),
                   CAST(round(predicted_meals_salad * 100) AS BIGINT) FROM j),
g AS (SELECT month, weekday, category, count(*) AS days, CAST(sum(au) AS BIGINT) AS actual_units,
             CAST(sum(pu) AS BIGINT) AS predicted_units,
             CAST(sum(au) - sum(pu) AS DOUBLE) / CAST(NULLIF(sum(pu), 0) AS DOUBLE) AS rel_bias
      FROM long GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY abs(rel_bias) DESC NULLS LAST, weekday, category) AS rank
      FROM g)"""


@register("aim_bias_insights", _LONG_SQL + """
SELECT month, CAST(rank AS INTEGER) AS rank, weekday, category, days, actual_units, predicted_units, rel_bias,
       CASE WHEN rel_bias IS NULL THEN 'info' WHEN abs(rel_bias) > 0.05 THEN 'error'
            WHEN abs(rel_bias) >= 0.03 THEN 'warning' WHEN abs(rel_bias) < 0.01 THEN 'success' ELSE 'info' END AS type,
       weekday || ' ' || category AS title,
       printf('%s %s: %s by %+d%% over %d days', weekday, category,
              CASE WHEN rel_bias > 0 THEN 'under-forecast' WHEN rel_bias < 0 THEN 'over-forecast' ELSE 'on target' END,
              COALESCE(CAST(round_even(rel_bias * 100, 0) AS INTEGER), 0), days) AS message
FROM r WHERE rank <= 3""")
def aim_bias_insights(spark, sf):
    """AIM-3: the three worst weekday x category biases of every month."""
    a = fx.actual_sales(spark, sf)
    j = C.join_actuals(fx.predictions(spark, sf, a), a)
    j = j.withColumn("month", F.date_trunc("month", "date").cast("date"))
    return INS.bias_insights(j, period="month", by=["weekday"])


def insight_documents(spark, sf):
    """Insight responses as text, one per month, in the shapes a model
    returns: plain JSON, JSON in a code fence (even months), and text without
    its closing bracket (every third month) that must fall back to the whole
    raw message."""
    ins = aim_bias_insights(spark, sf)
    g = ins.groupBy("month").agg(F.sort_array(F.collect_list(F.struct("rank", "type", "title", "message")))
                                 .alias("items"))
    body = F.to_json(F.transform("items", lambda x: F.struct(x["type"].alias("type"), x["title"].alias("title"),
                                                              x["message"].alias("message"))))
    g, m = g.select("month", body.alias("body")), F.month("month")
    text = (F.when(m % 3 == 0, F.expr("substring(body, 1, length(body) - 1)"))
             .when(m % 2 == 0, F.concat(F.lit("```json\n"), F.col("body"), F.lit("\n```")))
             .otherwise(F.col("body")))
    return g.select("month", text.alias("response"))


_INSIGHT_ROWS = _LONG_SQL + """,
ins AS (
  SELECT month, CAST(rank AS INTEGER) AS rank,
         CASE WHEN rel_bias IS NULL THEN 'info' WHEN abs(rel_bias) > 0.05 THEN 'error'
              WHEN abs(rel_bias) >= 0.03 THEN 'warning' WHEN abs(rel_bias) < 0.01 THEN 'success' ELSE 'info' END AS type,
         weekday || ' ' || category AS title,
         printf('%s %s: %s by %+d%% over %d days', weekday, category,
                CASE WHEN rel_bias > 0 THEN 'under-forecast' WHEN rel_bias < 0 THEN 'over-forecast' ELSE 'on target' END,
                COALESCE(CAST(round_even(rel_bias * 100, 0) AS INTEGER), 0), days) AS message
  FROM r WHERE rank <= 3),
docs AS (
  SELECT month, to_json(list({'type': type, 'title': title, 'message': message} ORDER BY rank)) AS body
  FROM ins GROUP BY month)"""


@register("fn_parse_insights", _INSIGHT_ROWS + """
SELECT i.month, i.type, i.title, i.message FROM ins i WHERE month(i.month) % 3 <> 0
UNION ALL
SELECT month, 'info', CAST(NULL AS VARCHAR), substr(body, 1, length(body) - 1) FROM docs WHERE month(month) % 3 = 0""")
def fn_parse_insights(spark, sf):
    """FN-13: strip fences, parse the insight array; unparseable text is kept
    as one raw ``info`` message."""
    from platewise.functions.formats import parse_insights
    docs = insight_documents(spark, sf)
    return docs.select("month", F.inline(parse_insights("response")))


# --- AIM-4 / AIM-5 / AIM-6 -------------------------------------------------------------------
def _anomalies_sql(forecast: str, history: str, keys: tuple[str, ...] = ()) -> str:
    """AIM-4 for a forecast and a history view with the same conditions."""
    k, using = "".join(f"{c}, " for c in keys), ", ".join([*keys, "day_theme"])
    return f"""
cell AS (SELECT {k}day_theme, weather_condition, day_kind, count(*) AS n, CAST(sum(actual_meals) AS BIGINT) AS s,
                CAST(sum(actual_meals * actual_meals) AS BIGINT) AS ss
         FROM {history} WHERE day_theme IS NOT NULL AND actual_meals IS NOT NULL GROUP BY ALL),
theme AS (SELECT {k}day_theme, CAST(sum(s) AS DOUBLE) / sum(n) AS theme_mean,
                 sqrt(CAST(sum(ss - CAST(s AS DOUBLE) * s / n) AS DOUBLE) / NULLIF(sum(n) - count(*), 0)) AS spread
          FROM cell GROUP BY ALL),
e AS (SELECT f.*, (COALESCE(CAST(c.s AS DOUBLE), 0) + {INS.SHRINKAGE} * t.theme_mean) / (COALESCE(c.n, 0) + {INS.SHRINKAGE}) AS expected,
             t.spread, CAST(date_trunc('week', f.date) AS DATE) AS week_start
      FROM {forecast} f LEFT JOIN theme t USING ({using})
      LEFT JOIN cell c ON {"".join(f"c.{x} = f.{x} AND " for x in keys)}c.day_theme = f.day_theme
        AND c.weather_condition IS NOT DISTINCT FROM f.weather_condition AND c.day_kind = f.day_kind),
z AS (SELECT *, round((final_prediction - expected) / NULLIF(spread, 0), 4) AS z FROM e),
why AS (SELECT *, concat_ws(', ', CASE WHEN z > 2.0 THEN 'more than such days had' WHEN z < -2.0 THEN 'less than such days had' END,
                            CASE WHEN day_kind <> 'normal' THEN day_kind END,
                            CASE WHEN weather_condition IN ('Rainy', 'Snowy', 'Stormy') THEN 'bad weather' END) AS reasons FROM z),
r AS (SELECT *, row_number() OVER (PARTITION BY {k}week_start ORDER BY COALESCE(abs(z), 0) DESC, date) AS rank
      FROM why WHERE reasons <> '')
SELECT {k}week_start, CAST(rank AS INTEGER) AS rank, date, day_theme, final_prediction, round(expected, 4) AS expected, z, reasons
FROM r WHERE rank <= 3"""


_DAY_KIND = "CASE WHEN {b} THEN 'school break' WHEN {d} THEN 'bridge day' ELSE 'normal' END AS day_kind"


@register("aim_plan_anomalies", f"""
, past AS (SELECT a.date, a.actual_meals, {theme_case("a.date")} AS day_theme, w.weather_condition,
                  {_DAY_KIND.format(b="COALESCE(h.is_school_break, false)", d="COALESCE(h.is_bridge_day, false)")}
           FROM actual_sales a LEFT JOIN weather w ON a.date = w.date LEFT JOIN holidays h ON a.date = h.date),
plan AS (SELECT date, day_theme, final_prediction, weather_condition,
                {_DAY_KIND.format(b="COALESCE(is_school_break, false)", d="COALESCE(is_bridge_day, false)")} FROM predictions),
""" + _anomalies_sql("plan", "past"))
def aim_plan_anomalies(spark, sf):
    """AIM-4: up to three days per planning week worth a second look, against
    what days of the same theme, weather and kind had."""
    a = fx.actual_sales(spark, sf)
    p = fx.predictions(spark, sf, a).withColumn("week_start", F.date_trunc("week", "date").cast("date"))
    return INS.plan_anomalies(p, conditions(spark, sf, a))


def conditions(spark, sf, days):
    """``days`` with their theme, weather and day flags."""
    from platewise.functions.calendar import day_theme
    from platewise.operators import features as FE
    x = FE.join_holidays(days, fx.holidays(spark, sf), ["date"]).drop("holiday_desc", "is_bank_holiday")
    return FE.join_weather(x, fx.weather(spark, sf), ["date"], columns=("weather_condition",)).withColumn(
        "day_theme", day_theme("date"))


_PATTERN_SQL = """
, j AS (SELECT CAST(date_trunc('month', p.date) AS DATE) AS month, p.weekday, p.day_theme,
               CASE WHEN p.is_school_break THEN 'school break' WHEN p.is_bridge_day THEN 'bridge day'
                    WHEN p.holiday_desc <> '' THEN 'holiday' ELSE 'normal' END AS day_kind,
               a.actual_meals, p.final_prediction, a.actual_meals_veg, p.predicted_meals_veg, a.actual_meals_non_veg,
               p.predicted_meals_non_veg, a.actual_meals_salad, p.predicted_meals_salad
        FROM predictions p JOIN actual_sales a ON p.date = a.date),
v AS (SELECT *, CASE WHEN final_prediction * n * 5 < total * 4 THEN 'low' WHEN final_prediction * n * 5 > total * 6 THEN 'high'
                     ELSE 'usual' END AS volume
      FROM j JOIN (SELECT month, count(*) AS n, CAST(sum(final_prediction) AS BIGINT) AS total FROM j GROUP BY month) m USING (month)),
l AS (SELECT month, weekday, day_theme, day_kind, volume, c.category,
             CASE c.category WHEN 'total' THEN actual_meals WHEN 'veg' THEN actual_meals_veg WHEN 'non_veg' THEN actual_meals_non_veg
                  ELSE CAST(round(actual_meals_salad * 100) AS BIGINT) END AS ac,
             CASE c.category WHEN 'total' THEN final_prediction WHEN 'veg' THEN predicted_meals_veg WHEN 'non_veg' THEN predicted_meals_non_veg
                  ELSE CAST(round(predicted_meals_salad * 100) AS BIGINT) END AS pr
      FROM v, (VALUES ('total'), ('veg'), ('non_veg'), ('salad')) c(category)),
g AS (SELECT month, category, weekday, day_theme, day_kind, volume,
             grouping(weekday) AS gw, grouping(day_theme) AS gt, grouping(day_kind) AS gk, grouping(volume) AS gv,
             count(*) AS days, CAST(sum(pr) AS BIGINT) AS predicted_units, CAST(sum(ac - pr) AS BIGINT) AS s,
             CAST(sum((ac - pr) * (ac - pr)) AS BIGINT) AS ss
      FROM l GROUP BY GROUPING SETS ((month, category), (month, category, weekday), (month, category, day_theme),
                                     (month, category, day_kind), (month, category, volume))),
t AS (SELECT month, category,
             CASE WHEN gw = 0 THEN 'weekday' WHEN gt = 0 THEN 'day_theme' WHEN gk = 0 THEN 'day_kind' WHEN gv = 0 THEN 'volume' ELSE 'all' END AS pattern,
             CASE WHEN gw = 0 THEN weekday WHEN gt = 0 THEN day_theme WHEN gk = 0 THEN day_kind WHEN gv = 0 THEN volume ELSE 'all days' END AS value,
             days, s AS bias_units, CAST(s AS DOUBLE) / NULLIF(predicted_units, 0) AS rel_bias,
             CASE WHEN days > 1 THEN round(CAST(s AS DOUBLE) / sqrt(NULLIF((CAST(ss AS DOUBLE) * days - CAST(s AS DOUBLE) * s) / (days - 1), 0)), 4) END AS t
      FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY abs(t) DESC, pattern, value, category) AS rank FROM t WHERE abs(t) >= 2)
SELECT month, CAST(rank AS INTEGER) AS rank, pattern, value, category, days, bias_units, rel_bias, t,
       CASE WHEN rel_bias IS NULL THEN 'info' WHEN abs(rel_bias) > 0.05 THEN 'error'
            WHEN abs(rel_bias) >= 0.03 THEN 'warning' WHEN abs(rel_bias) < 0.01 THEN 'success' ELSE 'info' END AS type
FROM r WHERE rank <= 3"""


@register("aim_bias_patterns", _PATTERN_SQL)
def aim_bias_patterns(spark, sf):
    """AIM-3: of every month the three most significant patterns among all
    days, weekdays, themes, kinds of day and volume bands, for each category."""
    a = fx.actual_sales(spark, sf)
    p = fx.predictions(spark, sf, a)
    kind = (F.when(F.col("is_school_break"), "school break").when(F.col("is_bridge_day"), "bridge day")
            .when(F.col("holiday_desc") != "", "holiday").otherwise("normal"))
    j = C.join_actuals(p, a).join(p.select("date", kind.alias("day_kind")), "date")
    return INS.bias_patterns(j.withColumn("month", F.date_trunc("month", "date").cast("date")))


def _series_sql() -> str:
    parts = []
    for name, (a, p, _) in INS.CATEGORY_COLUMNS.items():
        parts.append(f"SELECT p.date, 'predicted_{name}' AS series, CAST(p.{p} AS DOUBLE) AS value {_PA}")
        parts.append(f"SELECT p.date, 'actual_{name}', CAST(a.{a} AS DOUBLE) {_PA}")
        parts.append(f"SELECT p.date, 'difference_{name}', CAST(a.{a} - p.{p} AS DOUBLE) {_PA}")
    return "\n" + "\nUNION ALL ".join(parts)


@register("aim_series_long", _series_sql())
def aim_series_long(spark, sf):
    """AIM-5: long-form chart data (predicted / actual / difference x 4)."""
    a = fx.actual_sales(spark, sf)
    return INS.series_long(C.join_actuals(fx.predictions(spark, sf, a), a))


HEALTH_AS_OF = "2001-12-31"


@register("aim_health", "\n" + "\nUNION ALL ".join(
    f"SELECT {q(t)} AS table_name, count(*) AS rows, min(date) AS first_date, max(date) AS last_date, "
    f"CAST(DATE '{HEALTH_AS_OF}' - max(date) AS INTEGER) AS days_since_last, "
    f"{'max(prediction_timestamp)' if t == 'predictions' else 'CAST(NULL AS TIMESTAMP)'} AS last_batch FROM {t}"
    for t in ("predictions", "actual_sales", "holidays")) + f"""
UNION ALL
SELECT 'model', count(*), min(a.date), max(a.date), CAST(DATE '{HEALTH_AS_OF}' - max(a.date) AS INTEGER),
       CAST(max(a.date) AS TIMESTAMP)
FROM actual_sales a JOIN weather w ON a.date = w.date
WHERE w.temperature_max IS NOT NULL AND w.weather_condition IS NOT NULL""")
def aim_health(spark, sf):
    """AIM-6: row counts and freshness of every table, and of the published
    model: the rows and days it learned from and its training time (SRC-9)."""
    from platewise.plans.q_ml import published_model
    a = fx.actual_sales(spark, sf)
    tables = INS.health({"predictions": fx.predictions(spark, sf, a), "actual_sales": a,
                         "holidays": fx.holidays(spark, sf)}, HEALTH_AS_OF)
    return tables.unionByName(INS.model_health(spark, f"{published_model(spark, sf)}/model_metadata.json", HEALTH_AS_OF))


# --- SNK-6 / SNK-9 / SNK-10 ------------------------------------------------------------------
@register("snk_csv_norm", """
SELECT strftime(date, '%Y-%m-%d') AS date, actual_meals FROM actual_sales""")
def snk_csv_norm(spark, sf):
    """SNK-6: ``MM/dd/yy`` history rewritten with ISO dates (1995-1999 keep
    their century: POSIX two-digit-year pivot)."""
    a = fx.actual_sales(spark, sf).select(F.date_format("date", "MM/dd/yy").alias("date"), "actual_meals")
    return REP.normalise_dates(a)


_REPORT_COLS = LABELS["predictions"]["EN"]["display_columns"]


@register("snk_report", _labels_sql() + f"""
SELECT strftime(date, '%a, %d. %B') AS "{_REPORT_COLS['date']}",
       {_lookup("EN", "day_themes", "day_theme")} AS "{_REPORT_COLS['day_theme']}",
       final_prediction AS "{_REPORT_COLS['final_prediction']}",
       predicted_meals_veg AS "{_REPORT_COLS['predicted_meals_veg']}",
       predicted_meals_non_veg AS "{_REPORT_COLS['predicted_meals_non_veg']}",
       predicted_meals_salad AS "{_REPORT_COLS['predicted_meals_salad']}"
FROM predictions""")
def snk_report(spark, sf):
    """SNK-9: the planning-table download (drop, keep, order, rename)."""
    p = fx.predictions(spark, sf)
    p = LB.translate(p, "day_theme", _eff(spark), "EN", "day_themes", out="_theme")
    p = p.withColumn("day_theme", F.col("_theme")).drop("_theme")
    p = p.orderBy("date").withColumn("date", date_label("date", "table", "EN"))  # SRT-1: date order
    return REP.report_table(p, _REPORT_COLS)


@register("snk_report_cells", """
SELECT a.date AS "Day", 'sold ' || a.actual_meals || ' of' || chr(32) || chr(32) || 'the day' AS "Note" FROM actual_sales a""")
def snk_report_cells(spark, sf):
    """FN-12 / PRJ-10: line breaks in a report's text cells become spaces; a
    display column that the table lacks is left out."""
    a = fx.actual_sales(spark, sf)
    note = F.concat(F.lit("sold "), F.col("actual_meals").cast("string"), F.lit(" of\r\nthe day"))
    return REP.report_table(a.select("date", note.alias("note")), {"date": "Day", "missing": "Missing", "note": "Note"})


@register("snk_json_payload", """
, w AS (SELECT CAST(date_trunc('week', date) AS DATE) AS week_start, date, day_theme, final_prediction,
               predicted_meals_veg, predicted_meals_non_veg FROM predictions)
SELECT week_start,
       '[' || string_agg(to_json({'week_start': week_start, 'date': date, 'day_theme': day_theme,
                                  'final_prediction': final_prediction, 'predicted_meals_veg': predicted_meals_veg,
                                  'predicted_meals_non_veg': predicted_meals_non_veg}), ',' ORDER BY date) || ']'
         AS json
FROM w GROUP BY week_start""")
def snk_json_payload(spark, sf):
    """SNK-10: one JSON array of forecast rows per planning week."""
    p = fx.predictions(spark, sf).withColumn("week_start", F.date_trunc("week", "date").cast("date"))
    return REP.json_payload(p.select("week_start", "date", "day_theme", "final_prediction",
                                     "predicted_meals_veg", "predicted_meals_non_veg"), group=["week_start"])


# --- SRC-6 / SRC-7 / SRC-11 --------------------------------------------------------------------
PRIORITY_CATEGORY = [("1-URGENT", "veg"), ("2-HIGH", "veg"), ("3-MEDIUM", "non_veg"),
                     ("4-NOT SPECIFIED", "non_veg"), ("5-LOW", "non_veg")]


@register("src_values", "\n, m AS (SELECT * FROM (VALUES " +
          ", ".join(f"({q(a)}, {q(b)})" for a, b in PRIORITY_CATEGORY) + """) t(priority, category))
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, m.category, count(*) AS orders
FROM orders o JOIN m ON o.o_orderpriority = m.priority GROUP BY 1, 2""")
def src_values(spark, sf):
    """SRC-6: an inline VALUES table (priority -> meal category) joined to orders."""
    m = TB.values(spark, PRIORITY_CATEGORY, "priority string, category string")
    o = fx.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), "o_orderpriority")
    j = o.join(F.broadcast(m), o.o_orderpriority == m.priority)
    return j.groupBy("year", "category").agg(F.count(F.lit(1)).alias("orders"))


@register("src_themes", """
, d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT d.date, dayname(d.date) AS weekday, """ + theme_case("d.date") + """ AS day_theme,
       CASE isodow(d.date) WHEN 1 THEN 0.5 WHEN 2 THEN 0.43 WHEN 3 THEN 0.43 WHEN 4 THEN 0.37 ELSE 0.5 END::DOUBLE AS veg_ratio,
       CASE isodow(d.date) WHEN 1 THEN 0.5 WHEN 2 THEN 0.57 WHEN 3 THEN 0.57 WHEN 4 THEN 0.63 ELSE 0.5 END::DOUBLE AS non_veg_ratio
FROM d WHERE isodow(d.date) <= 5""")
def src_themes(spark, sf):
    """SRC-7: the fixed theme dimension joined to every order day."""
    from platewise.functions.calendar import weekday_name
    d = fx.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    d = d.withColumn("weekday", weekday_name("date"))
    return d.join(F.broadcast(TB.themes(spark)), "weekday")


@register("src_schema_evolve", "\nSELECT " + ", ".join(
    (c if c in PREDICTIONS_BASE.names else
     f"CAST(NULL AS {dict(double='DOUBLE', bigint='BIGINT', string='VARCHAR')[PREDICTIONS[c].dataType.simpleString()]}) AS {c}")
    for c in PREDICTIONS.names) + " FROM predictions")
def src_schema_evolve(spark, sf):
    """SRC-11: a table version written before three columns were added, read
    under the current schema (added columns are typed nulls)."""
    old = fx.predictions(spark, sf).select(*PREDICTIONS_BASE.names)
    return TB.evolve(old, PREDICTIONS)


# --- FLOW-6 --------------------------------------------------------------------------------------
DASH_AS_OF = "2000-01-05"


@register("flow_dashboard", _labels_sql() + f"""
, f AS (SELECT *, CAST(date_trunc('week', date) AS DATE) AS week_start FROM predictions
        WHERE date >= CAST(date_trunc('week', DATE '{DASH_AS_OF}') AS DATE)),
k AS (SELECT week_start, CAST(sum(final_prediction) AS BIGINT) AS week_total,
             CAST(trunc(avg(final_prediction)) AS BIGINT) AS week_daily_avg,
             arg_max(date, final_prediction * 100000 - (date - DATE '1970-01-01')) AS peak_date
      FROM f GROUP BY 1)
SELECT f.date, f.week_start, strftime(f.date, '%a, %d. %B') AS date_label,
       {_lookup("DE", "day_themes", "f.day_theme")} AS theme_label,
       f.final_prediction, f.predicted_meals_veg, f.predicted_meals_non_veg, f.predicted_meals_salad,
       {_lookup("DE", "weather_condition", "lower(f.weather_condition)")} AS weather_label,
       strftime(f.prediction_timestamp, '%Y-%m-%d %H:%M') AS updated,
       k.week_total, k.week_daily_avg, k.peak_date
FROM f JOIN k ON f.week_start = k.week_start""")
def flow_dashboard(spark, sf):
    """FLOW-6: forecasts from Monday of the as-of week on, with the week's
    KPI tiles (total, daily mean, peak day) and the labelled table."""
    p = C.from_week_start(fx.predictions(spark, sf), DASH_AS_OF)
    p = p.withColumn("week_start", F.date_trunc("week", "date").cast("date"))
    k = C.forecast_kpis(p, by=["week_start"], with_peak=True).select(
        "week_start", F.col("total_meals").alias("week_total"), F.col("avg_meals_display").alias("week_daily_avg"),
        "peak_date")
    labels = _eff(spark)
    t = LB.translate(p, "day_theme", labels, "DE", "day_themes", out="theme_label")
    t = LB.translate(t, "weather_condition", labels, "DE", "weather_condition", out="weather_label",
                     lower_key=True)
    t = t.select("date", "week_start", date_label("date", "table", "EN").alias("date_label"), "theme_label",
                 "final_prediction", "predicted_meals_veg", "predicted_meals_non_veg", "predicted_meals_salad",
                 "weather_label", date_label("prediction_timestamp", "stamp").alias("updated"))
    return t.join(k, "week_start").orderBy("date")


@register("aim_bias_insights_site", f"""
, j AS (SELECT p.site_id, CAST(date_trunc('month', p.date) AS DATE) AS month, dayname(p.date) AS weekday,
               a.actual_meals, p.final_prediction, a.actual_meals_veg, p.predicted_meals_veg,
               a.actual_meals_non_veg, p.predicted_meals_non_veg, a.actual_meals_salad, p.predicted_meals_salad
        FROM site_predictions p JOIN site_sales a ON p.site_id = a.site_id AND p.date = a.date),
long AS (
  SELECT site_id, month, weekday, 'total' AS category, actual_meals AS au, final_prediction AS pu FROM j
  UNION ALL SELECT site_id, month, weekday, 'veg', actual_meals_veg, predicted_meals_veg FROM j
  UNION ALL SELECT site_id, month, weekday, 'non_veg', actual_meals_non_veg, predicted_meals_non_veg FROM j
  UNION ALL SELECT site_id, month, weekday, 'salad', CAST(round(actual_meals_salad * 100) AS BIGINT),
                   CAST(round(predicted_meals_salad * 100) AS BIGINT) FROM j),
g AS (SELECT site_id, month, weekday, category, count(*) AS days, CAST(sum(au) AS BIGINT) AS actual_units,
             CAST(sum(pu) AS BIGINT) AS predicted_units,
             CAST(sum(au) - sum(pu) AS DOUBLE) / CAST(NULLIF(sum(pu), 0) AS DOUBLE) AS rel_bias
      FROM long GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY site_id, month
                                   ORDER BY abs(rel_bias) DESC NULLS LAST, weekday, category) AS rank FROM g)
SELECT site_id, month, CAST(rank AS INTEGER) AS rank, weekday, category, days, actual_units, predicted_units,
       rel_bias,
       CASE WHEN rel_bias IS NULL THEN 'info' WHEN abs(rel_bias) > 0.05 THEN 'error'
            WHEN abs(rel_bias) >= 0.03 THEN 'warning' WHEN abs(rel_bias) < 0.01 THEN 'success' ELSE 'info' END AS type,
       weekday || ' ' || category AS title,
       printf('%s %s: %s by %+d%% over %d days', weekday, category,
              CASE WHEN rel_bias > 0 THEN 'under-forecast' WHEN rel_bias < 0 THEN 'over-forecast' ELSE 'on target' END,
              COALESCE(CAST(round_even(rel_bias * 100, 0) AS INTEGER), 0), days) AS message
FROM r WHERE rank <= 3""")
def aim_bias_insights_site(spark, sf):
    """AIM-3 per site: the three worst weekday x category biases of every
    (site, month); the window partitions by (site, month)."""
    keys = ["site_id", "date"]
    j = C.join_actuals(fx.site_predictions(spark, sf), fx.site_sales(spark, sf), keys=keys)
    j = j.withColumn("month", F.date_trunc("month", "date").cast("date"))
    return INS.bias_insights(j, period="month", by=["weekday"], site=["site_id"])


def _kpi_sql() -> str:
    from platewise.plans.q_analysis import _pop_sql
    body = _pop_sql("month")
    head, select = body.split("\nSELECT period_start, period_end, cur_rows AS rows", 1)
    pop = head + ",\npop AS (SELECT period_start, period_end, cur_rows AS rows" + select + ")"
    return pop + """
SELECT period_start,
       printf('%.1f', round_even(mae, 1)) AS mae_text,
       printf('%.1f%%', round_even(accuracy_rate, 1)) AS accuracy_text,
       CASE WHEN mae_delta IS NOT NULL THEN printf('%+.1f', round_even(mae_delta, 1)) END AS mae_delta_text,
       CASE WHEN over_delta IS NOT NULL THEN printf('%+d', over_delta) END AS over_delta_text
FROM pop"""


@register("fn_kpi_texts", _kpi_sql())
def fn_kpi_texts(spark, sf):
    """FN-11: the analysis page's KPI tile texts for every month: MAE and
    accuracy to one decimal (``12.3``, ``45.6%``) and signed deltas against
    the previous period (``+1.5``, ``-2``); no delta text without a previous
    period."""
    from platewise.functions.formats import one_decimal, signed_one_decimal
    a = fx.actual_sales(spark, sf)
    m = C.period_over_period_all(fx.predictions(spark, sf, a), a, unit="month")
    return m.select(
        "period_start",
        one_decimal("mae").alias("mae_text"),
        one_decimal("accuracy_rate", "%").alias("accuracy_text"),
        F.when(F.col("mae_delta").isNotNull(), signed_one_decimal("mae_delta")).alias("mae_delta_text"),
        F.when(F.col("over_delta").isNotNull(), F.format_string("%+d", F.col("over_delta"))).alias("over_delta_text"),
    )


@register("aim_plan_anomalies_site", f"""
, days AS (SELECT d.date, w.weather_condition,
                  {_DAY_KIND.format(b="COALESCE(h.is_school_break, false)", d="COALESCE(h.is_bridge_day, false)")}
           FROM (SELECT date FROM site_sales UNION SELECT date FROM site_predictions) d
           LEFT JOIN weather w ON d.date = w.date LEFT JOIN holidays h ON d.date = h.date),
past AS (SELECT s.site_id, s.actual_meals, {theme_case("s.date")} AS day_theme, d.weather_condition, d.day_kind
         FROM site_sales s JOIN days d ON s.date = d.date),
plan AS (SELECT p.site_id, p.date, p.day_theme, p.final_prediction, d.weather_condition, d.day_kind
         FROM site_predictions p JOIN days d ON p.date = d.date),
""" + _anomalies_sql("plan", "past", ("site_id",)))
def aim_plan_anomalies_site(spark, sf):
    """AIM-4 per site: up to three days per (site, planning week), against
    what the site's days of the same theme, weather and kind had."""
    p = conditions(spark, sf, fx.site_predictions(spark, sf).drop("day_theme"))
    p = p.withColumn("week_start", F.date_trunc("week", "date").cast("date"))
    return INS.plan_anomalies(p, conditions(spark, sf, fx.site_sales(spark, sf)), keys=["site_id", "date"])
