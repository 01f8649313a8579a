"""Deterministic views over the driver's test tables (Spark side).

The test tables hold no meals, so each operator reads one of these views,
derived by Spark from ``orders`` / ``customer`` / ``lineitem``; their work
grows with those tables. The same views are written in DuckDB SQL in
``platewise.fixtures_sql`` for the oracle.

| view          | from                 | definition |
| actual_sales  | orders               | per working day: meals = orders, veg = priority 1-URGENT / 2-HIGH,
|               |                      | non_veg = the rest, salad = round(sum price of status F / 100000, 2) |
| site_sales    | orders x customer    | the same per (c_nationkey as site_id, date) |
| weather       | lineitem             | per ship date: round(avg(quantity), 1), sum(linenumber) % 100 |
| holidays      | order dates          | fixed rules, see ``holidays`` |
| predictions   | actual_sales         | mean of the previous 4 same weekdays (ceil, default 7), split by
|               |                      | the empirical theme ratio, override +2 on day 15 |
"""

from __future__ import annotations

import os
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from platewise.functions.calendar import day_theme, month_name, weekday_name
from platewise.functions.split import final_prediction, split_total
from platewise.operators.features import fill_day_flags, join_holidays, weather_days
from platewise.operators.rollup import daily_demand, daily_demand_by_site
from platewise.operators.split import theme_ratios, with_theme_ratio
from platewise.schemas import PREDICTION_COLUMNS
from platewise.session import scratch_dir

VEG_PRIORITIES = ["1-URGENT", "2-HIGH"]
SALAD_DIVISOR = 10_000_000  # cents / 1e7 = price / 100000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _order_day():
    return F.col("o_orderdate").cast("date")


def _is_veg():
    return F.col("o_orderpriority").isin(*VEG_PRIORITIES)


def _salad_cents():
    return F.when(F.col("o_orderstatus") == "F",
                  F.round(F.col("o_totalprice") * F.lit(100.0)).cast("bigint")).otherwise(F.lit(0))


def build_actual_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AIM-1 over ``orders``: one row per working day."""
    return daily_demand(table(spark, sf_dir, "orders"), _order_day(), _is_veg(),
                        _salad_cents(), SALAD_DIVISOR)


def build_site_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AIM-1 per (site_id = c_nationkey, date); pre-aggregated before the join."""
    return daily_demand_by_site(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"),
                                "o_custkey", "c_custkey", "c_nationkey",
                                _order_day(), _is_veg(), _salad_cents(), SALAD_DIVISOR)


def build_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily weather per ship date: temperature_max, weather_code, category."""
    li = table(spark, sf_dir, "lineitem")
    agg = (li.select(F.col("l_shipdate").cast("date").alias("date"),
                     F.col("l_quantity").cast("bigint").alias("q"), "l_linenumber")
             .groupBy("date")
             .agg(F.sum("q").alias("_q"), F.count(F.lit(1)).alias("_n"),
                  F.sum("l_linenumber").alias("_ln")))
    # round(avg(quantity), 1), computed exactly (quantities are whole numbers)
    temp = F.expr("(_q * 20 + _n) div (_n * 2)").cast("double") / F.lit(10.0)
    w = agg.select("date", temp.alias("temperature_max"),
                   (F.col("_ln") % 100).cast("int").alias("weather_code"))
    return weather_days(w)


# --- fixed values: holiday rules of the fixture view --------------------------
BANK_DAYS = {
    "01-01": "New Year",
    "05-01": "Labour Day",
    "10-03": "German Unity Day",
    "12-25": "Christmas Day",
    "12-26": "Boxing Day",
}


def build_holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holiday rows for order dates that are a bank day, bridge day or break.

    bank: fixed month-days above; bridge: a Friday after or a Monday before a
    bank day; school break: July, and December from the 23rd.
    """
    days = table(spark, sf_dir, "orders").select(_order_day().alias("date")).distinct()
    md = lambda c: F.date_format(c, "MM-dd")
    bank_set = list(BANK_DAYS)
    is_bank = md(F.col("date")).isin(*bank_set)
    wd = F.weekday("date")
    is_bridge = ((wd == 4) & md(F.date_sub("date", 1)).isin(*bank_set)) | \
                ((wd == 0) & md(F.date_add("date", 1)).isin(*bank_set))
    m, d = F.month("date"), F.dayofmonth("date")
    is_break = (m == 7) | ((m == 12) & (d >= 23))
    bank_name = None
    for k, v in BANK_DAYS.items():
        cond = md(F.col("date")) == k
        bank_name = F.when(cond, F.lit(v)) if bank_name is None else bank_name.when(cond, F.lit(v))
    desc = (bank_name
            .when(is_bridge & (wd == 4), F.lit("Bridge Day (after Ascension)"))
            .when(is_bridge, F.lit("Bridge Day (Heilige 3 K)"))
            .when((m == 7) & (d == 1), F.lit("Summer Break Start"))
            .when((m == 7) & (d == 31), F.lit("Summer Break End"))
            .when(m == 7, F.lit("Summer Break"))
            .when((m == 12) & (d == 23), F.lit("Christmas Break Start"))
            .when(is_break, F.lit("Christmas Break")))
    return (days.select("date", desc.alias("description"), is_bank.alias("is_bank_holiday"),
                        is_break.alias("is_school_break"), is_bridge.alias("is_bridge_day"))
                .filter(F.col("is_bank_holiday") | F.col("is_school_break") | F.col("is_bridge_day")))


def seasonal_mean(value: str = "actual_meals", lookback: int = 4, default: int = 7, site=()):
    """Stand-in for the model: ceil of the mean of the previous ``lookback``
    same weekdays. Window per (site, weekday): one row per day per partition."""
    w = Window.partitionBy(*site, F.weekday("date")).orderBy("date").rowsBetween(-lookback, -1)
    return F.coalesce(F.ceil(F.avg(value).over(w)), F.lit(default)).cast("bigint")


def build_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored predictions table (FIXTURES A1) derived from ``actual_sales``."""
    a = actual_sales(spark, sf_dir)
    w_prev = Window.partitionBy(F.weekday("date")).orderBy("date")
    base = a.select(
        "date",
        weekday_name("date").alias("weekday"),
        month_name("date").alias("month"),
        day_theme("date").alias("day_theme"),
        seasonal_mean().alias("predicted_meals"),
        F.coalesce(F.lag("actual_meals_salad").over(w_prev), F.lit(0.0)).alias("predicted_meals_salad"),
        F.date_sub("date", 7).cast("timestamp_ntz").alias("prediction_timestamp"),
    )
    wx = weather(spark, sf_dir).select("date", "temperature_max", "weather_condition")
    base = base.join(wx, "date", "left")
    base = fill_day_flags(join_holidays(base, holidays(spark, sf_dir)).drop("is_bank_holiday"))
    base = base.withColumns({
        "override_meal_prediction": F.when(F.dayofmonth("date") == 15,
                                           F.col("predicted_meals") + 2).cast("bigint"),
        "override_reason": F.when(F.dayofmonth("date") == 15, F.lit("Event")),
    })
    base = with_theme_ratio(base, theme_ratios(a))
    sp = split_total(final_prediction(), F.col("veg_ratio"))
    out = base.withColumns({
        "predicted_meals_veg": sp["veg"],
        "predicted_meals_non_veg": sp["non_veg"],
        "final_prediction": final_prediction(),
    })
    return out.select(*PREDICTION_COLUMNS)


def build_site_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-site predictions derived from ``site_sales``: the seasonal mean
    per (site, weekday), split by the site's own theme ratio (with the fixed
    fallbacks). Windows partition by (site, weekday)."""
    keys = ["site_id", "date"]
    a = site_sales(spark, sf_dir)
    w_prev = Window.partitionBy("site_id", F.weekday("date")).orderBy("date")
    base = a.select(
        "site_id", "date",
        day_theme("date").alias("day_theme"),
        seasonal_mean(site=["site_id"]).alias("predicted_meals"),
        F.coalesce(F.lag("actual_meals_salad").over(w_prev), F.lit(0.0)).alias("predicted_meals_salad"),
        F.date_sub("date", 7).cast("timestamp_ntz").alias("prediction_timestamp"),
    )
    base = with_theme_ratio(base, theme_ratios(a, keys), keys)
    sp = split_total(F.col("predicted_meals"), F.col("veg_ratio"))
    return base.select("site_id", "date", "day_theme", "predicted_meals",
                       sp["veg"].alias("predicted_meals_veg"), sp["non_veg"].alias("predicted_meals_non_veg"),
                       "predicted_meals_salad", "prediction_timestamp",
                       F.col("predicted_meals").alias("final_prediction"))


# --- the run's daily tables ------------------------------------------------------
# The daily tables are what every downstream operator reads. As in
# production, they are computed once from the raw tables, written into a
# fresh folder of the run in the shared checkpoint folder (which also cuts the
# lineage) and handed on as DataFrames; later queries read the small daily
# table instead of re-aggregating raw lines. Nothing is kept between runs.
_BUILDERS = {
    "actual_sales": build_actual_sales,
    "site_sales": build_site_sales,
    "weather": build_weather,
    "holidays": build_holidays,
    "predictions": build_predictions,
    "site_predictions": build_site_predictions,
}


class Run:
    """What one run has written for the tables of ``sf_dir``: its folder, and
    the names that are there."""

    def __init__(self, spark: SparkSession):
        self.folder, self.names, self.lock = scratch_dir(spark, "daily"), set(), threading.RLock()

    def path(self, name: str, write: Callable[[str], object]) -> str:
        """The folder ``name`` of the run; the first caller has it written."""
        path = os.path.join(self.folder, name)
        with self.lock:
            if name not in self.names:
                write(path)
                self.names.add(name)
        return path


_RUNS: dict[tuple[str, str], Run] = {}


def build(spark: SparkSession, sf_dir: str) -> Run:
    """Write all daily tables into a new folder; queries read them from now on
    (call it again when the raw tables have changed)."""
    run = _RUNS[spark.sparkContext.applicationId, sf_dir] = Run(spark)
    for name in _BUILDERS:
        view(spark, sf_dir, name)
    return run


def current_run(spark: SparkSession, sf_dir: str) -> Run:
    """The run of this application over ``sf_dir``: the last one that was
    built, else a new one whose tables are written as they are asked for."""
    return _RUNS.setdefault((spark.sparkContext.applicationId, sf_dir), Run(spark))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named daily table of the run."""
    path = current_run(spark, sf_dir).path(name, lambda p: _BUILDERS[name](spark, sf_dir).write.parquet(p))
    return spark.read.parquet(path)


def actual_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "actual_sales")


def site_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "site_sales")


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "weather")


def holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "holidays")


def site_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "site_predictions")


def predictions(spark: SparkSession, sf_dir: str, actuals: DataFrame | None = None) -> DataFrame:
    """The predictions table; ``actuals`` is accepted for call-site symmetry
    (the view is always derived from the ``actual_sales`` view)."""
    return view(spark, sf_dir, "predictions")


__all__ = ["table", "view", "build", "current_run", "actual_sales", "site_sales", "weather", "holidays", "predictions",
           "site_predictions"]
