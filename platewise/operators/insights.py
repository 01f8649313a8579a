"""Rule-based insights and chart data (AIM-3, AIM-4, AIM-5, AIM-6).

The hosted-language-model notes of the original are replaced by the rules
they were prompted with, computed as grouped aggregates and bounded top-k
windows: every window partition is one period (a month or a planning week)
of a few dozen candidate rows, never a whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# category -> (actual column, predicted column, integer unit scale)
CATEGORY_COLUMNS = {
    "total": ("actual_meals", "final_prediction", 1),
    "veg": ("actual_meals_veg", "predicted_meals_veg", 1),
    "non_veg": ("actual_meals_non_veg", "predicted_meals_non_veg", 1),
    "salad": ("actual_meals_salad", "predicted_meals_salad", 100),  # kg -> 10 g units
}


def categories_long(compared: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Unpivot the four categories into (category, actual_units, predicted_units).

    Salad weights are turned into whole 10-gram units so that every later
    sum is exact integer arithmetic, independent of partitioning.
    """
    cols = []
    for name, (a, p, scale) in CATEGORY_COLUMNS.items():
        if scale == 1:
            ca, cp = F.col(a).cast("bigint"), F.col(p).cast("bigint")
        else:
            ca = F.round(F.col(a) * F.lit(float(scale))).cast("bigint")
            cp = F.round(F.col(p) * F.lit(float(scale))).cast("bigint")
        cols.append(F.struct(F.lit(name).alias("category"), ca.alias("actual_units"), cp.alias("predicted_units")))
    return compared.select(*ids, F.inline(F.array(*cols)))


def severity(rel_bias) -> F.Column:
    """success (< 1 %), info (1-3 %), warning (3-5 %), error (> 5 %)."""
    b = F.abs(rel_bias)
    return (F.when(b.isNull(), F.lit("info"))
             .when(b > 0.05, F.lit("error"))
             .when(b >= 0.03, F.lit("warning"))
             .when(b < 0.01, F.lit("success"))
             .otherwise(F.lit("info")))


def bias_insights(compared: DataFrame, period: str = "month", by: Sequence[str] = ("weekday",),
                  top: int = 3, site: Sequence[str] = ()) -> DataFrame:
    """AIM-3: per (site?, period), the ``top`` worst (weekday x category) biases.

    bias = (sum actual - sum predicted) / sum predicted; worst = largest
    absolute bias (ties: by the grouping values). Output mirrors the insight
    objects: type, title, message, plus the numbers behind them.
    """
    by, site = list(by), list(site)
    long = categories_long(compared, [*site, period, *by])
    g = long.groupBy(*site, period, *by, "category").agg(
        F.count(F.lit(1)).alias("days"),
        F.sum("actual_units").alias("actual_units"),
        F.sum("predicted_units").alias("predicted_units"),
        F.avg(F.abs(F.col("actual_units") - F.col("predicted_units"))).alias("mae_units"))
    bias = (F.col("actual_units") - F.col("predicted_units")).cast("double") / \
        F.nullif(F.col("predicted_units"), F.lit(0)).cast("double")
    g = g.withColumn("rel_bias", bias)
    w = Window.partitionBy(*site, period).orderBy(F.abs("rel_bias").desc_nulls_last(), *by, "category")
    top_rows = g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    pct = F.bround(F.col("rel_bias") * F.lit(100.0), 0).cast("int")
    direction = F.when(F.col("rel_bias") > 0, F.lit("under-forecast")) \
                 .when(F.col("rel_bias") < 0, F.lit("over-forecast")).otherwise(F.lit("on target"))
    title = F.concat_ws(" ", *[F.col(b) for b in by], F.col("category"))
    subject = F.col(by[0]) if by else F.lit("all days")
    message = F.format_string("%s %s: %s by %+d%% over %d days", subject, F.col("category"), direction,
                              F.coalesce(pct, F.lit(0)), F.col("days"))
    return top_rows.select(*site, period, "rank", *by, "category", "days", "actual_units", "predicted_units",
                           "rel_bias", severity(F.col("rel_bias")).alias("type"),
                           title.alias("title"), message.alias("message"))


#: Groupings that may hold a pattern.
PATTERNS = ("weekday", "day_theme", "day_kind", "volume")
#: A t statistic of less is no pattern.
SIGNIFICANT = 2.0


def bias_patterns(compared: DataFrame, period: str = "month", patterns: Sequence[str] = PATTERNS, top: int = 3,
                  site: Sequence[str] = ()) -> DataFrame:
    """AIM-3: per (site?, period) the ``top`` most significant biases, found in
    all days together and in every weekday, theme, kind of day (``day_kind``)
    and volume band, for each category.

    One pass with grouping sets keeps the count, sum and sum of squares of the
    differences, in whole units; the t statistic of their mean ranks the
    patterns, so that a steady bias of many days comes before a large one of
    two. A day's ``volume`` is low or high when its prediction lies more than
    a fifth below or above the period's mean. Patterns of one day, or of
    differences that are all equal, have no statistic and are left out."""
    keys = [*site, period]
    if "volume" in patterns:
        w = Window.partitionBy(*keys)  # a period's days of a site: a few dozen
        mean = F.sum("final_prediction").over(w), F.count(F.lit(1)).over(w)
        five = F.col("final_prediction") * mean[1] * 5
        compared = compared.withColumn("volume", F.when(five < mean[0] * 4, "low").when(five > mean[0] * 6, "high").otherwise("usual"))
    long = categories_long(compared, [*keys, *patterns]).withColumn("_d", F.col("actual_units") - F.col("predicted_units"))
    sets = [[*keys, "category"], *[[*keys, "category", p] for p in patterns]]
    g = long.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*keys, "category", *patterns]]).agg(
        F.count(F.lit(1)).alias("days"), F.sum("predicted_units").alias("_p"), F.sum("_d").alias("bias_units"),
        F.sum(F.col("_d") * F.col("_d")).alias("_ss"), *[F.grouping(p).alias(f"_no_{p}") for p in patterns])
    chosen = [(F.col(f"_no_{p}") == 0, p) for p in patterns]
    pattern = F.coalesce(*[F.when(c, F.lit(p)) for c, p in chosen], F.lit("all"))
    value = F.when(pattern == "all", F.lit("all days"))
    for c, p in chosen:
        value = value.when(c, F.col(p).cast("string"))
    s, n = F.col("bias_units").cast("double"), F.col("days")
    # sum / sqrt((n * sum of squares - sum^2) / (n - 1)) is mean / (deviation / sqrt(n))
    spread = F.nullif((F.col("_ss").cast("double") * n - s * s) / F.nullif(n - 1, F.lit(0)), F.lit(0.0))
    g = g.select(*keys, "category", pattern.alias("pattern"), value.alias("value"), "days", "bias_units",
                 (s / F.nullif(F.col("_p"), F.lit(0))).alias("rel_bias"), F.round(s / F.sqrt(spread), 4).alias("t"))
    w = Window.partitionBy(*keys).orderBy(F.abs("t").desc(), "pattern", "value", "category")
    best = g.filter(F.abs("t") >= SIGNIFICANT).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return best.select(*keys, "rank", "pattern", "value", "category", "days", "bias_units", "rel_bias", "t",
                       severity(F.col("rel_bias")).alias("type"))


BAD_WEATHER = ["Rainy", "Snowy", "Stormy"]
#: Days of its theme's mean that a cell of conditions starts with.
SHRINKAGE = 5


def day_kind() -> Column:
    """School break, bridge day or normal, from the day flags."""
    return (F.when(F.coalesce(F.col("is_school_break"), F.lit(False)), F.lit("school break"))
            .when(F.coalesce(F.col("is_bridge_day"), F.lit(False)), F.lit("bridge day")).otherwise(F.lit("normal")))


def conditional_expectation(history: DataFrame, forecast: DataFrame, site: Sequence[str] = ()) -> DataFrame:
    """``forecast`` with ``expected``, the mean of the history's days of the
    same (site?, theme, weather, kind of day), and ``spread``.

    Few days say little: a cell starts with ``SHRINKAGE`` days of its theme's
    mean, and without any days the theme's mean is expected. ``spread`` is the
    standard deviation of the theme's days around their cells' means. Weather
    that is not known is a condition of its own. Sums are whole numbers, in
    one row per cell: the history is read once, a theme's sums are its cells'."""
    keys, cell = [*site, "day_theme"], ["weather_condition", "_kind"]
    known = history.filter(F.col("day_theme").isNotNull() & F.col("actual_meals").isNotNull())
    cells = known.withColumn("_kind", day_kind()).groupBy(*keys, *cell).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("actual_meals").alias("_s"),
        F.sum(F.col("actual_meals") * F.col("actual_meals")).alias("_ss"))
    s = F.col("_s").cast("double")
    themes = cells.groupBy(*keys).agg(
        (F.sum("_s").cast("double") / F.sum("_n")).alias("_mean"),
        F.sqrt(F.sum(F.col("_ss") - s * F.col("_s") / F.col("_n")) / F.nullif(F.sum("_n") - F.count(F.lit(1)), F.lit(0))).alias("spread"))
    if not site:
        cells, themes = F.broadcast(cells), F.broadcast(themes)  # themes x weathers x kinds: under 100 rows
    c = cells.select(*[F.col(k).alias(f"_c_{k}") for k in (*keys, *cell)], "_n", "_s")
    f = forecast.withColumn("_kind", day_kind())
    on = [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in (*keys, *cell)]
    j = f.join(c, on, "left").drop(*[f"_c_{k}" for k in (*keys, *cell)]).join(themes, keys, "left")
    expected = (F.coalesce(F.col("_s").cast("double"), F.lit(0.0)) + SHRINKAGE * F.col("_mean")) / (
        F.coalesce(F.col("_n"), F.lit(0)) + SHRINKAGE)
    return j.withColumn("expected", expected).drop("_n", "_s", "_mean", "_kind")


def plan_anomalies(forecast: DataFrame, history: DataFrame, period: str = "week_start",
                   z_threshold: float = 2.0, top: int = 3, keys: Sequence[str] = ("date",)) -> DataFrame:
    """AIM-4: per planning period, up to ``top`` days worth a second look.

    Both frames have the conditions of their days: theme, weather and the day
    flags. A forecast is measured against what such days had (see
    ``conditional_expectation``), in standard deviations: ``z``. Reasons: it
    is more than ``z_threshold`` of them off, a school break, a bridge day, or
    bad weather. The farthest from expectation come first, the earlier day on
    ties."""
    site = [k for k in keys if k != "date"]
    j = conditional_expectation(history, forecast, site)
    z = F.round((F.col("final_prediction") - F.col("expected")) / F.nullif(F.col("spread"), F.lit(0.0)), 4)
    j = j.withColumn("z", z).withColumn("_kind", day_kind())
    reasons = F.concat_ws(", ",
                          F.when(F.col("z") > z_threshold, F.lit("more than such days had"))
                          .when(F.col("z") < -z_threshold, F.lit("less than such days had")),
                          F.when(F.col("_kind") != "normal", F.col("_kind")),
                          F.when(F.col("weather_condition").isin(*BAD_WEATHER), F.lit("bad weather")))
    j = j.withColumn("reasons", reasons).filter(F.col("reasons") != "")
    w = Window.partitionBy(*site, period).orderBy(F.coalesce(F.abs("z"), F.lit(0.0)).desc(), "date")
    return (j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
             .select(*site, period, "rank", "date", "day_theme", "final_prediction", F.round("expected", 4).alias("expected"),
                     "z", "reasons"))


def series_long(compared: DataFrame, ids: Sequence[str] = ("date",)) -> DataFrame:
    """AIM-5: chart data, one row per (date, series, value): predicted and
    actual per category and their differences."""
    ids = list(ids)
    series = {}
    for name, (a, p, _) in CATEGORY_COLUMNS.items():
        series[f"predicted_{name}"] = F.col(p).cast("double")
        series[f"actual_{name}"] = F.col(a).cast("double")
        series[f"difference_{name}"] = (F.col(a) - F.col(p)).cast("double")
    wide = compared.select(*ids, *[v.alias(k) for k, v in series.items()])
    return wide.unpivot(ids, list(series), "series", "value")


def table_health(name: str, df: DataFrame, as_of, date_col: str = "date",
                 batch_col: str = "prediction_timestamp") -> DataFrame:
    """AIM-6 building block: one row with rows, first / last date, staleness
    and, for tables stamped per batch, the latest batch time (AGG-11)."""
    from platewise.functions.calendar import _date_lit
    last_batch = F.max(batch_col).cast("timestamp_ntz") if batch_col in df.columns \
        else F.lit(None).cast("timestamp_ntz")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min(date_col).alias("first_date"),
                  F.max(date_col).alias("last_date"), last_batch.alias("last_batch")) \
             .select(F.lit(name).alias("table_name"), "rows", "first_date", "last_date",
                     F.datediff(_date_lit(as_of), F.col("last_date")).alias("days_since_last"), "last_batch")


def health(tables: dict[str, DataFrame], as_of) -> DataFrame:
    """AIM-6: union of one-row health aggregates, one per table."""
    out = None
    for name, df in tables.items():
        h = table_health(name, df, as_of)
        out = h if out is None else out.unionByName(h)
    return out


def model_health(spark: SparkSession, metadata: str, as_of, name: str = "model") -> DataFrame:
    """AIM-6: the published model's row, from its metadata record: the rows
    and days it learned from and when; nulls where the record has none."""
    from platewise.functions.calendar import _date_lit
    from platewise.sources.files import read_model_metadata_full
    m = read_model_metadata_full(spark, metadata)
    last = F.col("last_training_date").try_cast("date")
    return m.select(
        F.lit(name).alias("table_name"), F.col("training_row_count").alias("rows"),
        F.col("first_training_date").try_cast("date").alias("first_date"), last.alias("last_date"),
        F.datediff(_date_lit(as_of), last).alias("days_since_last"),
        F.try_to_timestamp(F.col("training_timestamp")).cast("timestamp_ntz").alias("last_batch"))
