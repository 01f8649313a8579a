"""Actual-vs-predicted analysis (JON-3, JON-4, JON-8, PRJ-5, PRJ-6, FLT-1,
FLT-2, AGG-1...4, AGG-6...11, AGG-10, SRT-1, SRT-2).

Both tables hold one row per key (date, or site and date), so the joins are
key-to-key: no fan-out, no hot key. Metrics are plain grouped aggregates with
map-side partial aggregation; the optional ``by`` columns (site, weekday,
theme, period tag) turn one-row results into one row per group without a
driver loop.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.calendar import _date_lit, weekday_name

CATEGORIES = {
    "": ("actual_meals", "final_prediction"),
    "_veg": ("actual_meals_veg", "predicted_meals_veg"),
    "_non_veg": ("actual_meals_non_veg", "predicted_meals_non_veg"),
    "_salad": ("actual_meals_salad", "predicted_meals_salad"),
}

PRED_COLS = ["final_prediction", "prediction_timestamp", "day_theme",
             "predicted_meals_veg", "predicted_meals_non_veg", "predicted_meals_salad"]
ACT_COLS = ["actual_meals", "actual_meals_veg", "actual_meals_non_veg", "actual_meals_salad"]


def date_range(df: DataFrame, start, end, date_col: str = "date") -> DataFrame:
    """FLT-1: inclusive date range (pushed into the parquet scan)."""
    return df.filter(F.col(date_col).between(_date_lit(start), _date_lit(end)))


def from_week_start(df: DataFrame, as_of, date_col: str = "date") -> DataFrame:
    """FLT-2: rows from Monday of ``as_of``'s week onward, no upper bound."""
    monday = F.date_trunc("week", _date_lit(as_of)).cast("date")
    return df.filter(F.col(date_col) >= monday)


def add_errors(df: DataFrame) -> DataFrame:
    """PRJ-5 / PRJ-6: differences (actual - predicted) and signed relative
    errors with the *prediction* as denominator (0 -> null)."""
    cols = {"weekday": weekday_name("date")}
    for suffix, (a, p) in CATEGORIES.items():
        diff = F.col(a) - F.col(p)
        cols[f"difference{suffix}"] = diff
        cols[f"pct_error{suffix}"] = diff.cast("double") / F.nullif(F.col(p), F.lit(0)).cast("double")
    return df.withColumns(cols)


def join_actuals(predictions: DataFrame, actuals: DataFrame, start=None, end=None,
                 keys: Sequence[str] = ("date",), with_errors: bool = True, ordered: bool = False) -> DataFrame:
    """JON-3: predictions x actuals for a period, errors attached.

    The range filter is applied to both inputs before the join so that both
    scans prune. Ordering is left to the consumer (``orderBy`` only where a
    report needs it): a global sort is a shuffle of its own.
    """
    keys = list(keys)
    p = predictions.select(*keys, *PRED_COLS)
    a = actuals.select(*keys, *ACT_COLS)
    if start is not None:
        p, a = date_range(p, start, end), date_range(a, start, end)
    j = p.join(a, keys, "inner")
    j = add_errors(j) if with_errors else j
    # SRT-1: date order on request (a range-partitioned distributed sort)
    return j.orderBy(*keys) if ordered else j


def missing_actuals(predictions: DataFrame, actuals: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    """JON-4: predicted days without actuals, actual columns typed nulls."""
    keys = list(keys)
    p = predictions.select(*keys, "final_prediction", "day_theme", "predicted_meals_veg",
                           "predicted_meals_non_veg", "predicted_meals_salad")
    out = p.join(actuals.select(*keys), keys, "left_anti")
    return out.withColumns({
        "actual_meals": F.lit(None).cast("bigint"),
        "actual_meals_veg": F.lit(None).cast("bigint"),
        "actual_meals_non_veg": F.lit(None).cast("bigint"),
        "actual_meals_salad": F.lit(None).cast("double"),
    })


def _accuracy(actual: Column, pred: Column, tolerance: float = 0.05, unit: str = "percent",
              where: Column | None = None) -> Column:
    """Share of the rows (of those ``where`` holds) within the tolerance, in percent."""
    pct = F.abs(actual - pred).cast("double") / F.nullif(pred, F.lit(0)).cast("double") * F.lit(100.0)
    tol = tolerance if unit == "percent" else tolerance * 100.0
    hit = F.when(F.coalesce(pct <= F.lit(float(tol)), F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.avg(hit if where is None else F.when(where, hit)) * F.lit(100.0)


def metric_exprs(actual: str = "actual_meals", pred: str = "final_prediction",
                 tolerance: float = 0.05, tolerance_unit: str = "percent") -> list[Column]:
    """AGG-1...4 as aggregate expressions.

    ``tolerance`` is compared on the percent scale by default, so 0.05 means
    0.05 percentage points (Q1); ``tolerance_unit='fraction'`` reads 0.05 as
    5 %. Rows whose relative error is undefined (zero prediction) count as
    misses: they stay in the denominator of the accuracy rate.
    """
    a, p = F.col(actual), F.col(pred)
    return [
        F.avg(F.abs(a - p)).alias("mae"),
        F.count_if(p > a).alias("over_predicted"),
        F.count_if(p < a).alias("under_predicted"),
        _accuracy(a, p, tolerance, tolerance_unit).alias("accuracy_rate"),
    ]


def metrics(df: DataFrame, by: Sequence[str] = (), **kw) -> DataFrame:
    """AGG-1...4 per group (one row when ``by`` is empty)."""
    return df.groupBy(*by).agg(*metric_exprs(**kw))


def period_over_period(predictions: DataFrame, actuals: DataFrame, start, end,
                       keys: Sequence[str] = ("date",), by: Sequence[str] = (), **kw) -> DataFrame:
    """AGG-10: metrics of [start, end] and of the equally long period before.

    One scan covers both periods: rows are tagged ``current`` / ``previous``
    and aggregated by tag with conditional aggregates, so no second join and
    no driver round trip. Deltas are null when the previous period is empty.
    """
    s = _dt.date.fromisoformat(start) if isinstance(start, str) else start
    e = _dt.date.fromisoformat(end) if isinstance(end, str) else end
    length = (e - s).days
    prev_end = s - _dt.timedelta(days=1)
    prev_start = prev_end - _dt.timedelta(days=length)
    j = join_actuals(predictions, actuals, prev_start, e, keys, with_errors=False)
    j = j.withColumn("_cur", F.col("date") >= F.lit(s))
    aggs = []
    for tag, cond in (("cur", F.col("_cur")), ("prev", ~F.col("_cur"))):
        a = F.when(cond, F.col("actual_meals"))
        p = F.when(cond, F.col("final_prediction"))
        aggs += [
            F.count_if(cond).alias(f"{tag}_rows"),
            F.avg(F.abs(a - p)).alias(f"{tag}_mae"),
            F.count_if(cond & (p > a)).alias(f"{tag}_over_predicted"),
            F.count_if(cond & (p < a)).alias(f"{tag}_under_predicted"),
            _accuracy(a, p, kw.get("tolerance", 0.05), kw.get("tolerance_unit", "percent"), cond)
            .alias(f"{tag}_accuracy_rate"),
        ]
    g = j.groupBy(*by).agg(*aggs)
    has_prev = F.col("prev_rows") > 0
    out = g.select(
        *by,
        F.lit(s).alias("period_start"), F.lit(e).alias("period_end"),
        F.lit(prev_start).alias("prev_start"), F.lit(prev_end).alias("prev_end"),
        F.col("cur_rows").alias("rows"), F.col("prev_rows"),
        F.col("cur_mae").alias("mae"), F.col("cur_accuracy_rate").alias("accuracy_rate"),
        F.col("cur_over_predicted").alias("over_predicted"),
        F.col("cur_under_predicted").alias("under_predicted"),
        F.when(has_prev, F.col("cur_mae") - F.col("prev_mae")).alias("mae_delta"),
        F.when(has_prev, F.col("cur_accuracy_rate") - F.col("prev_accuracy_rate")).alias("accuracy_delta"),
        F.when(has_prev, F.col("cur_over_predicted") - F.col("prev_over_predicted")).alias("over_delta"),
        F.when(has_prev, F.col("cur_under_predicted") - F.col("prev_under_predicted")).alias("under_delta"),
    )
    return out


def forecast_kpis(predictions: DataFrame, by: Sequence[str] = (), with_peak: bool = False) -> DataFrame:
    """AGG-6 / AGG-7: totals and the daily mean (truncated for display);
    ``with_peak`` adds the AGG-8 peak day in the same aggregate."""
    extra = []
    if with_peak:
        order = F.struct(F.col("final_prediction"), (-F.unix_date("date")).alias("neg_day"))
        extra = [F.max_by("date", order).alias("peak_date")]
    return predictions.groupBy(*by).agg(*extra,
        F.sum("final_prediction").alias("total_meals"),
        F.sum("predicted_meals_veg").alias("total_veg"),
        F.sum("predicted_meals_non_veg").alias("total_non_veg"),
        F.sum("predicted_meals_salad").alias("total_salad"),
        F.avg("final_prediction").alias("avg_meals"),
        F.avg("final_prediction").cast("bigint").alias("avg_meals_display"),
        F.count(F.lit(1)).alias("days"),
    )


def peak_day(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AGG-8: the day with the highest final prediction, earliest on ties.

    ``max_by`` over a (value, -day) ordering key: deterministic, no sort.
    """
    order = F.struct(F.col("final_prediction"), (-F.unix_date("date")).alias("neg_day"))
    row = F.struct("date", "final_prediction", "predicted_meals_veg", "predicted_meals_non_veg")
    g = predictions.groupBy(*by).agg(F.max_by(row, order).alias("_peak"))
    return g.select(*by, "_peak.date", "_peak.final_prediction",
                    "_peak.predicted_meals_veg", "_peak.predicted_meals_non_veg")


def date_bounds(df: DataFrame, by: Sequence[str] = (), date_col: str = "date") -> DataFrame:
    """AGG-9: first and last date."""
    return df.groupBy(*by).agg(F.min(date_col).alias("min_date"), F.max(date_col).alias("max_date"))


def latest_batch(predictions: DataFrame, ts_col: str = "prediction_timestamp") -> DataFrame:
    """JON-8: rows of the most recent prediction timestamp (scalar subquery
    shape: a one-row aggregate joined back, broadcast by construction)."""
    latest = predictions.agg(F.max(ts_col).alias("_latest"))
    return predictions.join(F.broadcast(latest), F.col(ts_col) == F.col("_latest"), "inner").drop("_latest")


def last_prediction_info(predictions: DataFrame, ts_col: str = "prediction_timestamp",
                         by: Sequence[str] = ()) -> DataFrame:
    """AGG-11 / SRT-2: latest batch timestamp with its first and last date.

    ``max_by`` over the timestamp avoids the self-join: the first / last date
    of the latest batch are min / max of the dates carrying that timestamp.
    An empty input gives one row of nulls.
    """
    latest = F.max(ts_col)
    g = predictions.groupBy(*by).agg(
        latest.alias("timestamp"),
        F.max_by("date", F.struct(F.col(ts_col), -F.unix_date("date"))).alias("start_date"),
        F.max_by("date", F.struct(F.col(ts_col), F.col("date"))).alias("end_date"),
    )
    return g


def _unit_start(d: Column, unit: str) -> Column:
    return F.date_trunc(unit, d).cast("date")


def _unit_shift(start: Column, unit: str, k: int) -> Column:
    return F.add_months(start, k) if unit == "month" else F.date_add(start, 7 * k)


def _unit_end(start: Column, unit: str) -> Column:
    # a month ends on its last day; a working week runs Monday to Friday
    return F.last_day(start) if unit == "month" else F.date_add(start, 4)


def period_over_period_all(predictions: DataFrame, actuals: DataFrame, unit: str = "month",
                           keys: Sequence[str] = ("date",), **kw) -> DataFrame:
    """AGG-10 for every period at once (``unit`` = ``month`` or ``week``).

    For each calendar period P = [start, end] the previous period is the
    equally long span right before it: [start - 1 - (end - start), start - 1].
    Each joined row is tagged with the period it belongs to and with the (at
    most two) later periods whose previous span contains it; an
    ``explode`` of that bounded array replaces a range join. Metrics per
    (site?, period) then come from one grouped aggregate.
    """
    if unit not in ("month", "week"):
        raise ValueError("unit must be 'month' or 'week'")
    site = [k for k in keys if k != "date"]
    j = join_actuals(predictions, actuals, keys=keys, with_errors=False)
    d = F.col("date")
    own = _unit_start(d, unit)
    # a weekend row belongs to no working week, but to the span before later ones
    tags = [F.when(d <= _unit_end(own, unit), F.struct(own.alias("period_start"), F.lit(True).alias("cur")))]
    for k in (1, 2):
        n_start = _unit_shift(own, unit, k)
        n_end = _unit_end(n_start, unit)
        prev_start = F.date_sub(F.date_sub(n_start, 1), F.datediff(n_end, n_start))
        tags.append(F.when(d >= prev_start, F.struct(n_start.alias("period_start"), F.lit(False).alias("cur"))))
    t = j.select(*site, "date", "actual_meals", "final_prediction",
                 F.explode(F.filter(F.array(*tags), lambda x: x.isNotNull())).alias("_t"))
    t = t.select(*site, "actual_meals", "final_prediction", "_t.period_start", "_t.cur")
    aggs = []
    for tag, cond in (("cur", F.col("cur")), ("prev", ~F.col("cur"))):
        a = F.when(cond, F.col("actual_meals"))
        p = F.when(cond, F.col("final_prediction"))
        aggs += [
            F.count_if(cond).alias(f"{tag}_rows"),
            F.avg(F.abs(a - p)).alias(f"{tag}_mae"),
            F.count_if(cond & (p > a)).alias(f"{tag}_over"),
            F.count_if(cond & (p < a)).alias(f"{tag}_under"),
            _accuracy(a, p, kw.get("tolerance", 0.05), kw.get("tolerance_unit", "percent"), cond).alias(f"{tag}_acc"),
        ]
    g = t.groupBy(*site, "period_start").agg(*aggs).filter(F.col("cur_rows") > 0)
    has_prev = F.col("prev_rows") > 0
    end = _unit_end(F.col("period_start"), unit)
    return g.select(
        *site, "period_start", end.alias("period_end"),
        F.col("cur_rows").alias("rows"), "prev_rows",
        F.col("cur_mae").alias("mae"), F.col("cur_acc").alias("accuracy_rate"),
        F.col("cur_over").alias("over_predicted"), F.col("cur_under").alias("under_predicted"),
        F.when(has_prev, F.col("cur_mae") - F.col("prev_mae")).alias("mae_delta"),
        F.when(has_prev, F.col("cur_acc") - F.col("prev_acc")).alias("accuracy_delta"),
        F.when(has_prev, F.col("cur_over") - F.col("prev_over")).alias("over_delta"),
        F.when(has_prev, F.col("cur_under") - F.col("prev_under")).alias("under_delta"),
    )
