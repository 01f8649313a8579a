"""AIM-1: roll raw order lines up to daily demand per (site, date).

Scale notes
-----------
* The rollup is a ``groupBy`` whose partial aggregate runs map-side, so the
  shuffle carries at most one row per (task, group), never the raw lines.
* When the site comes from a second table (``customer``), lines are first
  pre-aggregated per (join key, day). A hot customer holding a third of all
  lines collapses to one row per day *before* the join shuffle, so the join
  never sees the skew; AQE's skew-join split covers what is left.
* Day buckets use integer arithmetic for the salad weight, so the result is
  exact and identical on any number of partitions.
* The rollup of a table that lines keep arriving for, however late, is
  maintained by recomputing the days that new lines touch, and those only.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.calendar import is_working_day
from platewise.sinks.tables import ATTEMPTS, current_version, upsert_into

#: Ranges of days that a scan's filter names, at most; days that lie nearest
#: to each other share one beyond it.
MOST_RANGES = 64


def half_up(numerator: str, denominator: int, digits: int) -> Column:
    """Exact half-up rounding of ``numerator / denominator`` to ``digits``
    places, for a non-negative whole-number column named ``numerator``.

    Integer division (``div``) keeps the arithmetic exact at any magnitude a
    bigint holds; a double ``round`` would meet binary-fraction ties.
    """
    scale = 10 ** digits
    # round(n / d, k) = ((2 n s + d) div (2 d)) / s  for n >= 0
    q = F.expr(f"(`{numerator}` * {2 * scale} + {denominator}) div {2 * denominator}")
    return q.cast("double") / F.lit(float(scale))


def daily_demand(lines: DataFrame, day: Column, is_veg: Column,
                 salad_units: Column | None = None, salad_divisor: int = 1,
                 site: Column | None = None, working_days_only: bool = True,
                 where: Column | None = None) -> DataFrame:
    """Daily meals per (site?, date): total, veg, non-veg, salad.

    ``day`` is the line's date, ``is_veg`` marks vegetarian lines (everything
    else is non-veg, nulls included), ``salad_units`` an integral per-line
    salad quantity whose sum divided by ``salad_divisor`` gives the salad
    weight, rounded half-up to two places. ``where`` is a predicate on the
    raw columns (e.g. the order timestamp from a cutoff on) applied before
    anything else, so it reaches the scan as a pushed filter and, on a
    date-partitioned fact table, prunes partitions: the incremental rollup.
    """
    if where is not None:
        lines = lines.filter(where)
    cols = [day.cast("date").alias("date"), is_veg.alias("_veg"),
            (salad_units if salad_units is not None else F.lit(0)).cast("bigint").alias("_salad")]
    keys = ["date"]
    if site is not None:
        cols.insert(0, site.alias("site_id"))
        keys = ["site_id", "date"]
    x = lines.select(*cols)
    if working_days_only:
        x = x.filter(is_working_day("date"))
    agg = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("actual_meals"),
        F.count_if(F.coalesce(F.col("_veg"), F.lit(False))).alias("actual_meals_veg"),
        F.sum("_salad").alias("_salad_sum"),
    )
    return agg.select(
        *keys,
        "actual_meals",
        "actual_meals_veg",
        (F.col("actual_meals") - F.col("actual_meals_veg")).alias("actual_meals_non_veg"),
        half_up("_salad_sum", salad_divisor, 2).alias("actual_meals_salad"),
    )


def daily_demand_by_site(lines: DataFrame, sites: DataFrame, line_key: str, site_key: str,
                         site_col: str, day: Column, is_veg: Column,
                         salad_units: Column | None = None, salad_divisor: int = 1,
                         working_days_only: bool = True) -> DataFrame:
    """AIM-1 with the site taken from a dimension joined on ``line_key``.

    Pre-aggregates per (line_key, date) before the join (skew guard), then
    re-aggregates per (site_id, date).
    """
    x = lines.select(F.col(line_key).alias("_k"), day.cast("date").alias("date"),
                     is_veg.alias("_veg"),
                     (salad_units if salad_units is not None else F.lit(0)).cast("bigint").alias("_salad"))
    if working_days_only:
        x = x.filter(is_working_day("date"))
    pre = x.groupBy("_k", "date").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.coalesce(F.col("_veg"), F.lit(False))).alias("_nv"),
        F.sum("_salad").alias("_s"),
    )
    dim = sites.select(F.col(site_key).alias("_k"), F.col(site_col).alias("site_id"))
    joined = pre.join(dim, "_k", "left")  # lines of an unknown site keep a null site
    agg = joined.groupBy("site_id", "date").agg(
        F.sum("_n").alias("actual_meals"), F.sum("_nv").alias("actual_meals_veg"),
        F.sum("_s").alias("_salad_sum"))
    return agg.select(
        "site_id", "date", "actual_meals", "actual_meals_veg",
        (F.col("actual_meals") - F.col("actual_meals_veg")).alias("actual_meals_non_veg"),
        half_up("_salad_sum", salad_divisor, 2).alias("actual_meals_salad"),
    )


def touched_days(lines: DataFrame, day: str, arrived: str, since: Column | None = None) -> DataFrame:
    """(date, arrived_until, lines) of the days that lines which arrived after
    ``since`` (a constant of the column's type) belong to; without ``since``,
    of all. The filter on ``arrived`` reaches the scan."""
    if since is not None:
        lines = lines.filter(F.col(arrived) > since)
    return lines.groupBy(F.col(day).cast("date").alias("date")).agg(
        F.max(arrived).alias("arrived_until"), F.count(F.lit(1)).alias("lines"))


def day_ranges(days: Sequence[dt.date], most: int = MOST_RANGES) -> list[tuple[dt.date, dt.date]]:
    """At most ``most`` ranges (first day, last day) that hold the days: runs
    of neighbours, and where these are more, the nearest runs together."""
    days = sorted(set(days))
    if not days:
        return []
    gaps = sorted(((b - a).days, b) for a, b in zip(days, days[1:]))
    starts = sorted(b for gap, b in gaps[max(0, len(gaps) - most + 1):] if gap > 1)
    ends = [max(d for d in days if d < s) for s in starts] + [days[-1]]
    return list(zip([days[0], *starts], ends))


def lines_of_days(lines: DataFrame, day: str, days: Sequence[dt.date]) -> DataFrame:
    """The lines of the named days. ``day`` is a date or timestamp column; it
    is compared as it is, in ranges, so that the scan skips the others."""
    kind = lines.schema[day].dataType.simpleString()
    ranges = [(F.col(day) >= F.lit(a).cast(kind)) & (F.col(day) < F.lit(b + dt.timedelta(days=1)).cast(kind))
              for a, b in day_ranges(days)]
    if not ranges:
        return lines.filter(F.lit(False))
    return lines.filter(reduce(Column.__or__, ranges)).filter(F.col(day).cast("date").isin(sorted(set(days))))


def _as_text(time: Column, kind: str) -> Column:
    return F.unix_micros(time).cast("string") if kind == "timestamp" else time.cast("string")


def _of_text(text: str, kind: str) -> Column:
    """The constant that ``_as_text`` wrote, whatever the session's time zone."""
    return F.timestamp_micros(F.lit(int(text))) if kind == "timestamp" else F.lit(text).cast(kind)


def refresh_daily(root: str, lines: DataFrame, day: str, arrived: str, rollup: Callable[[DataFrame], DataFrame],
                  keys: Sequence[str] = ("date",)) -> dict:
    """AIM-1 maintained: bring the published daily table at ``root`` up to the
    lines that have arrived, and say what was done: ``days`` (recomputed) and
    ``lines`` (new ones).

    The table's version carries the arrival time up to which it counts. Lines
    that arrived later tell the touched days, whenever these were: only they
    are read again, whole, with ``rollup`` (of lines, one row per ``keys``),
    and replace the table's rows, written by month. Lines that arrive while
    this runs are left for the next time. Lines without a day or an arrival
    time are never counted. Only the touched days reach the driver: calendar
    days, whatever the number of lines. When another refresh publishes first,
    this one begins anew."""
    spark, kind = lines.sparkSession, lines.schema[arrived].dataType.simpleString()
    for _ in range(ATTEMPTS):
        base = current_version(spark, root)
        known = base.note.get("arrived_until") if base else None
        touched = touched_days(lines, day, arrived, _of_text(known, kind) if known else None)
        found = touched.filter("arrived_until IS NOT NULL").withColumn("text", _as_text(F.col("arrived_until"), kind)).collect()
        if not found:
            return {"days": [], "lines": 0}
        until = max(found, key=lambda r: r["arrived_until"])["text"]
        days = sorted(r["date"] for r in found if r["date"] is not None)
        counted = lines_of_days(lines, day, days).filter(F.col(arrived) <= _of_text(until, kind))
        ok, error = upsert_into(spark, root, rollup(counted), keys, note={"arrived_until": until}, base=base)
        if ok:
            return {"days": days, "lines": sum(r["lines"] for r in found)}
        if current_version(spark, root) == base:
            raise RuntimeError(error)
    raise RuntimeError(f"{ATTEMPTS} other versions of {root} came first")
