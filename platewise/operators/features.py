"""Feature engineering: calendar, weather, holidays (PRJ-2, FLT-3, FLT-4,
FLT-6, JON-1, JON-2, PRJ-8, GEN-1, ML-7).

Joins with dimensions keyed by date (weather, holidays) are small-side
joins: one row per calendar date (per site), a bound that grows with the
calendar, not with the fact volume. Holidays are broadcast explicitly (one
row per date after the dedupe below: 36,500 rows cover a century). Weather
is left to the planner / AQE because per-site weather grows with the number
of sites.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.functions.calendar import business_days, day_theme, month_name, weekday_name
from platewise.functions.formats import blank_if_null, to_flag
from platewise.functions.weather import weather_category

def add_calendar(df: DataFrame, date_col: str = "date") -> DataFrame:
    """PRJ-2: weekday and month names and the menu theme."""
    d = F.col(date_col)
    return df.withColumns({
        "weekday": weekday_name(d),
        "month": month_name(d),
        "day_theme": day_theme(d),
    })


def require_working_days(df: DataFrame, date_col: str = "date", strict: bool = True) -> DataFrame:
    """FLT-3: working days only.

    ``strict`` fails the job on a weekend date: the date column itself is
    rewritten as ``when(weekday < 5, date).otherwise(raise_error(...))``, so
    the guard runs inside the same job as the rest of the plan (no probe job)
    and, being a projection rather than a filter, is never copied to the
    other side of a later join. Otherwise weekend rows are filtered out.
    """
    ok = F.weekday(F.col(date_col)) < 5
    if strict:
        guard = F.raise_error(F.lit("dates must only contain weekdays (Mon–Fri)")).cast("date")
        return df.withColumn(date_col, F.when(ok | F.col(date_col).isNull(), F.col(date_col)).otherwise(guard))
    return df.filter(ok)


def dates_frame(starts: DataFrame, n, start_col: str = "start_date",
                keep: Sequence[str] = ()) -> DataFrame:
    """GEN-1 as a frame: one row per business day for each start row.

    ``n`` is an int or a column of ``starts``. The explode is bounded by
    ``n`` per input row, so it partitions like its input.
    """
    count = F.col(n) if isinstance(n, str) else n
    return starts.select(*keep, F.col(start_col), F.explode(business_days(F.col(start_col), count)).alias("date"))


def weather_days(weather: DataFrame, code_col: str = "weather_code") -> DataFrame:
    """Weather rows with the FN-2 category attached."""
    return weather.withColumn("_cat", weather_category(F.col(code_col))).select(
        "*", "_cat.weather_icon", "_cat.weather_condition").drop("_cat")


def join_weather(df: DataFrame, weather: DataFrame, keys: Sequence[str] = ("date",),
                 columns: Sequence[str] = ("weather_icon", "temperature_max", "weather_condition")) -> DataFrame:
    """JON-1: left join of daily weather; unmatched rows keep nulls."""
    keys = list(keys)
    w = weather.select(*keys, *columns)
    return df.join(w, keys, "left")


def clean_holidays(holidays: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    """Holidays with boolean flags and at most one row per key (Q13).

    The table has no key; a repeated seed would fan out the left join. Rows
    sharing a date are merged: flags OR-ed, the smallest description kept.
    """
    keys = list(keys)
    return holidays.groupBy(*keys).agg(
        F.min("description").alias("description"),
        F.bool_or(to_flag("is_bank_holiday")).alias("is_bank_holiday"),
        F.bool_or(to_flag("is_school_break")).alias("is_school_break"),
        F.bool_or(to_flag("is_bridge_day")).alias("is_bridge_day"),
    )


def join_holidays(df: DataFrame, holidays: DataFrame, keys: Sequence[str] = ("date",),
                  rename_description: str = "holiday_desc", dedupe: bool = True) -> DataFrame:
    """JON-2: left join of holidays on date.

    Keyed by date alone the deduplicated table holds at most one row per
    calendar date (36,600 rows cover a century), so it is broadcast; with
    site-specific holidays (more keys) it grows with the sites and the
    planner / AQE choose the strategy from measured sizes.
    """
    keys = list(keys)
    h = clean_holidays(holidays, keys) if dedupe else holidays
    h = h.select(*keys, F.col("description").alias(rename_description),
                 "is_bank_holiday", "is_school_break", "is_bridge_day")
    return df.join(F.broadcast(h) if dedupe and keys == ["date"] else h, keys, "left")


def exclude_bank_holidays(df: DataFrame, flag: str = "is_bank_holiday", drop: bool = True) -> DataFrame:
    """FLT-4: keep rows whose bank-holiday flag is false or null."""
    out = df.filter(~F.coalesce(F.col(flag), F.lit(False)))
    return out.drop(flag) if drop else out


def fill_day_flags(df: DataFrame, flags: Sequence[str] = ("is_school_break", "is_bridge_day"),
                   description: str = "holiday_desc") -> DataFrame:
    """PRJ-8: flags to boolean with null -> false, description null -> ''."""
    cols = {f: to_flag(f) for f in flags}
    cols[description] = blank_if_null(description)
    return df.withColumns(cols)


def missing_weather(df: DataFrame, strict: bool = False) -> DataFrame:
    """FLT-6: rows lacking temperature or condition.

    Returns the offending rows; ``strict`` raises ``ValueError`` instead (the
    training guard). The message gives the number of such days and the first
    of them, from one job; the full list is ``missing_weather(df)``.
    """
    bad = F.col("temperature_max").isNull() | F.col("weather_condition").isNull()
    if strict:
        n, first = df.filter(bad).agg(F.count(F.lit(1)), F.min("date")).first()
        if n:
            raise ValueError(f"Missing weather data for {n} dates, first: {first}; "
                             "missing_weather(df) lists all of them")
        return df
    return df.filter(bad)


def prepare_features(dates: DataFrame, weather: DataFrame, holidays: DataFrame,
                     keys: Sequence[str] = ("date",)) -> DataFrame:
    """ML-7: the inference frame for a set of business days.

    calendar -> weather -> holidays -> drop bank holidays -> clean flags. Bank
    holidays are removed after the days were counted, so a request for n days
    can return fewer rows (Q9).
    """
    keys = list(keys)
    df = require_working_days(dates, strict=True)
    df = add_calendar(df)
    df = join_weather(df, weather, keys)
    df = join_holidays(df, holidays, keys)
    df = exclude_bank_holidays(df)
    return fill_day_flags(df)

