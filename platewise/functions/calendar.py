"""Calendar expressions (GEN-1, PRJ-1, PRJ-2, FN-1, FN-5, FN-6, FN-7, FLT-2).

All functions return Columns built from Spark built-ins, so they stay inside
whole-stage codegen. ``as_of`` is always a parameter (a date literal or a
column) instead of the wall clock, which keeps results reproducible.
"""

from __future__ import annotations

import datetime as _dt
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from platewise.constants import (
    GERMAN_MONTHS, GERMAN_MONTHS_SHORT, GERMAN_WEEKDAYS, GERMAN_WEEKDAYS_SHORT, WEEKDAY_THEMES,
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _date_lit(d) -> Column:
    if isinstance(d, Column):
        return d
    if isinstance(d, str):
        d = _dt.date.fromisoformat(d)
    return F.lit(d)


def _map_lit(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def weekday_name(d) -> Column:
    """Full English weekday name (``dayname`` only gives three letters)."""
    return F.date_format(_col(d), "EEEE")


def month_name(d) -> Column:
    """Full English month name."""
    return F.date_format(_col(d), "MMMM")


def day_theme(d) -> Column:
    """Menu theme of a date's weekday; null on weekends."""
    return _map_lit(WEEKDAY_THEMES)[weekday_name(d)]


def is_working_day(d) -> Column:
    """Monday to Friday (``weekday``: 0 = Monday)."""
    return F.weekday(_col(d)) < 5


def business_days(start, n) -> Column:
    """Array of the first ``n`` Mon-Fri dates on or after ``start`` (GEN-1).

    A weekend start rolls forward. ``n`` business days never span more than
    ``2n + 4`` calendar days, so the candidate sequence is bounded by ``n``.
    """
    s = _date_lit(start)
    n_col = n if isinstance(n, Column) else F.lit(int(n))
    candidates = F.sequence(s, F.date_add(s, n_col * 2 + 4))
    return F.slice(F.filter(candidates, lambda d: F.weekday(d) < 5), 1, n_col)


# --- PRJ-1: anything date-like -------------------------------------------------
# English month names by number.
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
               "November", "December"]

_ZONE = r"(?:\s*(?:Z|UTC|GMT|[+-]\d{2}:?\d{2}))?"
_TIME = rf"(?:(?:[T ]\s*|, *)\d{{1,2}}:\d{{2}}(?::\d{{2}}(?:[.,]\d+)?)?(?:\s*[AaPp][Mm])?{_ZONE})?"
_BASIC_TIME = rf"(?:T\d{{2}}(?:\d{{2}}(?:\d{{2}})?)?{_ZONE})?"
_NAME = "(" + "|".join(f"{m[:3]}(?:{m[3:]})?" if len(m) > 3 else m for m in MONTH_NAMES) + r")\.?"
_WEEKDAY = r"(?:(?:Mon|Tues?|Wed(?:nes)?|Thu(?:rs?)?|Fri|Sat(?:ur)?|Sun)(?:day)?\.?,?\s+)?"
_DAY, _ORDINAL, _YEAR = r"(\d{1,2})", r"(?:st|nd|rd|th)?", r"(\d{4}|\d{2})"
_SEP = r"([-/.])"

#: Shapes of a date: a pattern and the groups of year, month and day (0: the first).
#: Where both could be the month, the first number is, unless it is above 12.
_SHAPES = [
    (rf"^(\d{{4}}){_SEP}(\d{{1,2}})\2(\d{{1,2}}){_TIME}$", (1, 3, 4)),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}}){_BASIC_TIME}$", (1, 2, 3)),
    (rf"^(0?[1-9]|1[0-2]){_SEP}{_DAY}\2{_YEAR}{_TIME}$", (4, 1, 3)),
    (rf"^(1[3-9]|[23]\d){_SEP}(\d{{1,2}})\2{_YEAR}{_TIME}$", (4, 3, 1)),
    (rf"(?i)^{_WEEKDAY}{_DAY}{_ORDINAL}[-/ .]+{_NAME}(?:[-/ ,]+){_YEAR}{_TIME}$", (3, 2, 1)),
    (rf"(?i)^{_WEEKDAY}{_NAME}[-/ ]+{_DAY}{_ORDINAL}(?:,\s*|[-/ ]+)(\d{{4}}){_TIME}$", (3, 1, 2)),
    (rf"(?i)^(\d{{4}})[-/ ]{_NAME}[-/ ]{_DAY}{_TIME}$", (1, 2, 3)),
    (rf"(?i)^{_NAME}[-/ ,]+(\d{{4}})$", (2, 1, 0)),
    (r"^(\d{4})[-/](\d{1,2})$", (1, 2, 0)),
    (r"^(\d{4})$", (1, 0, 0)),
]


def _of_shape(text: Column, pattern: str, groups: tuple[int, int, int]) -> Column:
    """The date that ``text`` names if it has this shape and the day exists."""
    year, month, day = (F.regexp_extract(text, pattern, g) if g else F.lit("01") for g in groups)
    # two digits: 1969 to 2068
    year = F.when(F.length(year) == 2, F.concat(F.when(year >= "69", F.lit("19")).otherwise(F.lit("20")), year)).otherwise(year)
    number = F.create_map(*[x for i, m in enumerate(MONTH_NAMES) for x in (F.lit(m[:3].lower()), F.lit(f"{i + 1:02}"))])
    month = F.coalesce(number[F.lower(F.substring(month, 1, 3))], month)
    iso = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(text.rlike(pattern), iso.try_cast("date"))


def parse_date(c, fmt: str | None = None, strict: bool = True) -> Column:
    """PRJ-1: parse anything date-like to a date.

    ``strict`` raises on unparseable input; otherwise it yields null so the
    caller can quarantine the row: one grammar for both, and null is null.
    Read are ISO dates and time stamps (``T`` or a space, whole or part
    seconds or none; basic form too), numbers with ``-``, ``/`` or ``.``
    between them (the month first, unless that is above 12; two-digit years
    are 1969 to 2068), English month names, whole or short, before or after
    the day, with or without a weekday, and years and months alone (their
    first day). A time of day and a zone may follow: the written day counts.
    With ``fmt`` only that pattern is read."""
    c = _col(c)
    if fmt:
        read = F.try_to_timestamp(c, F.lit(fmt)).cast("date")
    else:
        text = F.trim(c.cast("string"))
        read = F.coalesce(*[_of_shape(text, p, g) for p, g in _SHAPES])
    if not strict:
        return read
    return F.when(c.isNotNull() & read.isNull(), F.raise_error(F.concat(F.lit("no date: "), c.cast("string"))).cast("date")) \
        .otherwise(read)


def weather_mode(end, as_of) -> Column:
    """FN-1: ``past`` when the last date lies before ``as_of``, else ``forecast``."""
    return F.when(_col(end) < _date_lit(as_of), F.lit("past")).otherwise(F.lit("forecast"))


def week_start(d) -> Column:
    """Monday of the week containing ``d``."""
    return F.date_trunc("week", _col(d) if not isinstance(d, (str, _dt.date)) else _date_lit(d)).cast("date")


def previous_period(start, end) -> Column:
    """FN-5: the equally long period right before [start, end].

    Returns ``struct(prev_start, prev_end)``; the previous period ends the day
    before ``start`` and spans ``datediff(end, start)`` days back from there.
    """
    s, e = _date_lit(start), _date_lit(end)
    prev_end = F.date_sub(s, 1)
    prev_start = F.date_sub(prev_end, F.datediff(e, s))
    return F.struct(prev_start.alias("prev_start"), prev_end.alias("prev_end"))


def last_full_week(as_of) -> Column:
    """FN-5: default analysis window, Monday to Friday of the previous week."""
    monday = F.date_sub(week_start(_date_lit(as_of)), 7)
    return F.struct(monday.alias("start"), F.date_add(monday, 4).alias("end"))


def german_weekday(d, short: bool = False) -> Column:
    return _map_lit(GERMAN_WEEKDAYS_SHORT if short else GERMAN_WEEKDAYS)[weekday_name(d)]


def german_month(d, short: bool = False) -> Column:
    return _map_lit(GERMAN_MONTHS_SHORT if short else GERMAN_MONTHS)[month_name(d)]


def date_label(d, style: str, lang: str = "EN") -> Column:
    """FN-7: the display date formats, English or German.

    ``style`` is one of ``long`` (Friday, 06. February), ``peak`` (Fri, Feb 06),
    ``chart`` (Fri 06/02), ``table`` (Fri, 06. February), ``compare``
    (Fri 02/06), ``compact`` (Fri, 06.February), ``stamp`` (2026-02-06 08:00).
    """
    d = _col(d)
    en = {
        "long": "EEEE, dd. MMMM",
        "peak": "EEE, MMM dd",
        "chart": "EEE dd/MM",
        "table": "EEE, dd. MMMM",
        "compare": "EEE MM/dd",
        "compact": "EEE, dd.MMMM",
        "stamp": "yyyy-MM-dd HH:mm",
    }
    if style not in en:
        raise ValueError(f"unknown date label style {style!r}")
    if lang.upper() == "EN" or style == "stamp":
        return F.date_format(d, en[style])
    if lang.upper() != "DE":
        raise ValueError(f"unsupported language {lang!r}")
    day = F.date_format(d, "dd")
    mon = F.date_format(d, "MM")
    wd, wds, mn = german_weekday(d), german_weekday(d, short=True), german_month(d)
    if style == "long":
        return F.concat(wd, F.lit(", "), day, F.lit(". "), mn)
    if style == "peak":
        return F.concat(wds, F.lit(", "), german_month(d, short=True), F.lit(" "), day)
    if style == "chart":
        return F.concat(wds, F.lit(" "), day, F.lit("/"), mon)
    if style == "table":
        return F.concat(wds, F.lit(", "), day, F.lit(". "), mn)
    if style == "compare":
        return F.concat(wds, F.lit(" "), mon, F.lit("/"), day)
    return F.concat(wds, F.lit(", "), day, F.lit("."), mn)
