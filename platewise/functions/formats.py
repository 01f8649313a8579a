"""Display, flag and parsing expressions (PRJ-7, PRJ-8, PRJ-9, FN-8, FN-10,
FN-11, FN-12, FN-13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from platewise.schemas import INSIGHTS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pct_display(ratio) -> Column:
    """PRJ-7: ratio -> whole percent, rounded half to even (not half up)."""
    return F.bround(_col(ratio) * F.lit(100.0), 0)


def sign_class(v) -> Column:
    """FN-10: ``green`` above zero, else ``red`` (zero and null are red)."""
    return F.when(_col(v) > 0, F.lit("green")).otherwise(F.lit("red"))


def to_flag(c) -> Column:
    """PRJ-8: number / bool / TRUE-FALSE text -> boolean, null -> false; a
    number other than zero is true."""
    c = _col(c)
    text = F.upper(F.trim(c.cast("string")))
    return F.coalesce(
        F.when(text.isin("TRUE", "T", "YES", "Y", "1"), F.lit(True))
         .when(text.isin("FALSE", "F", "NO", "N", "0"), F.lit(False))
         .otherwise(text.try_cast("double") != 0),
        F.lit(False),
    )


def blank_if_null(c) -> Column:
    """PRJ-8: null description -> empty string."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def int_or_zero(c) -> Column:
    """PRJ-9: fill 0, then whole number."""
    return F.coalesce(_col(c), F.lit(0)).cast("bigint")


def thousands(v) -> Column:
    """FN-11: integer with thousands separators, ``1,234``."""
    return F.format_number(_col(v).cast("bigint"), 0)


def _one_place(v, fmt: str) -> Column:
    """Round half-even to one place, then format; a negative value that
    rounds to zero keeps its sign (``-0.0``), as number formatting does."""
    v = _col(v)
    r = F.bround(v, 1)
    text = F.format_string(fmt, r)
    return F.when((v < 0) & (r == 0), F.regexp_replace(text, "^[+]?", "-")).otherwise(text)


def one_decimal(v, suffix: str = "") -> Column:
    """FN-11: ``12.3`` (value rounded half-even to one place first)."""
    return _one_place(v, "%.1f" + suffix.replace("%", "%%"))


def signed_one_decimal(v) -> Column:
    """FN-11: KPI delta text, ``+1.5`` / ``-0.3`` / ``-0.0``."""
    return _one_place(v, "%+.1f")


def day_label(is_school_break, is_bridge_day, description, translated=None,
              generic_break="School Break", generic_bridge="Bridge Day") -> Column:
    """FN-8: one label per day.

    A school break wins over a bridge day, which wins over a plain holiday
    description; the translated description is preferred over the generic
    word. Empty descriptions count as absent.
    """
    if isinstance(generic_break, str):
        generic_break = F.lit(generic_break)
    if isinstance(generic_bridge, str):
        generic_bridge = F.lit(generic_bridge)
    desc = _col(description)
    text = F.nullif(F.coalesce(_col(translated), desc) if translated is not None else desc, F.lit(""))
    return (F.when(F.coalesce(_col(is_school_break), F.lit(False)), F.coalesce(text, generic_break))
             .when(F.coalesce(_col(is_bridge_day), F.lit(False)), F.coalesce(text, generic_bridge))
             .otherwise(text))


def strip_code_fence(text) -> Column:
    """FN-13: drop the first and last line when the text starts with a fence."""
    t = F.trim(_col(text))
    lines = F.split(t, "\n")
    inner = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    return F.when(t.startswith("```"), inner).otherwise(t)


def parse_insights(text) -> Column:
    """FN-13: parse ``[{type,title,message}]``; on failure a one-element
    array holding the raw text as an ``info`` message.

    ``from_json`` in PERMISSIVE mode yields null for malformed input, so no
    row ever fails the job.
    """
    body = strip_code_fence(text)
    parsed = F.from_json(body, INSIGHTS)
    raw = F.array(F.struct(F.lit("info").alias("type"), F.lit(None).cast("string").alias("title"),
                           _col(text).alias("message")))
    return F.when(parsed.isNotNull(), parsed).otherwise(raw)
