"""Weather expressions (FN-2, FN-9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from platewise.constants import WEATHER_BANDS, WEATHER_DEFAULT


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _band_chain(code: Column, pick: int) -> Column:
    expr = None
    for lo, hi, icon, label in WEATHER_BANDS:
        value = F.lit(icon if pick == 0 else label)
        cond = code.between(lo, hi)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr.otherwise(F.lit(WEATHER_DEFAULT[pick]))


def weather_icon(code) -> Column:
    return _band_chain(_col(code), 0)


def weather_condition(code) -> Column:
    """FN-2: weather code -> Sunny / Cloudy / Rainy / Snowy / Stormy."""
    return _band_chain(_col(code), 1)


def weather_category(code) -> Column:
    """FN-2 as ``struct(weather_icon, weather_condition)``."""
    c = _col(code)
    return F.struct(weather_icon(c).alias("weather_icon"),
                    weather_condition(c).alias("weather_condition"))


def weather_label(temperature, condition_label, icon=None) -> Column:
    """FN-9: ``"<icon><t>°C <label>"`` (the icon is optional); no label when
    the temperature is 0 or null."""
    t = _col(temperature)
    parts = ([_col(icon)] if icon is not None else []) + [t.cast("string"), F.lit("°C "), _col(condition_label)]
    return F.when(t.isNotNull() & (t != 0), F.concat(*parts))
