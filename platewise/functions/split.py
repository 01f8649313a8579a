"""Veg / non-veg split (FN-3, FN-4) and final prediction (PRJ-3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_total(total, veg_ratio) -> Column:
    """FN-3: ``veg = ceil(total * r)``, ``non_veg = int(total) - veg``.

    The two parts always add up to the (integer) total. The product is a
    double, so e.g. ``100 * 0.07`` ceils to 8: the same double arithmetic as
    any other engine evaluating the rule.
    """
    t = _col(total)
    veg = F.ceil(t.cast("double") * _col(veg_ratio)).cast("bigint")
    return F.struct(veg.alias("veg"), (t.cast("bigint") - veg).alias("non_veg"))


def ceil_prediction(raw) -> Column:
    """FN-4: model output rounded up to whole meals."""
    return F.ceil(_col(raw)).cast("bigint")


def final_prediction(override="override_meal_prediction", predicted="predicted_meals") -> Column:
    """PRJ-3: the override when present, else the model prediction."""
    return F.coalesce(_col(override).cast("bigint"), _col(predicted).cast("bigint"))
