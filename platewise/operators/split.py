"""Veg / non-veg split from history (AGG-5, JON-5, FN-3, PRJ-3, PRJ-11).

The per-row history query of a naive implementation (one full scan of the
actuals per forecast row) becomes one grouped aggregate joined back once.
The ratio table holds at most five rows (themes) per site, so it is a
small-side join; it is hinted for broadcast only when there is no site key
(then it is five rows, a fixed bound). With sites, the planner and AQE pick
the strategy from measured sizes.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.constants import DEFAULT_RATIO, THEME_RATIOS
from platewise.functions.calendar import day_theme
from platewise.functions.split import final_prediction, split_total


def _site_keys(keys: Sequence[str] | None) -> list[str]:
    return [k for k in (keys or ["date"]) if k != "date"]


def theme_ratios(actuals: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    """AGG-5: empirical veg share per (site?, theme) from history.

    Only rows with both counts present are used (FLT-5); the theme comes from the
    row's date. ``veg_ratio`` is ``avg(veg) / (avg(veg) + avg(non_veg))`` and
    null when that total is zero (the caller falls back).
    """
    site = _site_keys(keys)
    hist = actuals.filter(F.col("actual_meals_veg").isNotNull() & F.col("actual_meals_non_veg").isNotNull())
    agg = (hist.withColumn("day_theme", day_theme("date"))
               .filter(F.col("day_theme").isNotNull())
               .groupBy(*site, "day_theme")
               .agg(F.avg("actual_meals_veg").alias("avg_veg"),
                    F.avg("actual_meals_non_veg").alias("avg_non_veg")))
    total = F.nullif(F.col("avg_veg") + F.col("avg_non_veg"), F.lit(0.0))
    return agg.select(*site, "day_theme",
                      (F.col("avg_veg") / total).alias("veg_ratio"),
                      (F.col("avg_non_veg") / total).alias("non_veg_ratio"))


def _fallback(theme_col: str, pick: int):
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(
        (k, v[pick]) for k, v in THEME_RATIOS.items())])
    return F.coalesce(m[F.col(theme_col)], F.lit(DEFAULT_RATIO[pick]))


def with_theme_ratio(df: DataFrame, ratios: DataFrame, keys: Sequence[str] = ("date",),
                     theme_col: str = "day_theme") -> DataFrame:
    """JON-5: attach (veg_ratio, non_veg_ratio): empirical, else the fixed
    theme ratio, else (0.5, 0.5)."""
    site = _site_keys(keys)
    # renamed copies of the key columns keep the join free of self-join
    # ambiguity when both sides come from the same source
    r = ratios.select(*[F.col(k).alias(f"_r_{k}") for k in site], F.col("day_theme").alias("_theme"),
                      F.col("veg_ratio").alias("_emp_veg"), F.col("non_veg_ratio").alias("_emp_non_veg"))
    if not site:
        r = F.broadcast(r)  # at most one row per theme: a fixed bound
    cond = [F.col(k) == F.col(f"_r_{k}") for k in site] + [F.col(theme_col) == F.col("_theme")]
    j = df.join(r, cond, "left")
    return j.withColumns({
        "veg_ratio": F.coalesce(F.col("_emp_veg"), _fallback(theme_col, 0)),
        "non_veg_ratio": F.coalesce(F.col("_emp_non_veg"), _fallback(theme_col, 1)),
    }).drop("_theme", "_emp_veg", "_emp_non_veg", *[f"_r_{k}" for k in site])


def split_forecast(df: DataFrame, ratios: DataFrame, keys: Sequence[str] = ("date",),
                   total_col: str = "predicted_meals", keep_ratio: bool = False) -> DataFrame:
    """FN-3 over a frame: predicted_meals_veg / _non_veg from the theme ratio."""
    j = with_theme_ratio(df, ratios, keys)
    j = j.withColumn("_split", split_total(F.col(total_col), F.col("veg_ratio")))
    j = j.withColumns({"predicted_meals_veg": F.col("_split.veg"),
                       "predicted_meals_non_veg": F.col("_split.non_veg")}).drop("_split")
    return j if keep_ratio else j.drop("veg_ratio", "non_veg_ratio")


def with_final_prediction(df: DataFrame) -> DataFrame:
    """PRJ-3 (+ PRJ-4): ensure override columns exist, then
    ``final_prediction = coalesce(override, predicted)``."""
    if "override_meal_prediction" not in df.columns:
        df = df.withColumn("override_meal_prediction", F.lit(None).cast("bigint"))
    if "override_reason" not in df.columns:
        df = df.withColumn("override_reason", F.lit(None).cast("string"))
    return df.withColumn("final_prediction", final_prediction())


def apply_overrides(forecast: DataFrame, overrides: DataFrame, ratios: DataFrame,
                    keys: Sequence[str] = ("date",)) -> DataFrame:
    """PRJ-11: apply manual overrides to a reviewed forecast.

    ``overrides`` has ``keys``, ``override_meal_prediction``,
    ``override_reason`` and optionally ``predicted_meals_salad`` (salad is
    captured for every row; missing -> 0). Rows with an override get veg /
    non-veg re-split on the override total with the same theme ratio; rows
    without one get null override columns. ``final_prediction`` follows.
    """
    keys = list(keys)
    cols = [c for c in ("override_meal_prediction", "override_reason", "predicted_meals_salad")
            if c in overrides.columns]
    o = overrides.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in cols])
    base = forecast.drop("override_meal_prediction", "override_reason", "final_prediction")
    j = base.join(o, keys, "left")
    j = with_theme_ratio(j, ratios, keys)
    ov = F.col("_o_override_meal_prediction").cast("bigint") if "override_meal_prediction" in cols \
        else F.lit(None).cast("bigint")
    reason = F.col("_o_override_reason") if "override_reason" in cols else F.lit(None).cast("string")
    salad_src = F.col("_o_predicted_meals_salad") if "predicted_meals_salad" in cols else F.lit(None)
    resplit = split_total(ov, F.col("veg_ratio"))
    j = j.withColumns({
        "predicted_meals_salad": F.coalesce(salad_src.cast("double"), F.lit(0.0)),
        "predicted_meals_veg": F.when(ov.isNotNull(), resplit["veg"]).otherwise(F.col("predicted_meals_veg")),
        "predicted_meals_non_veg": F.when(ov.isNotNull(), resplit["non_veg"]).otherwise(F.col("predicted_meals_non_veg")),
        "override_meal_prediction": ov,
        "override_reason": F.when(ov.isNotNull(), reason),
    })
    j = j.drop(*[f"_o_{c}" for c in cols], "veg_ratio", "non_veg_ratio")
    return with_final_prediction(j)
