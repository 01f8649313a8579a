"""Catalog sources (SRC-4, SRC-6, SRC-7, SRC-11)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from platewise.constants import THEME_RATIOS, WEEKDAY_THEMES


def _arg(v):
    if isinstance(v, str):
        try:
            return dt.date.fromisoformat(v)
        except ValueError:
            return v
    return v


def param_sql(spark: SparkSession, text: str, **params) -> DataFrame:
    """SRC-4: SQL with bound named parameters (``:name``), never string-pasted
    values; ISO date strings bind as dates."""
    return spark.sql(text, args={k: _arg(v) for k, v in params.items()})


def values(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """SRC-6: inline literal rows with an explicit schema."""
    return spark.createDataFrame(list(rows), schema)


def themes(spark: SparkSession) -> DataFrame:
    """SRC-7: the fixed theme dimension (weekday, theme, veg / non-veg ratio)."""
    rows = [(wd, th, THEME_RATIOS[th][0], THEME_RATIOS[th][1]) for wd, th in WEEKDAY_THEMES.items()]
    return spark.createDataFrame(rows, "weekday string, day_theme string, veg_ratio double, non_veg_ratio double")


def evolve(df: DataFrame, schema: T.StructType) -> DataFrame:
    """SRC-11: read an older table version under the current schema; columns
    added later appear as typed nulls (``ALTER TABLE ... ADD COLUMN``)."""
    from pyspark.sql import functions as F
    out = []
    for f in schema.fields:
        out.append(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
                   else F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*out)
