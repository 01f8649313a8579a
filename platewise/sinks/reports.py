"""Report outputs (SNK-6, SNK-9, SNK-10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.constants import REPORT_DROP


def us_short_date(c) -> F.Column:
    """``m/d/yy`` text, with or without leading zeros, -> date with the POSIX
    two-digit-year pivot (69-99 -> 19xx, 00-68 -> 20xx); Spark's ``yy`` alone
    maps all to 20xx. Other text gives null (see ``rejected_dates``)."""
    d = F.try_to_timestamp(F.trim(c if not isinstance(c, str) else F.col(c)), F.lit("M/d/yy")).cast("date")
    return F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)


def rejected_dates(df: DataFrame, column: str = "date") -> DataFrame:
    """The rows whose date text ``us_short_date`` cannot read: what a caller
    puts into quarantine instead of losing the date."""
    return df.filter(F.col(column).isNotNull() & us_short_date(column).isNull())


def normalise_dates(df: DataFrame, column: str = "date") -> DataFrame:
    """SNK-6: ``m/d/y`` dates rewritten as ISO ``yyyy-MM-dd`` text."""
    return df.withColumn(column, F.date_format(us_short_date(column), "yyyy-MM-dd"))


def clean_cells(df: DataFrame) -> DataFrame:
    """Newlines in text cells become spaces (one line per table row)."""
    return df.withColumns({f.name: F.regexp_replace(F.col(f.name), "[\\n\\r]", " ")
                           for f in df.schema.fields if isinstance(f.dataType, T.StringType)})


def report_table(df: DataFrame, display_columns: dict[str, str],
                 drop: Sequence[str] = REPORT_DROP) -> DataFrame:
    """SNK-9 / PRJ-10: drop the listed columns that exist (Q17), keep the
    display columns that remain in display order, rename them to their
    labels."""
    present = [c for c in df.columns if c not in set(drop)]
    keep = [c for c in display_columns if c in present]
    return clean_cells(df.select(*[F.col(c).alias(display_columns[c]) for c in keep]))


def json_payload(df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """SNK-10: the rows as JSON objects; with ``group``, one JSON array per
    group (groups are bounded periods, e.g. a planning week)."""
    obj = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    if not group:
        return df.select(obj.alias("json"))
    g = df.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col("date"), obj.alias("o")))).alias("_x"))
    return g.select(*group, F.concat(F.lit("["), F.array_join(F.transform("_x", lambda x: x["o"]), ","),
                                     F.lit("]")).alias("json"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header, no index column."""
    df.write.mode("errorifexists").option("header", True).csv(path)
