"""Workflow API: the application's data calls as Spark operations over
published tables.

``Store`` names the table roots (predictions, actuals, holidays) under one
shared base folder; every write is an upsert published as a new table
version (``sinks.tables.publish``), every read returns a lazy DataFrame.
Functions mirror the application's calls (save a forecast, save actuals,
list missing actuals, compare a period, metrics, ratios, prepare features,
score, validate an upload) so a user can switch call for call.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.operators import compare as C
from platewise.operators import features as FE
from platewise.operators import ml as ML
from platewise.operators import split as SP
from platewise.operators import upsert as UP
from platewise.operators import validate as V
from platewise.schemas import ACTUAL_COLUMNS, ACTUAL_SALES, HOLIDAYS, PREDICTION_COLUMNS, PREDICTIONS
from platewise.sinks.tables import change_table, current_version, publish, read_table, retain_versions, upsert_into
from platewise.streaming.ingest import bad_rows


class Store:
    """Table roots under ``base`` (a shared folder on a cluster)."""

    def __init__(self, spark: SparkSession, base: str, keys: Sequence[str] = ("date",)):
        self.spark, self.base, self.keys = spark, base, list(keys)

    def root(self, name: str) -> str:
        return os.path.join(self.base, name)

    def table(self, name: str, schema) -> DataFrame:
        """Current version, or an empty frame with the table schema (with the
        site key columns in front when the store is keyed by site)."""
        if current_version(self.spark, self.root(name)) is None:
            extra = [T.StructField(k, T.IntegerType()) for k in self.keys if k not in schema.names]
            return self.spark.createDataFrame([], T.StructType(extra + list(schema.fields)))
        return read_table(self.spark, self.root(name))

    def predictions(self) -> DataFrame:
        return self.table("predictions", PREDICTIONS)

    def actuals(self) -> DataFrame:
        return self.table("actual_sales", ACTUAL_SALES)

    def holidays(self) -> DataFrame:
        return self.table("holidays", HOLIDAYS)


def _save(store: Store, name: str, rows: DataFrame, order_col: str | None) -> tuple[bool, str | None]:
    """Only the months of ``rows`` are written; two savers at once both end in
    the table. A batch that holds a key twice must say which of its rows is
    the last."""
    return upsert_into(store.spark, store.root(name), rows, store.keys, order_col, repeats=False,
                       schema=store.table(name, {"predictions": PREDICTIONS, "actual_sales": ACTUAL_SALES}[name]).schema)


def save_prediction(store: Store, df: DataFrame, order_col: str | None = None) -> tuple[bool, str | None]:
    """Upsert a forecast batch: override columns ensured, final prediction
    derived, full-row replace per key, the last row by ``order_col`` winning;
    ``(ok, error)``. The newest ten versions stay."""
    try:
        rows = SP.with_final_prediction(df).select(*store.keys, *[c for c in PREDICTION_COLUMNS
                                                                  if c not in store.keys],
                                                   *([order_col] if order_col else []))
        return _save(store, "predictions", rows, order_col)
    except Exception as e:  # noqa: BLE001
        return False, str(e)


def save_actuals(store: Store, df: DataFrame, order_col: str | None = None) -> tuple[bool, str | None]:
    """Upsert actual sales (key + four counts), the last row by ``order_col``
    winning; ``(ok, error)``. The newest ten versions stay."""
    try:
        rows = df.select(*store.keys, *ACTUAL_COLUMNS, *([order_col] if order_col else []))
        return _save(store, "actual_sales", rows, order_col)
    except Exception as e:  # noqa: BLE001
        return False, str(e)


def seed_holidays(store: Store, df: DataFrame) -> tuple[bool, str | None]:
    """Append holiday rows (the table has no key; readers deduplicate)."""
    return change_table(store.spark, store.root("holidays"), lambda t: df if t is None else UP.append(t, df))


def get_holidays(store: Store, start, end) -> DataFrame:
    return C.date_range(store.holidays(), start, end)


def get_future_predictions(store: Store, as_of) -> DataFrame:
    """Predictions from Monday of the ``as_of`` week on, in date order."""
    return C.from_week_start(store.predictions(), as_of).orderBy(*store.keys)


def get_missing_actuals(store: Store) -> DataFrame:
    return C.missing_actuals(store.predictions(), store.actuals(), store.keys).orderBy(*store.keys)


def get_actuals_and_predictions(store: Store, start, end) -> DataFrame:
    return C.join_actuals(store.predictions(), store.actuals(), start, end, store.keys, ordered=True)


def calculate_metrics(df: DataFrame, tolerance: float = 0.05, tolerance_unit: str = "percent",
                      by: Sequence[str] = ()) -> DataFrame:
    return C.metrics(df, by=by, tolerance=tolerance, tolerance_unit=tolerance_unit)


def compare_periods(store: Store, start, end) -> DataFrame:
    """The analysis page: the period and the equally long one before it."""
    return C.period_over_period(store.predictions(), store.actuals(), start, end, store.keys)


def get_empirical_veg_ratio(store: Store) -> DataFrame:
    """Ratios per theme (per site with site keys), fallbacks applied."""
    themes = store.spark.createDataFrame([(t,) for t in ("Sausage", "Vital", "Chicken", "Schnitzel", "Fish")],
                                         "day_theme string")
    ratios = SP.theme_ratios(store.actuals(), store.keys)
    if len(store.keys) > 1:
        return ratios
    return SP.with_theme_ratio(themes, ratios)


def prepare_data(spark: SparkSession, start, n: int, weather: DataFrame, holidays: DataFrame) -> DataFrame:
    """Business days from ``start`` with calendar, weather and holiday features."""
    from platewise.functions.calendar import business_days
    dates = spark.range(1).select(F.explode(business_days(start, n)).alias("date"))
    return FE.prepare_features(dates, weather, holidays)


def get_prediction(store: Store, model: PipelineModel, features: Sequence[str], frame: DataFrame,
                   as_of) -> DataFrame:
    """Score a prepared frame and split it with the empirical ratios."""
    return ML.score(model, frame, features, SP.theme_ratios(store.actuals(), store.keys), as_of, store.keys)


def csv_validation(df: DataFrame, keys: Sequence[str] = ("date",),
                   site: dict | None = None) -> tuple[bool, str | None, DataFrame | None]:
    """Validate one uploaded file (all columns as text): columns, values,
    sums, in that order. Keys besides the date are columns of the file, or
    ``site`` gives their values (an upload for one site). Returns ``(ok,
    message, rows)``: the typed rows of a good file, else all its offending
    rows with their position and errors; only the one-row verdict reaches the
    driver."""
    others = [k for k in keys if k != "date"]
    lower = {c.lower(): c for c in df.columns}
    for k in others:
        if k in (site or {}):
            df = df.withColumn(lower.get(k.lower(), k), F.lit(str(site[k])))
        elif k.lower() in lower:
            df = df.withColumnRenamed(lower[k.lower()], k)
        else:
            return False, f"missing columns: {k}", None
    try:
        resolved = V.resolve_columns(df, keep=others)
    except V.ColumnError as e:
        return False, str(e), None
    rows = V.validate_rows(V.with_ordinal(resolved).withColumn("batch", F.lit("upload")), keys=others)
    v = V.validate_batches(rows).first()
    good = rows.select(*others, "date", *V.VALUE_COLUMNS)
    if v is None:
        return True, None, good  # empty upload
    if v["status"] == "invalid_values":
        return False, f"invalid values in {v['value_error_rows']} rows", bad_rows(rows)
    if v["status"] == "sum_mismatch":
        return False, f"total differs from veg + non-veg in {v['sum_error_rows']} rows " \
                      f"(first at row {v['first_bad_row']})", bad_rows(rows)
    return True, None, good


def seed_actuals_from_file(store: Store, path: str, site: dict | None = None) -> tuple[bool, str | None]:
    """Seed script: the history file appended to the actuals table (total_day
    / veg / non_veg become the three counts; no salad). As the table's key
    demands, a day that the table or the file has already is refused, and so
    are rows that cannot be read; a store keyed by site needs the ``site``
    (its key columns' values)."""
    from platewise.sources.files import read_sales, rejected_sales
    others = [k for k in store.keys if k != "date"]
    if set(others) != set(site or {}):
        return False, f"the store is keyed by {others}: give the site"
    bad = rejected_sales(store.spark, path).count()
    if bad:
        return False, f"{bad} rows have a date or count that cannot be read (rejected_sales lists them)"
    rows = read_sales(store.spark, path).select(
        *[F.lit(site[k]).cast("int").alias(k) for k in others],
        "date", F.col("total_meals").alias("actual_meals"), F.col("veg").alias("actual_meals_veg"),
        F.col("non_veg").alias("actual_meals_non_veg"), F.lit(None).cast("double").alias("actual_meals_salad"))
    if not UP.repeated_keys(rows, store.keys).isEmpty():
        return False, f"the file has a {'/'.join(store.keys)} twice"

    def seeded(table: DataFrame | None) -> DataFrame:
        table = table if table is not None else store.actuals()
        if not rows.join(table.select(*store.keys), store.keys, "left_semi").isEmpty():
            raise ValueError(f"a {'/'.join(store.keys)} of the file is in the table already")
        return UP.append(table, rows)

    return change_table(store.spark, store.root("actual_sales"), seeded)


def seed_holidays_from_file(store: Store, path: str) -> tuple[bool, str | None]:
    """Seed script: the holiday CSV appended to the holidays table."""
    from platewise.sources.files import read_holidays
    return seed_holidays(store, read_holidays(store.spark, path))


def delete_all_actuals(store: Store) -> tuple[bool, str | None]:
    """Maintenance script: empty the actuals table (a new, empty version)."""
    ok, error = publish(store.actuals().limit(0), store.root("actual_sales"))
    if ok:
        retain_versions(store.spark, store.root("actual_sales"), 10)
    return ok, error


def get_last_prediction_info(store: Store) -> DataFrame:
    """Latest prediction batch: timestamp, first and last date (one row)."""
    return C.last_prediction_info(store.predictions(), by=[k for k in store.keys if k != "date"])


def load_model_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Training timestamp of a published model (null when missing)."""
    from platewise.sources.files import read_model_metadata
    return read_model_metadata(spark, path)
