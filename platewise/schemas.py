"""Table schemas (SRC-11) and typed empty-frame helpers."""

from __future__ import annotations

from pyspark.sql import types as T

HOLIDAYS = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("description", T.StringType()),
    T.StructField("is_bank_holiday", T.BooleanType()),
    T.StructField("is_school_break", T.BooleanType()),
    T.StructField("is_bridge_day", T.BooleanType()),
])

ACTUAL_SALES = T.StructType([
    T.StructField("date", T.DateType(), False),
    T.StructField("actual_meals", T.LongType()),
    T.StructField("actual_meals_veg", T.LongType()),
    T.StructField("actual_meals_non_veg", T.LongType()),
    T.StructField("actual_meals_salad", T.DoubleType()),
])

# Columns of the original predictions table, before the three added ones.
PREDICTIONS_BASE = T.StructType([
    T.StructField("date", T.DateType(), False),
    T.StructField("weekday", T.StringType()),
    T.StructField("month", T.StringType()),
    T.StructField("day_theme", T.StringType()),
    T.StructField("temperature_max", T.DoubleType()),
    T.StructField("weather_condition", T.StringType()),
    T.StructField("is_bridge_day", T.BooleanType()),
    T.StructField("is_school_break", T.BooleanType()),
    T.StructField("holiday_desc", T.StringType()),
    T.StructField("predicted_meals", T.LongType()),
    T.StructField("predicted_meals_veg", T.LongType()),
    T.StructField("predicted_meals_non_veg", T.LongType()),
    T.StructField("prediction_timestamp", T.TimestampNTZType()),
])

# Columns added later (ALTER TABLE ... ADD COLUMN).
PREDICTIONS_ADDED = T.StructType([
    T.StructField("predicted_meals_salad", T.DoubleType()),
    T.StructField("override_meal_prediction", T.LongType()),
    T.StructField("override_reason", T.StringType()),
    T.StructField("final_prediction", T.LongType()),
])

PREDICTION_COLUMNS = [
    "date", "weekday", "month", "day_theme", "temperature_max", "weather_condition",
    "is_bridge_day", "is_school_break", "holiday_desc",
    "predicted_meals", "predicted_meals_veg", "predicted_meals_non_veg", "predicted_meals_salad",
    "prediction_timestamp", "override_meal_prediction", "override_reason", "final_prediction",
]

PREDICTIONS = T.StructType(
    [PREDICTIONS_BASE[c] if c in PREDICTIONS_BASE.names else PREDICTIONS_ADDED[c]
     for c in PREDICTION_COLUMNS]
)

ACTUAL_COLUMNS = ["actual_meals", "actual_meals_veg", "actual_meals_non_veg", "actual_meals_salad"]

# Landed weather API responses: parallel arrays under ``daily``.
WEATHER_RESPONSE = T.StructType([
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("reason", T.StringType()),
    T.StructField("daily", T.StructType([
        T.StructField("time", T.ArrayType(T.StringType())),
        T.StructField("temperature_2m_max", T.ArrayType(T.DoubleType())),
        T.StructField("weather_code", T.ArrayType(T.IntegerType())),
    ])),
])

# Historical sales file: ``;``-separated, US short dates.
SALES_FILE = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("total_day", T.LongType()),
    T.StructField("veg", T.LongType()),
    T.StructField("non_veg", T.LongType()),
])

INSIGHTS = T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("message", T.StringType()),
]))

MODEL_METADATA = T.StructType([
    T.StructField("number_of_features", T.LongType()),
    T.StructField("training_timestamp", T.StringType()),
    T.StructField("first_training_date", T.StringType()),
    T.StructField("last_training_date", T.StringType()),
    T.StructField("training_row_count", T.LongType()),
    T.StructField("holdout_row_count", T.LongType()),
    T.StructField("baseline_mae", T.DoubleType()),
    T.StructField("baseline_rmse", T.DoubleType()),
    T.StructField("baseline_mape", T.DoubleType()),
    T.StructField("feature_columns", T.ArrayType(T.StringType())),
    T.StructField("data_source", T.StringType()),
    T.StructField("trained_on_real_data", T.BooleanType()),
])
