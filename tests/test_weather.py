from pyspark.sql import functions as F

from platewise.functions.weather import weather_category, weather_label
from platewise.sources.files import parse_weather_json, weather_quarantine, weather_rows

CASES = {0: "Sunny", 1: "Cloudy", 3: "Cloudy", 4: "Cloudy", 51: "Rainy", 67: "Rainy", 68: "Cloudy",
         80: "Rainy", 84: "Rainy", 71: "Snowy", 77: "Snowy", 85: "Snowy", 86: "Snowy", 95: "Stormy",
         99: "Stormy", 100: "Cloudy", -1: "Cloudy"}


def test_weather_code_bands(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "code int")
    got = {r["code"]: r["c"]["weather_condition"] for r in df.select("code", weather_category("code").alias("c")).collect()}
    assert got == CASES


def test_unknown_code_has_overcast_icon(spark):
    r = spark.range(1).select(weather_category(F.lit(100)).alias("c")).first()["c"]
    assert r["weather_icon"] == "☁️"


GOOD = ('{"latitude": 50.1, "longitude": 8.7, "daily": {"time": ["2026-07-13", "2026-07-14"],'
        ' "temperature_2m_max": [22.5, 19.0], "weather_code": [0, 61]}}')
BAD = '{"reason": "No data is available for this location"}'


def test_weather_response_unzip(spark):
    docs = parse_weather_json(spark.createDataFrame([(GOOD,), (BAD,)], "json string"))
    rows = weather_rows(docs).orderBy("date").collect()
    assert [(str(r["date"]), r["temperature_max"], r["weather_condition"]) for r in rows] == [
        ("2026-07-13", 22.5, "Sunny"), ("2026-07-14", 19.0, "Rainy")]
    q = weather_quarantine(docs).collect()
    assert len(q) == 1 and q[0]["reason"].startswith("No data")


def test_weather_label_skips_zero(spark):
    df = spark.createDataFrame([(22.5, "Regen"), (0.0, "Regen"), (None, "Regen")], "t double, c string")
    assert [r[0] for r in df.select(weather_label("t", "c")).collect()] == ["22.5°C Regen", None, None]
