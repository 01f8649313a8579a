from pyspark.sql import functions as F

from platewise.functions.formats import day_label, one_decimal, parse_insights, signed_one_decimal, thousands, to_flag


def test_day_label_precedence(spark):
    rows = [(True, True, "Summer Break", "Sommerferien"),   # break wins, translated text preferred
            (True, False, "", None),                        # break without text -> generic word
            (False, True, "", None),                        # bridge day -> generic word
            (False, True, "Bridge Day (Heilige 3 K)", None),  # untranslated text kept
            (False, False, "Labour Day", None),             # plain holiday
            (False, False, "", None)]                       # nothing
    df = spark.createDataFrame(rows, "b boolean, d boolean, desc string, tr string")
    got = [r[0] for r in df.select(day_label("b", "d", "desc", F.col("tr"), "Schulferien", "Brückentag")).collect()]
    assert got == ["Sommerferien", "Schulferien", "Brückentag", "Bridge Day (Heilige 3 K)", "Labour Day", None]


def test_parse_insights(spark):
    good = '[{"type": "warning", "title": "Fridays", "message": "Fish days run 4% high."}]'
    fenced = "```json\n" + good + "\n```"
    broken = '[{"type": "error", "title": "cut'
    df = spark.createDataFrame([(good,), (fenced,), (broken,)], "t string")
    out = [r[0] for r in df.select(parse_insights("t")).collect()]
    assert out[0][0]["type"] == "warning" and out[1][0]["title"] == "Fridays"
    assert out[2][0]["type"] == "info" and out[2][0]["message"] == broken


def test_number_formats(spark):
    df = spark.createDataFrame([(1234567, 12.25, -0.3)], "n long, x double, d double")
    r = df.select(thousands("n"), one_decimal("x", "%"), signed_one_decimal("d")).first()
    assert tuple(r) == ("1,234,567", "12.2%", "-0.3")


def test_flags(spark):
    df = spark.createDataFrame([("TRUE",), ("false",), ("1",), ("0",), (None,), ("x",)], "s string")
    assert [r[0] for r in df.select(to_flag("s")).collect()] == [True, False, True, False, False, False]


def test_negative_zero_keeps_sign(spark):
    df = spark.createDataFrame([(-0.04,), (0.04,), (-0.06,)], "d double")
    assert [r[0] for r in df.select(signed_one_decimal("d")).collect()] == ["-0.0", "+0.0", "-0.1"]
    assert [r[0] for r in df.select(one_decimal("d")).collect()] == ["-0.0", "0.0", "-0.1"]
