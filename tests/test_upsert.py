import datetime as dt

from pyspark.sql import functions as F

from platewise.operators.upsert import delete_keys, last_wins, nan_to_null, upsert

D = dt.date
S = "date date, v long, note string"


def test_upsert_insert_and_replace(spark):
    target = spark.createDataFrame([(D(2026, 1, 1), 1, "a"), (D(2026, 1, 2), 2, "b")], S)
    upd = spark.createDataFrame([(D(2026, 1, 2), 20, None), (D(2026, 1, 3), 30, "c")], S)
    got = sorted(upsert(target, upd).collect())
    # full-row replace: the old note of 2026-01-02 is gone
    assert [(r.date, r.v, r.note) for r in got] == [(D(2026, 1, 1), 1, "a"), (D(2026, 1, 2), 20, None),
                                                  (D(2026, 1, 3), 30, "c")]


def test_last_wins_in_batch(spark):
    upd = spark.createDataFrame([(D(2026, 1, 2), 5, "x", 1), (D(2026, 1, 2), 6, "y", 2)], S + ", ord int")
    r = last_wins(upd, ["date"], "ord").collect()
    assert len(r) == 1 and r[0]["v"] == 6
    target = spark.createDataFrame([(D(2026, 1, 2), 1, "a")], S)
    assert upsert(target, upd, order_col="ord").first()["note"] == "y"


def test_delete_keys(spark):
    target = spark.createDataFrame([(D(2026, 1, 1), 1, "a"), (D(2026, 1, 2), 2, "b")], S)
    doomed = spark.createDataFrame([(D(2026, 1, 2),), (D(2026, 1, 2),)], "date date")
    assert [r.date for r in delete_keys(target, doomed).collect()] == [D(2026, 1, 1)]


def test_nan_to_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert [r[0] for r in nan_to_null(df).collect()] == [None, 1.0]
    assert df.select(F.isnan("x")).first()[0]


def test_unordered_duplicates_never_duplicate_keys(spark):
    target = spark.createDataFrame([(D(2026, 1, 1), 1, "a")], S)
    upd = spark.createDataFrame([(D(2026, 1, 2), 5, "x"), (D(2026, 1, 2), 7, "y")], S)
    out = upsert(target, upd).collect()
    assert len(out) == 2 and {r.date for r in out} == {D(2026, 1, 1), D(2026, 1, 2)}
    assert [r.v for r in out if r.date == D(2026, 1, 2)] == [7]
