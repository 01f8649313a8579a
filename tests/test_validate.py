import datetime as dt
import os

import pytest

from platewise.operators import validate as V
from platewise.sources.files import read_csv_files

D = dt.date


def _raw(spark, rows, cols=("date", "actual_meals", "actual_meals_veg", "actual_meals_non_veg",
                            "actual_meals_salad")):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cols))


def test_resolve_aliases_any_case(spark):
    df = _raw(spark, [("2026-07-13", "10", "4", "6", "1")], ("Datum", "GESAMT", "Vegetarisch", "non-veg", "Salat"))
    out = V.resolve_columns(df)
    assert out.columns == ["date"] + V.VALUE_COLUMNS
    assert out.columns == ["date", "actual_meals", "actual_meals_veg", "actual_meals_non_veg", "actual_meals_salad"]


def test_resolve_reports_all_missing(spark):
    df = _raw(spark, [("2026-07-13", "10")], ("date", "total"))
    with pytest.raises(V.ColumnError, match="actual_meals_veg, actual_meals_non_veg, actual_meals_salad"):
        V.resolve_columns(df)


def test_resolve_ambiguous(spark):
    df = _raw(spark, [("a", "1", "1", "1", "1", "1")], ("date", "total", "gesamt", "veg", "non-veg", "salad"))
    with pytest.raises(V.ColumnError, match="ambiguous"):
        V.resolve_columns(df)


def test_value_errors(spark):
    rows = [("2026-07-13", "10", "4", "6", "1"),     # ok
            ("2026", "10", "4", "6", "1"),           # bare year
            ("2026-7-3", "10", "4", "6", "1"),       # not zero-padded
            ("2026-02-30", "10", "4", "6", "1"),     # no such day
            ("2026-07-13", "10.5", "4", "6", "1"),   # half meal
            ("2026-07-13", "10.0", "4", "6", "1"),   # integral float: accepted
            ("2026-07-13", "10", None, "6", "1"),    # missing
            ("2026-07-13", "10", "4", "6", "2.5")]   # decimal salad
    df = V.validate_rows(_raw(spark, rows))
    got = [r["value_errors"] for r in df.collect()]
    assert got == [[], ["date"], ["date"], ["date"], ["actual_meals"], [], ["actual_meals_veg"],
                   ["actual_meals_salad"]]
    lenient = V.validate_rows(_raw(spark, rows[-1:]), salad_integer=False).first()
    assert lenient["value_errors"] == [] and lenient["actual_meals_salad"] == 2.5


def test_sum_check_null_is_mismatch_but_not_in_manual_entry(spark):
    df = spark.createDataFrame([(10, 4, 6), (10, 4, 5), (10, None, 6)],
                               "actual_meals long, actual_meals_veg long, actual_meals_non_veg long")
    assert V.sum_mismatches(df).count() == 2
    assert V.manual_mismatches(df).count() == 1


def test_batch_verdicts(spark):
    rows = [("a", 0, "2026-07-13", "10", "4", "6", "1"), ("a", 1, "2026-07-14", "10", "4", "5", "1"),
            ("b", 0, "2026-07-13", "10", "4", "6", "1"), ("c", 0, "x", "10", "4", "5", "1")]
    df = spark.createDataFrame(rows, "batch string, ordinal long, date string, actual_meals string, "
                                     "actual_meals_veg string, actual_meals_non_veg string, actual_meals_salad string")
    v = {r["batch"]: r for r in V.validate_batches(V.validate_rows(df)).collect()}
    assert (v["a"]["status"], v["a"]["first_bad_row"], v["a"]["published_rows"]) == ("sum_mismatch", 1, 0)
    assert (v["b"]["status"], v["b"]["published_rows"]) == ("ok", 1)
    assert v["c"]["status"] == "invalid_values"  # the sum error is not reported first


def test_changed_rows_null_safe(spark):
    s = "date date, actual_meals long, actual_meals_veg long, actual_meals_non_veg long, actual_meals_salad double"
    orig = spark.createDataFrame([(D(2026, 1, 1), None, 1, 2, None), (D(2026, 1, 2), 3, 1, 2, 1.0)], s)
    edit = spark.createDataFrame([(D(2026, 1, 1), None, 1, 2, None), (D(2026, 1, 2), 3, 1, 2, 1.5)], s)
    assert [r.date for r in V.changed_rows(edit, orig).collect()] == [D(2026, 1, 2)]
    auto = spark.createDataFrame([(D(2026, 1, 1), None, 5, None, None)], s)
    assert V.auto_total(auto, orig).first()["actual_meals"] == 5


def test_file_ordinals_and_sniffing(spark, tmp_dir):
    a = os.path.join(tmp_dir, "a.csv")
    b = os.path.join(tmp_dir, "b.csv")
    with open(a, "w") as f:
        f.write("Datum;Gesamt;Veg;Non-Veg;Salat\n" + "".join(f"2026-07-{d:02d};10;4;6;1\n" for d in range(1, 31)))
    with open(b, "w") as f:
        f.write("date,total,veg,non-veg,salad\n2026-08-03,5,2,3,0\n2026-08-04,7,3,4,0\n")
    groups = read_csv_files(spark, tmp_dir)
    assert len(groups) == 2
    seen = {}
    for header, df in groups:
        r = V.resolve_columns(df, keep=["_file", "ordinal"])
        for row in r.collect():
            seen[(os.path.basename(row["_file"]), row["date"])] = row["ordinal"]
    assert seen[("a.csv", "2026-07-01")] == 0 and seen[("a.csv", "2026-07-30")] == 29
    assert seen[("b.csv", "2026-08-04")] == 1


def test_ordinal_within_batches(spark):
    df = spark.createDataFrame([("x", 3), ("x", 1), ("y", 2), ("x", 2)], "batch string, k int").repartition(3)
    got = sorted((r["batch"], r["k"], r["ordinal"]) for r in V.ordinal_within(df, "batch", ["k"]).collect())
    assert got == [("x", 1, 0), ("x", 2, 1), ("x", 3, 2), ("y", 2, 0)]


def test_value_errors_extremes(spark):
    rows = [("2026-07-13", "1e20", "4", "6", "1"), ("2026-07-13", "NaN", "4", "6", "1"),
            ("2026-07-13", "Infinity", "4", "6", "1"), ("2026-07-13", " 10 ", "4", "6", "1")]
    got = [r["value_errors"] for r in V.validate_rows(_raw(spark, rows)).collect()]
    assert got == [["actual_meals"], ["actual_meals"], ["actual_meals"], []]


def test_unaccepted_aliases_stay_missing(spark):
    # "non_veg" and "actual_meals_salad" are not accepted headers (Q6)
    df = _raw(spark, [("2026-07-13", "10", "4", "6", "1")],
              ("date", "total", "veg", "non_veg", "actual_meals_salad"))
    with pytest.raises(V.ColumnError, match="actual_meals_non_veg, actual_meals_salad"):
        V.resolve_columns(df)
