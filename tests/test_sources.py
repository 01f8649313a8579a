import datetime as dt
import json
import os

from platewise.operators.labels import effective_labels, label_table, translate
from platewise.sources.files import read_holidays, read_model_metadata, read_sales, read_sniffed, sniff_separator
from platewise.sources.tables import evolve, param_sql, themes
from platewise.schemas import PREDICTIONS, PREDICTIONS_BASE

D = dt.date


def test_read_holidays(spark, tmp_dir):
    p = os.path.join(tmp_dir, "h.csv")
    with open(p, "w") as f:
        f.write("date,description,is_bank_holiday,is_school_break,is_bridge_day\n"
                "2026-04-03,Good Friday,TRUE,TRUE,FALSE\n2026-01-05,Bridge Day (Heilige 3 K),FALSE,FALSE,TRUE\n")
    rows = {r["date"]: r for r in read_holidays(spark, p).collect()}
    gf = rows[D(2026, 4, 3)]
    assert gf["is_bank_holiday"] and gf["is_school_break"] and not gf["is_bridge_day"]
    assert rows[D(2026, 1, 5)]["is_bridge_day"]


def test_read_sales_two_digit_years(spark, tmp_dir):
    p = os.path.join(tmp_dir, "s.csv")
    with open(p, "w") as f:
        f.write("date;total_day;veg;non_veg\n04/01/26;60;30;30\n12/31/99;50;20;30\n")
    rows = sorted(read_sales(spark, p).collect())
    assert [r["date"] for r in rows] == [D(1999, 12, 31), D(2026, 4, 1)]
    assert rows[1]["total_meals"] == 60


def test_sniff(spark, tmp_dir):
    p = os.path.join(tmp_dir, "x.csv")
    with open(p, "w") as f:
        f.write("date\ttotal\tveg\tnon-veg\tsalad\n2026-07-13\t10\t4\t6\t1\n")
    assert sniff_separator(spark, p) == "\t"
    df, err = read_sniffed(spark, p)
    assert err is None and df.columns == ["date", "total", "veg", "non-veg", "salad"]
    none, err = read_sniffed(spark, os.path.join(tmp_dir, "missing.csv"))
    assert none is None and err


def test_model_metadata(spark, tmp_dir):
    p = os.path.join(tmp_dir, "m.json")
    with open(p, "w") as f:
        json.dump({"training_timestamp": "2026-06-16T10:00:00", "number_of_features": 14}, f, indent=4)
    assert read_model_metadata(spark, p).first()[0] == dt.datetime(2026, 6, 16, 10, 0)
    assert read_model_metadata(spark, os.path.join(tmp_dir, "nope.json")).first()[0] is None
    q = os.path.join(tmp_dir, "k.json")
    with open(q, "w") as f:
        json.dump({"other": 1}, f)
    assert read_model_metadata(spark, q).first()[0] is None


def test_param_sql_and_themes(spark):
    themes(spark).createOrReplaceTempView("t_themes")
    r = param_sql(spark, "SELECT day_theme FROM t_themes WHERE weekday = :wd", wd="Thursday").collect()
    assert [x[0] for x in r] == ["Schnitzel"]


def test_schema_evolution(spark):
    old = spark.createDataFrame([], PREDICTIONS_BASE)
    assert evolve(old, PREDICTIONS).schema.names == PREDICTIONS.names


def test_label_overlay_and_translate(spark):
    labels = effective_labels(label_table(spark), page="predictions")
    got = {r["key"]: r["label"] for r in labels.filter("lang = 'EN' AND section = 'display_columns'").collect()}
    assert got["final_prediction"] == "Total"  # page layer wins over common ("Total Meals")
    df = spark.createDataFrame([("Sunny", "Summer Break"), ("Rainy", "Labour Day")], "w string, h string")
    t = translate(df, "w", labels, "DE", "weather_condition", lower_key=True)
    t = translate(t, "h", labels, "DE", "holiday_descriptions", on_miss="key")
    rows = {r["w"]: r for r in t.collect()}
    assert rows["Sunny"]["w_label"] is None and rows["Rainy"]["w_label"] == "Regen"
    assert rows["Sunny"]["h_label"] == "Sommerferien" and rows["Rainy"]["h_label"] == "Labour Day"


def test_param_sql_binds_dates(spark):
    df = spark.createDataFrame([(D(2026, 7, 13),), (D(2026, 8, 1),)], "date date")
    df.createOrReplaceTempView("t_dates")
    r = param_sql(spark, "SELECT date FROM t_dates WHERE date >= :start AND date <= :end",
                  start="2026-07-01", end="2026-07-31").collect()
    assert [x[0] for x in r] == [D(2026, 7, 13)]


def test_json_payload_per_week(spark):
    import json

    from platewise.sinks.reports import json_payload, report_table
    df = spark.createDataFrame([(D(2026, 7, 14), 70), (D(2026, 7, 13), 60)], "date date, final_prediction long")
    out = json_payload(df.selectExpr("date_trunc('week', date) AS week_start", "date", "final_prediction")
                       .selectExpr("CAST(week_start AS DATE) AS week_start", "date", "final_prediction"),
                       group=["week_start"]).first()
    rows = json.loads(out["json"])
    assert [r["date"] for r in rows] == ["2026-07-13", "2026-07-14"]
    rep = report_table(spark.createDataFrame([("a\nb", 1, "x")], "day_theme string, final_prediction long, weekday string"),
                       {"day_theme": "Theme", "final_prediction": "Total"})
    assert rep.columns == ["Theme", "Total"] and rep.first()["Theme"] == "a b"


def test_write_csv_round_trip(spark, tmp_dir):
    from platewise.sinks.reports import normalise_dates, write_csv
    df = spark.createDataFrame([("04/01/26", 60), ("12/31/99", 50)], "date string, total long")
    out = os.path.join(tmp_dir, "norm")
    write_csv(normalise_dates(df), out)
    back = spark.read.csv(out, header=True).orderBy("date").collect()
    assert [r["date"] for r in back] == ["1999-12-31", "2026-04-01"]


def test_a_page_section_replaces_the_common_one(spark):
    from platewise.operators.labels import label_map
    layers = {"common": {"EN": {"s": {"a": "A", "b": "B"}, "other": {"c": "C"}}}, "page": {"EN": {"s": {"a": "X"}}}}
    got = {(r["section"], r["key"]): r["label"] for r in effective_labels(label_table(spark, layers), page="page").collect()}
    assert got == {("s", "a"): "X", ("other", "c"): "C"}
    assert label_map(layers, "EN", "s", "page") == {"a": "X"} and label_map(layers, "EN", "other", "page") == {"c": "C"}
    assert label_map(layers, "EN", "s") == {"a": "A", "b": "B"} and label_map(layers, "DE", "s", "page") == {}


def test_separators_from_whole_lines():
    from platewise.sources.files import choose_separator
    assert choose_separator(['"Datum, Tag";"Gesamt"', '"2026-07-13";"1,5"']) == ";"
    assert choose_separator(["date;total,kg", "2026-07-13;1,5", "2026-07-14;2"]) == ";"
    assert choose_separator(["date,total", "2026-07-13,1", "2026-07-14,2"]) == ","
    assert choose_separator(["Datum"]) == "," and choose_separator(["Datum", "1,5", "2,5"]) != ","
    assert choose_separator(['"a|b"|"c"', '"1|2"|"3"']) == "|" and choose_separator(["a\tb", "1\t2,0"]) == "\t"


def test_file_heads_read_little_and_any_header_length(spark, tmp_dir):
    from platewise.sources import files as S
    for name, text in {"a.csv": "\ufeffdate;x\n1;2\n", "b.csv": "\n\n h;" + "y" * 50_000 + "\n1;2\n", "c.csv": "one line", "d.csv": "\n \n",
                       "e.csv": "k,v\n" + "1,2\n" * 20_000}.items():
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write(text)
    heads = {os.path.basename(h.path): h for h in S.file_heads(spark, tmp_dir)}
    assert heads["a.csv"].lines == ["date;x", "1;2"] and len(heads["b.csv"].lines[0]) == 50_003
    assert heads["c.csv"].lines == ["one line"] and heads["d.csv"].lines == [] and len(heads["e.csv"].lines) == S.HEAD_LINES
    unreadable = []
    groups = S.read_csv_files(spark, tmp_dir, unreadable, ordinal=True)
    assert [os.path.basename(p) for p in unreadable] == ["d.csv"]
    rows = next(df for header, df in groups if header == "k,v")
    assert sorted(r["ordinal"] for r in rows.collect()) == list(range(20_000))
