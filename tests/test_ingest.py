import datetime as dt
import os

from pyspark.sql import functions as F

from platewise.sinks.tables import publish, read_table
from platewise.streaming.ingest import landing_layout, start_ingest

D = dt.date
S = "date date, actual_meals long, actual_meals_veg long, actual_meals_non_veg long, actual_meals_salad double"


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_streaming_ingest_all_or_nothing(spark, tmp_dir):
    p = landing_layout(tmp_dir)
    ok, err = publish(spark.createDataFrame([(D(2026, 7, 13), 1, 1, 0, 0.0)], S), p["table"])
    assert ok, err
    _write(os.path.join(p["landing"], "good.csv"),
           "Datum;Gesamt;Veg;Non-Veg;Salat\n2026-07-13;10;4;6;1\n2026-07-14;12;5;7;2\n")
    _write(os.path.join(p["landing"], "bad.csv"),
           "date,total,veg,non-veg,salad\n2026-07-15,10,4,5,1\n")
    q = start_ingest(spark, p["landing"], p["table"], p["quarantine"], p["checkpoint"])
    q.awaitTermination()
    assert q.exception() is None
    rows = {r["date"]: r for r in read_table(spark, p["table"]).collect()}
    assert set(rows) == {D(2026, 7, 13), D(2026, 7, 14)}
    assert rows[D(2026, 7, 13)]["actual_meals"] == 10  # replaced by the file
    quarantine = spark.read.parquet(p["quarantine"]).collect()
    assert len(quarantine) == 1 and quarantine[0]["status"] == "sum_mismatch"

    # a second run with no new files changes nothing (files are tracked in the checkpoint)
    q2 = start_ingest(spark, p["landing"], p["table"], p["quarantine"], p["checkpoint"])
    q2.awaitTermination()
    assert read_table(spark, p["table"]).count() == 2
    assert spark.read.parquet(p["quarantine"]).count() == 1


def test_publish_is_all_or_nothing(spark, tmp_dir):
    root = os.path.join(tmp_dir, "t")
    ok, err = publish(spark.createDataFrame([(D(2026, 7, 13), 1, 1, 0, 0.0)], S), root)
    assert ok and err is None
    bad = spark.createDataFrame([(D(2026, 7, 14), 1, 1, 0, 0.0)], S).withColumn(
        "actual_meals", F.assert_true(F.lit(False), F.lit("boom")).cast("long"))
    ok, err = publish(bad, root)
    assert not ok and "boom" in err
    assert [r["date"] for r in read_table(spark, root).collect()] == [D(2026, 7, 13)]


def test_ensure_override_columns(spark):
    from platewise.operators.split import with_final_prediction
    df = spark.createDataFrame([(60,)], "predicted_meals long")
    out = with_final_prediction(df)
    assert {"override_meal_prediction", "override_reason", "final_prediction"} <= set(out.columns)
    assert out.first()["final_prediction"] == 60


def test_retain_versions(spark, tmp_dir):
    import time

    from platewise.sinks.tables import current_version, retain_versions
    root = os.path.join(tmp_dir, "r")
    for i in range(4):
        ok, _ = publish(spark.createDataFrame([(D(2026, 7, 13), i, 1, 0, 0.0)], S), root)
        assert ok
        time.sleep(0.01)
    removed = retain_versions(spark, root, keep=2)
    assert len(removed) == 2
    assert read_table(spark, root).first()["actual_meals"] == 3
    assert current_version(spark, root) is not None


def test_duplicate_headers_are_rejected_per_file(spark, tmp_dir):
    from platewise.streaming.ingest import validate_files
    _write(os.path.join(tmp_dir, "in", "dup.csv"), "date,total,veg,veg,non-veg,salad\n2026-07-13,10,4,4,6,1\n")
    _write(os.path.join(tmp_dir, "in", "ok.csv"), "date,total,veg,non-veg,salad\n2026-07-14,10,4,6,1\n")
    rows, verdicts = validate_files(spark, os.path.join(tmp_dir, "in"))
    v = {os.path.basename(r["batch"]): r for r in verdicts.collect()}
    assert v["dup.csv"]["status"] == "duplicate_columns" and "duplicate" in v["dup.csv"]["message"]
    assert v["ok.csv"]["status"] == "ok"


def test_empty_file_is_reported(spark, tmp_dir):
    from platewise.streaming.ingest import validate_files
    _write(os.path.join(tmp_dir, "in", "empty.csv"), "")
    _write(os.path.join(tmp_dir, "in", "ok.csv"), "date,total,veg,non-veg,salad\n2026-07-14,10,4,6,1\n")
    files = ["file:" + os.path.join(tmp_dir, "in", n) for n in ("empty.csv", "ok.csv")]
    rows, verdicts = validate_files(spark, files)
    v = {os.path.basename(r["batch"]): r["status"] for r in verdicts.collect()}
    assert v == {"empty.csv": "unreadable", "ok.csv": "ok"}


def test_replayed_epoch_is_idempotent(spark, tmp_dir):
    from platewise.streaming.ingest import ingest_paths
    p = landing_layout(tmp_dir)
    assert publish(spark.createDataFrame([(D(2026, 7, 13), 1, 1, 0, 0.0)], S), p["table"])[0]
    _write(os.path.join(p["landing"], "a.csv"), "date,total,veg,non-veg,salad\n2026-07-14,10,4,6,1\n")
    _write(os.path.join(p["landing"], "b.csv"), "date,total,veg,non-veg,salad\n2026-07-15,10,4,5,1\n")
    files = ["file:" + os.path.join(p["landing"], n) for n in ("a.csv", "b.csv")]
    for _ in range(2):  # the same micro-batch twice, as after a failure before the commit
        assert ingest_paths(spark, files, p["table"], p["quarantine"], epoch_id=7) == (True, None)
    assert sorted(r["date"] for r in read_table(spark, p["table"]).collect()) == [D(2026, 7, 13), D(2026, 7, 14)]
    assert spark.read.parquet(p["quarantine"]).count() == 1
