"""Published tables: upserts by month, writers at once, versions removed."""

import datetime as dt
import os
import threading

import pytest
from pyspark.sql import functions as F

from platewise import api
from platewise.operators.upsert import upsert
from platewise.sinks import tables as T

D = dt.date
S = "site_id int, date date, v long, note string"
KEYS = ["site_id", "date"]


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def base_rows():
    return [(s, D(2026, m, d), m, "old") for s in (1, 2) for m in (5, 6, 7) for d in (1, 2)]


def test_only_the_touched_months_are_written(spark, tmp_dir):
    root = os.path.join(tmp_dir, "t")
    assert T.upsert_into(spark, root, spark.createDataFrame(base_rows(), S), KEYS) == (True, None)
    first = T.current_version(spark, root)
    files = {f for f in T.read_table(spark, root).inputFiles() if "_month=2026-06" not in f}
    updates = spark.createDataFrame([(2, D(2026, 6, 2), 60, "new"), (3, D(2026, 8, 1), 80, None), (1, None, 1, "no day")], S)
    before = T.read_table(spark, root)
    want = rows_of(upsert(before, updates, KEYS))
    assert T.upsert_into(spark, root, updates, KEYS) == (True, None)
    assert rows_of(T.read_table(spark, root)) == want
    second = T.current_version(spark, root)
    assert {m: second.months[m] == first.months.get(m) for m in second.months} == {
        "2026-05": True, "2026-06": False, "2026-07": True, "2026-08": False, T.NO_MONTH: False}
    assert files <= set(T.read_table(spark, root).inputFiles())  # taken over as they are
    new = os.path.join(root, second.months["2026-08"])
    assert {n for n in os.listdir(new) if n.startswith("_month=")} == {"_month=2026-06", "_month=2026-08", "_month=none"}
    assert rows_of(T.read_table(spark, root, first)) == rows_of(spark.createDataFrame(base_rows(), S))
    assert not [n for n in os.listdir(root) if n.startswith("staged")]


def test_updates_are_evaluated_once(spark, tmp_dir):
    root = os.path.join(tmp_dir, "t")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    assert T.upsert_into(spark, root, spark.createDataFrame(base_rows(), S), KEYS)[0]
    updates = spark.createDataFrame([(1, D(2026, 6, d), d, "x") for d in range(1, 21)], S).mapInArrow(count, S)
    assert T.upsert_into(spark, root, updates, KEYS, repeats=False) == (True, None)
    assert seen.value == 20


def test_last_rows_nulls_and_unknown_columns(spark, tmp_dir):
    root = os.path.join(tmp_dir, "t")
    updates = spark.createDataFrame([(1, D(2026, 6, 1), 1, "a", 2), (1, D(2026, 6, 1), 9, "b", 1)], S + ", o int")
    ok, error = T.upsert_into(spark, root, updates.drop("o"), KEYS, repeats=False)
    assert not ok and "order_col" in error and T.current_version(spark, root) is None
    assert T.upsert_into(spark, root, updates, KEYS, "o")[0]
    assert rows_of(T.read_table(spark, root)) == rows_of(updates.filter("o = 2").drop("o"))
    ok, error = T.upsert_into(spark, root, updates, KEYS)
    assert not ok and "not in target" in error
    assert T.upsert_into(spark, root, updates.select("site_id", F.lit(D(2026, 6, 2)).alias("date")).limit(1), KEYS)[0]
    assert T.read_table(spark, root).filter("v IS NULL").count() == 1
    with pytest.raises(ValueError):
        T.upsert_into(spark, root, updates, ["site_id"])


def test_a_table_written_whole_is_divided_by_month(spark, tmp_dir):
    root = os.path.join(tmp_dir, "t")
    df = spark.createDataFrame(base_rows(), S)
    assert T.publish(df, root)[0]
    updates = spark.createDataFrame([(1, D(2026, 5, 1), 50, "new")], S)
    assert T.upsert_into(spark, root, updates, KEYS)[0]
    assert rows_of(T.read_table(spark, root)) == rows_of(upsert(df, updates, KEYS))
    assert set(T.current_version(spark, root).months) == {"2026-05", "2026-06", "2026-07"}


def test_empty_updates_make_an_empty_table(spark, tmp_dir):
    root = os.path.join(tmp_dir, "t")
    assert T.upsert_into(spark, root, spark.createDataFrame([], S), KEYS)[0]
    assert T.read_table(spark, root).count() == 0 and T.read_table(spark, root).columns == ["site_id", "date", "v", "note"]


def test_savers_at_once_all_end_in_the_table(spark, tmp_dir):
    store = api.Store(spark, tmp_dir, KEYS)
    rows = "site_id int, date date, actual_meals long, actual_meals_veg long, actual_meals_non_veg long, actual_meals_salad double"
    results = []

    def save(site):
        results.append(api.save_actuals(store, spark.createDataFrame([(site, D(2026, 7, 13), 9, 4, 5, 0.0)], rows)))

    threads = [threading.Thread(target=save, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert results == [(True, None)] * 4
    assert sorted(r["site_id"] for r in store.actuals().collect()) == [0, 1, 2, 3]


def test_one_of_two_writers_from_a_version_is_told(spark, tmp_dir):
    root = os.path.join(tmp_dir, "t")
    df = spark.createDataFrame(base_rows(), S)
    assert T.publish(df, root)[0]
    base = T.current_version(spark, root)
    assert T.publish(df.limit(1), root, base=base) == (True, None)
    ok, error = T.publish(df.limit(2), root, base=base)
    assert not ok and "meanwhile" in error and T.read_table(spark, root).count() == 1
    ok, error = T.upsert_into(spark, root, df, KEYS, base=base)
    assert not ok and "meanwhile" in error and T.read_table(spark, root).count() == 1
    assert len([n for n in os.listdir(root) if n.startswith("v-")]) == 2  # what was refused is gone


def test_a_pointer_is_created_once(spark, tmp_dir):
    path = os.path.join(tmp_dir, "p")
    results = []
    threads = [threading.Thread(target=lambda i=i: results.append(T._create_text(spark, path, str(i)))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(results) == [False] * 7 + [True] and os.listdir(tmp_dir) == ["p"]


def test_old_versions_go_but_not_what_newer_ones_use(spark, tmp_dir):
    root = os.path.join(tmp_dir, "t")
    for k in range(5):
        months = [5, 6, 7] if k == 0 else [6]
        df = spark.createDataFrame([(1, D(2026, m, 1), k, "x") for m in months], S)
        assert T.upsert_into(spark, root, df, KEYS, keep=2)[0]
    assert [v.number for v in T.versions(spark, root)] == [4, 5]
    assert {(r["date"].month, r["v"]) for r in T.read_table(spark, root).collect()} == {(5, 0), (6, 4), (7, 0)}
    left = [os.path.join(f, m) for f in os.listdir(root) if f.startswith("v-") for m in os.listdir(os.path.join(root, f))
            if m.startswith("_month=")]
    assert len(left) == 4  # two months of the first write, June of the last two


def test_the_api_removes_old_versions(spark, tmp_dir):
    store = api.Store(spark, tmp_dir)
    for k in range(12):
        hol = spark.createDataFrame([(D(2026, 1, 1 + k), "x", True, False, False)],
                                    "date date, description string, is_bank_holiday boolean, is_school_break boolean, "
                                    "is_bridge_day boolean")
        assert api.seed_holidays(store, hol)[0]
    assert len(T.versions(spark, store.root("holidays"))) == 10 and store.holidays().count() == 12
