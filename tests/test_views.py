"""The run's daily tables: written once, whoever asks, and anew on request."""

import threading

from platewise import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_a_table_is_written_once(spark, monkeypatch):
    monkeypatch.setattr(fx, "_RUNS", {})
    writes, build = [], fx._BUILDERS["holidays"]
    monkeypatch.setitem(fx._BUILDERS, "holidays", lambda *a: writes.append(1) or build(*a))
    counts = []
    threads = [threading.Thread(target=lambda: counts.append(fx.view(spark, SF, "holidays").count())) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(set(counts)) == 1 and len(counts) == 3 and writes == [1]


def test_build_writes_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fx, "_RUNS", {})
    for t in ("orders", "customer", "lineitem"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    sf = str(tmp_path)
    first = fx.build(spark, sf)
    before = fx.actual_sales(spark, sf).count()
    spark.read.parquet(f"{SF}/orders.parquet").limit(0).write.mode("overwrite").parquet(f"{sf}/orders.parquet")
    assert fx.actual_sales(spark, sf).count() == before > 0  # the run's tables stay as they were
    second = fx.build(spark, sf)
    assert second.folder != first.folder and fx.actual_sales(spark, sf).count() == 0
    assert first.names == second.names == set(fx._BUILDERS)
