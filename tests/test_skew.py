"""Hot keys: one site (or file) holding a large share of all rows must give
the same results however the rows are spread over partitions."""

import datetime as dt

from pyspark.sql import functions as F

from platewise.operators import validate as V
from platewise.operators.rollup import daily_demand_by_site
from platewise.operators.upsert import last_wins, upsert

D = dt.date


def _orders(spark, n_hot=3000, n_other=3000):
    rows = []
    for i in range(n_hot):  # customer 1 (site 7) holds half of all orders
        rows.append((1, D(2026, 7, 13 + i % 5), "1-URGENT" if i % 3 == 0 else "5-LOW", "F", 10.0))
    for i in range(n_other):
        rows.append((2 + i % 50, D(2026, 7, 13 + i % 5), "2-HIGH" if i % 2 else "3-MEDIUM", "O", 20.0))
    return spark.createDataFrame(rows, "o_custkey long, day date, prio string, status string, price double")


def test_rollup_with_hot_customer_is_partition_independent(spark):
    orders = _orders(spark)
    cust = spark.createDataFrame([(1, 7)] + [(k, k % 3) for k in range(2, 52)], "c_custkey long, c_nationkey int")
    results = []
    for parts in (1, 7, 23):
        o = orders.repartition(parts)
        r = daily_demand_by_site(o, cust, "o_custkey", "c_custkey", "c_nationkey", F.col("day"),
                                 F.col("prio").isin("1-URGENT", "2-HIGH"),
                                 F.when(F.col("status") == "F", F.lit(1000)).otherwise(F.lit(0)), 100_000)
        results.append(sorted(tuple(x) for x in r.collect()))
    assert results[0] == results[1] == results[2]
    hot = [x for x in results[0] if x[0] == 7]
    assert sum(x[2] for x in hot) == 3000 and sum(x[3] for x in hot) == 1000


def test_ordinals_for_a_hot_batch(spark):
    rows = [("big", i) for i in range(2000)] + [("small", i) for i in range(10)]
    df = spark.createDataFrame(rows, "batch string, k int").repartition(9)
    got = V.ordinal_within(df, "batch", ["k"]).collect()
    assert all(r["ordinal"] == r["k"] for r in got)


def test_last_wins_with_one_key_repeated(spark):
    s = "site_id int, date date, v long, ord long"
    rows = [(1, D(2026, 1, 1), i, i) for i in range(3000)] + [(2, D(2026, 1, 1), 5, 0)]
    upd = spark.createDataFrame(rows, s).repartition(11)
    r = {(x.site_id, x.date): x.v for x in last_wins(upd, ["site_id", "date"], "ord").collect()}
    assert r == {(1, D(2026, 1, 1)): 2999, (2, D(2026, 1, 1)): 5}
    target = spark.createDataFrame([(1, D(2026, 1, 1), -1), (3, D(2026, 1, 1), 9)], "site_id int, date date, v long")
    out = {(x.site_id, x.v) for x in upsert(target, upd, ["site_id", "date"], order_col="ord").collect()}
    assert out == {(1, 2999), (2, 5), (3, 9)}
