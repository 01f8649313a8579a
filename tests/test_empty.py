"""Operators accept empty inputs without failing."""

from platewise.operators import compare as C
from platewise.operators import insights as INS
from platewise.operators import split as SP
from platewise.operators import upsert as UP
from platewise.operators import validate as V
from platewise.schemas import ACTUAL_SALES, PREDICTIONS


def test_empty_inputs(spark):
    p = spark.createDataFrame([], PREDICTIONS)
    a = spark.createDataFrame([], ACTUAL_SALES)
    assert C.join_actuals(p, a).count() == 0
    m = C.metrics(C.join_actuals(p, a)).first()
    assert m["mae"] is None and m["over_predicted"] == 0
    assert C.period_over_period_all(p, a).count() == 0
    assert C.period_over_period(p, a, "2026-07-13", "2026-07-17").first()["rows"] == 0
    assert C.missing_actuals(p, a).count() == 0
    assert C.last_prediction_info(p).first()["timestamp"] is None
    assert SP.theme_ratios(a).count() == 0
    assert UP.upsert(a, a).count() == 0
    assert V.changed_rows(a, a).count() == 0
    cmp = C.join_actuals(p, a).withColumn("month", C.F.col("date"))
    assert INS.bias_insights(cmp).count() == 0
    assert INS.series_long(C.join_actuals(p, a)).count() == 0
