import datetime as dt


from platewise.operators import ml as ML

D = dt.date


def _frame(spark, n=120):
    rows = []
    d = D(2026, 1, 5)
    i = 0
    while len(rows) < n:
        if d.weekday() < 5:
            temp = 10.0 + (i * 7) % 20
            theme_bonus = [0, 5, 10, 15, 20][d.weekday()]
            rows.append((d, 40 + theme_bonus + int(temp), temp, ["Sunny", "Rainy", "Cloudy"][i % 3],
                         False, False))
            i += 1
        d += dt.timedelta(days=1)
    df = spark.createDataFrame(rows, "date date, total_meals long, temperature_max double, weather_condition string,"
                                     " is_semester_break boolean, is_bridge_day boolean")
    from platewise.operators.features import add_calendar
    return add_calendar(df)


def test_forest_beats_naive_and_is_repeatable(spark):
    f = ML.temporal_split(_frame(spark))
    assert f.filter("split = 'test'").count() == ML.HOLDOUT_DAYS
    cats = ML.categories(f.filter("split = 'train'"))
    feats = ML.feature_columns(cats)
    enc = ML.one_hot(f, cats)
    m1 = ML.fit_forest(enc.filter("split = 'train'"), feats, numTrees=30)
    m2 = ML.fit_forest(enc.filter("split = 'train'"), feats, numTrees=30)
    test = enc.filter("split = 'test'")
    p1 = [r[0] for r in m1.transform(test).orderBy("date").select("prediction").collect()]
    p2 = [r[0] for r in m2.transform(test).orderBy("date").select("prediction").collect()]
    assert p1 == p2
    forest = ML.regression_metrics(m1.transform(test)).first()["mae"]
    naive = ML.regression_metrics(ML.naive_baseline(enc)).first()["mae"]
    assert forest < naive


def test_align_adds_missing_as_zero(spark):
    df = spark.createDataFrame([(D(2026, 7, 13), 20.0, True, False, "July", "Snowy", "Sausage")],
                               "date date, temperature_max double, is_semester_break boolean, is_bridge_day boolean,"
                               " month string, weather_condition string, day_theme string")
    feats = ["temperature_max", "is_semester_break", "is_bridge_day", "month_April", "month_June",
             "weather_condition_Sunny", "day_theme_Sausage"]
    r = ML.encode_for(df, feats).first()
    assert list(r.asDict()) == feats
    assert (r["month_April"], r["weather_condition_Sunny"], r["day_theme_Sausage"], r["is_semester_break"]) == (
        0.0, 0.0, 1.0, 1.0)


def test_metrics_mape_uses_actual(spark):
    df = spark.createDataFrame([(100.0, 90.0), (0.0, 5.0)], "total_meals double, prediction double")
    r = ML.regression_metrics(df).first()
    assert abs(r["mape"] - 0.1) < 1e-12  # zero actual skipped


def test_sites_share_one_forest(spark):
    rows = []
    for site, size in ((1, 10), (2, 1000)):
        d = D(2026, 1, 5)
        n = 0
        while n < 60:
            if d.weekday() < 5:
                temp = 10.0 + (n * 7) % 20
                rows.append((site, d, int(size * (1 + temp / 100)), temp, "Sunny", False, False))
                n += 1
            d += dt.timedelta(days=1)
    df = spark.createDataFrame(rows, "site_id int, date date, total_meals long, temperature_max double, "
                                     "weather_condition string, is_semester_break boolean, is_bridge_day boolean")
    from platewise.operators.features import add_calendar
    f = ML.temporal_split(add_calendar(df), keys=["site_id", "date"])
    assert f.filter("split = 'test'").groupBy("site_id").count().collect()[0]["count"] == ML.HOLDOUT_DAYS
    cats = ML.categories(f)
    feats = ML.feature_columns(cats)
    enc = ML.one_hot(f, cats)
    scale = ML.site_scale(enc)
    model = ML.fit_sites(enc, feats, scale, numTrees=20)
    pred = ML.predict_sites(model, enc.filter("split = 'test'"), scale)
    m = {r["site_id"]: r["mae"] for r in ML.regression_metrics(pred, by=["site_id"]).collect()}
    assert m[1] < 2 and m[2] < 100  # each site predicted at its own scale


def test_feature_importances_cover_all_features(spark):
    f = ML.temporal_split(_frame(spark))
    cats = ML.categories(f)
    feats = ML.feature_columns(cats)
    model = ML.fit_forest(ML.one_hot(f, cats).filter("split = 'train'"), feats, numTrees=10)
    imp = ML.feature_importances(model, feats)
    assert sorted(n for n, _ in imp) == sorted(feats) and abs(sum(v for _, v in imp) - 1.0) < 1e-9


def test_bagged_trees_and_their_out_of_bag_score(spark):
    from pyspark.sql import functions as F
    f = _frame(spark, 150)
    cats = ML.categories(f)
    feats = ML.feature_columns(cats)
    enc = ML.one_hot(f, cats)
    key = F.col("date").cast("string")
    models = ML.fit_bagged(enc, feats, key, trees=12)
    stored = ML.bag_predictions(enc, models, feats, key, ["date", ML.LABEL]).cache()
    assert stored.count() == 150 * 12
    # the trees as expressions predict what the models predict
    from pyspark.ml.feature import VectorAssembler
    x = VectorAssembler(inputCols=feats, outputCol="features").transform(enc)
    for t in (0, 7):
        plain = {r["date"]: r["prediction"] for r in models[t].transform(x).select("date", "prediction").collect()}
        assert {r["date"]: r["prediction"] for r in stored.filter(F.col("tree") == t).collect()} == plain
    assert len({models[t].toDebugString for t in range(12)}) > 1
    oob = {r["date"]: r for r in ML.out_of_bag(stored, ["date", ML.LABEL]).collect()}
    rows = stored.collect()
    for d, r in oob.items():
        unseen = [x["prediction"] for x in rows if x["date"] == d and x["weight"] == 0]
        assert r["oob_trees"] == len(unseen)
        assert r["prediction"] is None if not unseen else abs(r["prediction"] - sum(unseen) / len(unseen)) < 1e-9
    scored = [r for r in oob.values() if r["prediction"] is not None]
    mean = sum(r[ML.LABEL] for r in scored) / len(scored)
    r2 = 1 - sum((r[ML.LABEL] - r["prediction"]) ** 2 for r in scored) / sum((r[ML.LABEL] - mean) ** 2 for r in scored)
    got = ML.oob_score(ML.out_of_bag(stored, ["date", ML.LABEL])).first()
    assert abs(got["r2"] - r2) < 1e-9 and got["n"] == len(scored) and r2 > 0.5


def test_bag_weights_are_poisson(spark):
    from pyspark.sql import functions as F
    w = spark.range(20_000).select(ML.bag_weight(F.col("id").cast("string"), F.lit(3)).alias("w"))
    got = {r["w"]: r["count"] / 20_000 for r in w.groupBy("w").count().collect()}
    assert abs(got[0] - 0.3679) < 0.015 and abs(got[1] - 0.3679) < 0.015 and abs(got[2] - 0.1839) < 0.012
