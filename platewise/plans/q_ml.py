"""Queries: training frame, holdout, encoding, forest, evaluation, scoring
(ML-1...7, WIN-1, AGG-12...15, SNK-7, SNK-8, FLOW-1, FLOW-5)."""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import functions as F

from platewise import fixtures as fx
from platewise.fixtures_sql import q, ratio_fallback, theme_case
from platewise.operators import ml as ML
from platewise.operators import split as SP
from platewise.operators import upsert as UP
from platewise.plans.catalog import register
from platewise.plans.q_features import _REQ_SQL, flow_prepare
from platewise.schemas import PREDICTION_COLUMNS
from platewise.session import scratch_dir

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August",
          "September", "October", "November", "December"]
CONDITIONS = ["Cloudy", "Rainy", "Snowy", "Stormy", "Sunny"]
THEMES = ["Chicken", "Fish", "Sausage", "Schnitzel", "Vital"]
#: The registered queries encode these categories, whichever of them the data
#: hold, so that their columns don't follow the data.
CATEGORIES = {"month": sorted(MONTHS), "weather_condition": CONDITIONS, "day_theme": THEMES}
AS_OF = dt.datetime(2001, 8, 1, 8, 0)

_FRAME_SQL = f"""
, tf AS (
  SELECT a.date, a.actual_meals AS total_meals, dayname(a.date) AS weekday, monthname(a.date) AS month,
         {theme_case("a.date")} AS day_theme, w.temperature_max, w.weather_condition,
         COALESCE(h.is_school_break, false) AS is_semester_break, COALESCE(h.is_bridge_day, false) AS is_bridge_day
  FROM actual_sales a LEFT JOIN weather w ON a.date = w.date LEFT JOIN holidays h ON a.date = h.date
  WHERE w.temperature_max IS NOT NULL AND w.weather_condition IS NOT NULL),
sp AS (
  SELECT *, CASE WHEN date >= (SELECT min(date) FROM (SELECT date FROM tf ORDER BY date DESC LIMIT {ML.HOLDOUT_DAYS}) t)
                 THEN 'test' ELSE 'train' END AS split
  FROM tf)"""


def _onehot_sql(src: str, flag: str = "is_semester_break") -> str:
    cols = [f"CAST(temperature_max AS DOUBLE) AS temperature_max",
            f"CAST({flag} AS DOUBLE) AS is_semester_break", "CAST(is_bridge_day AS DOUBLE) AS is_bridge_day"]
    for col, values in (("month", MONTHS), ("weather_condition", CONDITIONS), ("day_theme", THEMES)):
        for v in sorted(values):
            cols.append(f"CASE WHEN {col} = {q(v)} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS {col}_{v}")
    return f"SELECT date, {', '.join(cols)} FROM {src}"


def frame(spark, sf):
    a = fx.actual_sales(spark, sf)
    # days without weather are left out here (and listed by flt_missing_weather)
    return ML.training_frame(a, fx.weather(spark, sf), fx.holidays(spark, sf), on_missing_weather="drop")


@register("ml_training_frame", _FRAME_SQL + "\nSELECT * FROM tf")
def ml_training_frame(spark, sf):
    """ML-1: daily totals with calendar, weather and holiday features."""
    return frame(spark, sf)


@register("win_holdout", _FRAME_SQL + "\nSELECT date, total_meals, split FROM sp")
def win_holdout(spark, sf):
    """WIN-1: the last 10 days are the holdout, never shuffled."""
    return ML.temporal_split(frame(spark, sf)).select("date", "total_meals", "split")


@register("ml_one_hot", _FRAME_SQL + "\n" + _onehot_sql("tf"))
def ml_one_hot(spark, sf):
    """ML-2: numeric features plus one column per observed category."""
    f = frame(spark, sf)
    cats = CATEGORIES
    return ML.one_hot(f, cats).select("date", *ML.feature_columns(cats))


@register("ml_align", _FRAME_SQL + "\n, " + _REQ_SQL.strip() + """,
prep AS (
  SELECT b.start_date, b.date, monthname(b.date) AS month, """ + theme_case("b.date") + """ AS day_theme,
         w.temperature_max, w.weather_condition,
         COALESCE(h.is_school_break, false) AS is_school_break, COALESCE(h.is_bridge_day, false) AS is_bridge_day
  FROM bd b LEFT JOIN weather w ON b.date = w.date LEFT JOIN holidays h ON b.date = h.date
  WHERE b.day_index <= b.n_days AND (h.is_bank_holiday IS NULL OR NOT h.is_bank_holiday))
""" + _onehot_sql("prep", "is_school_break").replace("SELECT date,", "SELECT start_date, date,"))
def ml_align(spark, sf):
    """ML-3: every forecast request's inference frame encoded with the stored
    training feature list (missing categories 0, extras dropped, in order)."""
    features = ML.feature_columns(CATEGORIES)
    prep = flow_prepare(spark, sf).withColumnRenamed("is_school_break", "is_semester_break")
    return ML.encode_for(prep, features, keep=["start_date", "date"])


@register("ml_baseline", _FRAME_SQL + """
, m AS (SELECT avg(total_meals) AS train_mean FROM sp WHERE split = 'train')
SELECT round(m.train_mean, 6) AS train_mean, round(avg(abs(sp.total_meals - m.train_mean)), 6) AS baseline_mae
FROM sp, m WHERE sp.split = 'test' GROUP BY m.train_mean""")
def ml_baseline(spark, sf):
    """AGG-12: the training mean and its MAE on the holdout."""
    b = ML.naive_baseline(ML.temporal_split(frame(spark, sf)))
    return b.groupBy("train_mean").agg(F.avg(F.abs(F.col("total_meals") - F.col("train_mean"))).alias("baseline_mae")) \
            .select(F.round("train_mean", 6).alias("train_mean"), F.round("baseline_mae", 6).alias("baseline_mae"))


@register("ml_eval_naive", _FRAME_SQL + """
, m AS (SELECT avg(total_meals) AS train_mean FROM sp WHERE split = 'train'),
t AS (SELECT CAST(total_meals AS DOUBLE) AS y, m.train_mean AS p FROM sp, m WHERE split = 'test')
SELECT count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse,
       round(avg(abs((y - p) / NULLIF(y, 0))), 6) AS mape,
       round(1 - sum((y - p) * (y - p)) / NULLIF(var_pop(y) * count(*), 0), 6) AS r2
FROM t""")
def ml_eval_naive(spark, sf):
    """AGG-13 / AGG-14: MAE, RMSE, R², MAPE of the naive predictor."""
    b = ML.naive_baseline(ML.temporal_split(frame(spark, sf)))
    m = ML.regression_metrics(b)
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "mape", "r2")])


# --- model-backed queries (rows-only checks) ---------------------------------------------------
_MODELS: dict = {}


def trained(spark, sf):
    """Fit once per run (see ``fixtures.build``): frame -> holdout -> one-hot -> forest."""
    key = fx.current_run(spark, sf).folder
    if key not in _MODELS:
        f = ML.temporal_split(frame(spark, sf))
        cats = CATEGORIES
        features = ML.feature_columns(cats)
        enc = ML.one_hot(f, cats).select("date", "split", ML.LABEL, *features)
        model = ML.fit_forest(enc.filter(F.col("split") == "train"), features)
        _MODELS[key] = (model, features, enc)
    return _MODELS[key]


@register("ml_train")
def ml_train(spark, sf):
    """ML-5: the forest's predictions for the holdout days."""
    model, features, enc = trained(spark, sf)
    return model.transform(enc.filter(F.col("split") == "test")).select("date", ML.LABEL, "prediction")


@register("ml_eval")
def ml_eval(spark, sf):
    """AGG-13 / AGG-14 for the forest, next to the naive baseline."""
    model, features, enc = trained(spark, sf)
    m = ML.regression_metrics(model.transform(enc.filter(F.col("split") == "test"))).withColumn("model", F.lit("forest"))
    b = ML.regression_metrics(ML.naive_baseline(enc)).withColumn("model", F.lit("train_mean"))
    return m.unionByName(b)


@register("ml_score")
def ml_score(spark, sf):
    """ML-4: score every forecast request: predict, ceil, stamp, split."""
    model, features, _ = trained(spark, sf)
    prep = flow_prepare(spark, sf)
    ratios = SP.theme_ratios(fx.actual_sales(spark, sf))
    return ML.score(model, prep, features, ratios, AS_OF)


@register("ml_backtest")
def ml_backtest(spark, sf):
    """ML-6: rolling-origin validation (stands in for the out-of-bag score):
    for each yearly origin, fit on the days before it and test on the next
    10 working days."""
    f = frame(spark, sf)
    cats = CATEGORIES
    features = ML.feature_columns(cats)
    from platewise.session import cut_lineage
    enc = cut_lineage(ML.one_hot(f, cats))  # every origin reads it
    years = sorted(r[0] for r in f.select(F.year("date").alias("y")).distinct().collect())[1:]
    out = None
    for y in years:
        origin = dt.date(y, 1, 1)
        train = enc.filter(F.col("date") < F.lit(origin))
        test = enc.filter(F.col("date") >= F.lit(origin)).orderBy("date").limit(ML.HOLDOUT_DAYS)
        model = ML.fit_forest(train, features)
        m = ML.regression_metrics(model.transform(test)).withColumn("origin", F.lit(origin))
        out = m if out is None else out.unionByName(m)
    return out


_BAG_SQL = f"""
, trees AS (SELECT CAST(range AS INTEGER) AS tree FROM range({ML.FOREST["numTrees"]})),
bags AS (
  SELECT date, total_meals, tree, {" + ".join(
      f"CASE WHEN drawn >= {x} THEN 1 ELSE 0 END" for x in ML.POISSON)} AS weight
  FROM (SELECT date, total_meals, tree,
               CAST('0x' || substr(md5(CAST(date AS VARCHAR) || ':' || CAST(tree AS VARCHAR)), 1, 8) AS BIGINT) AS drawn
        FROM sp, trees WHERE split = 'train') d)"""


def _bagged(spark, sf):
    """Training days with every tree of a bagged forest: date, total_meals,
    tree, weight, prediction; written, as the score and its check read it."""
    def write(path):
        _, features, enc = trained(spark, sf)
        train, key = enc.filter(F.col("split") == "train"), F.col("date").cast("string")
        models = ML.fit_bagged(train, features, key)
        ML.bag_predictions(train, models, features, key, ["date", ML.LABEL]).write.parquet(path)

    return spark.read.parquet(fx.current_run(spark, sf).path("bag_predictions", write))


@register("ml_oob_weights", _FRAME_SQL + _BAG_SQL + """
SELECT date, count(*) FILTER (WHERE weight = 0) AS oob_trees, CAST(sum(weight) AS BIGINT) AS weights,
       CAST(max(weight) AS INTEGER) AS most FROM bags GROUP BY date""")
def ml_oob_weights(spark, sf):
    """ML-6: the training days' bags: how many trees have not seen a day, the
    sum of its weights in all trees and the greatest."""
    f = ML.temporal_split(frame(spark, sf)).filter(F.col("split") == "train")
    tree = F.explode(F.sequence(F.lit(0), F.lit(ML.FOREST["numTrees"] - 1)))
    bags = f.select("date", tree.alias("tree")).withColumn(
        "weight", ML.bag_weight(F.col("date").cast("string"), F.col("tree")))
    return bags.groupBy("date").agg(F.count_if(F.col("weight") == 0).alias("oob_trees"), F.sum("weight").alias("weights"),
                                    F.max("weight").alias("most"))


@register("ml_oob")
def ml_oob(spark, sf):
    """ML-6: the out-of-bag score of the bagged forest: each training day
    predicted by the trees that have not seen it."""
    return ML.oob_score(ML.out_of_bag(_bagged(spark, sf), ["date", ML.LABEL]))


@register("ml_oob_facts", _FRAME_SQL + _BAG_SQL + """
SELECT date, total_meals, count(*) FILTER (WHERE weight = 0) AS oob_trees, true AS weights_agree, true AS score_agrees
FROM bags GROUP BY date, total_meals""")
def ml_oob_facts(spark, sf):
    """ML-6: of each training day the trees that have not seen it; the score
    agrees with one made in SQL from the stored predictions of every tree."""
    stored = _bagged(spark, sf)
    score = ML.oob_score(ML.out_of_bag(stored, ["date", ML.LABEL])).first()["r2"]  # one scalar
    again = spark.sql("""
        WITH p AS (SELECT date, first(total_meals) AS y, sum(IF(weight = 0, prediction, 0)) / count_if(weight = 0) AS p
                   FROM {stored} GROUP BY date HAVING count_if(weight = 0) > 0)
        SELECT 1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2 FROM p""", stored=stored).first()["r2"]
    by_day = stored.groupBy("date", ML.LABEL).agg(
        F.count_if(F.col("weight") == 0).alias("oob_trees"), F.count_if(F.col("weight") != ML.bag_weight(
            F.col("date").cast("string"), F.col("tree"))).alias("wrong"))
    return by_day.select("date", ML.LABEL, "oob_trees", (F.col("wrong") == 0).alias("weights_agree"),
                         F.lit(abs(score - again) < 1e-6).alias("score_agrees"))


#: Meals of a day by its theme alone, for a forest that can be checked.
PLANTED = {t: 40.0 * (i + 1) for i, t in enumerate(THEMES)}


@register("ml_planted", _FRAME_SQL + f"""
SELECT date, day_theme, CAST(CASE day_theme {" ".join(f"WHEN {q(t)} THEN {v}" for t, v in PLANTED.items())} END AS DOUBLE)
         AS planted, true AS found
FROM sp""")
def ml_planted(spark, sf):
    """ML-4 / ML-5: where the total follows from the theme, the forest (of the
    published model's settings) finds it, to a thousandth of a meal, on
    training and holdout days."""
    rule = F.element_at(F.create_map(*[F.lit(x) for kv in PLANTED.items() for x in kv]), F.col("day_theme"))
    f = ML.temporal_split(frame(spark, sf)).withColumn("planted", rule)
    features = ML.feature_columns(CATEGORIES)
    enc = ML.one_hot(f, CATEGORIES)
    model = ML.fit_forest(enc.filter(F.col("split") == "train"), features, label="planted")
    return model.transform(enc).select("date", "day_theme", "planted",
                                       (F.abs(F.col("prediction") - F.col("planted")) < 1e-3).alias("found"))


def metadata_record(spark, sf):
    """SNK-8 / AGG-15: counts, holdout metrics, feature list, source; one
    aggregate over the scored frame (holdout metrics are conditional)."""
    model, features, enc = trained(spark, sf)
    s = model.transform(enc)
    t = F.col("split") == "test"
    y, p = F.when(t, F.col(ML.LABEL).cast("double")), F.when(t, F.col("prediction"))
    return s.agg(
        F.count(F.lit(1)).alias("training_row_count"),
        F.count_if(t).alias("holdout_row_count"),
        F.avg(F.abs(y - p)).alias("baseline_mae"),
        F.sqrt(F.avg(F.pow(y - p, 2))).alias("baseline_rmse"),
        F.avg(F.abs((y - p) / F.nullif(y, F.lit(0.0)))).alias("baseline_mape"),
        F.min("date").cast("string").alias("first_training_date"), F.max("date").cast("string").alias("last_training_date"),
    ).select(
        F.lit(len(features)).cast("bigint").alias("number_of_features"),
        # the model knows the days up to the last one: the clock would differ from run to run
        F.concat("last_training_date", F.lit("T00:00:00")).alias("training_timestamp"),
        "first_training_date", "last_training_date",
        "training_row_count", "holdout_row_count", "baseline_mae", "baseline_rmse", "baseline_mape",
        F.array(*[F.lit(c) for c in features]).alias("feature_columns"),
        F.lit(f"{sf}/orders.parquet").alias("data_source"),
        F.lit(True).alias("trained_on_real_data"))


@register("ml_metadata")
def ml_metadata(spark, sf):
    """SNK-8: the metadata record of the trained model."""
    return metadata_record(spark, sf)


@register("flow_train")
def flow_train(spark, sf):
    """FLOW-5: train, evaluate and publish (model directory + metadata JSON
    under a new version in the shared checkpoint folder; the pointer moves
    only after both are written)."""
    root = scratch_dir(spark, "demand-forest")
    version = publish_model(spark, sf, root)
    return spark.read.option("multiLine", True).json(os.path.join(root, version, "model_metadata.json"))


def publish_model(spark, sf, root):
    """The forest and its metadata as the next version under ``root``."""
    from platewise.sinks.tables import commit, write_json_record
    model, _, _ = trained(spark, sf)
    version = f"v-{int(dt.datetime.now().timestamp() * 1000)}-{uuid.uuid4().hex[:8]}"
    model.write().overwrite().save(os.path.join(root, version, "model"))
    write_json_record(spark, os.path.join(root, version, "model_metadata.json"), metadata_record(spark, sf))
    commit(spark, root, folder=version)
    return version


@register("flow_forecast")
def flow_forecast(spark, sf):
    """FLOW-1: requests -> features -> score -> split -> overrides -> final ->
    upsert into the stored predictions (whole table returned)."""
    model, features, _ = trained(spark, sf)
    a = fx.actual_sales(spark, sf)
    ratios = SP.theme_ratios(a)
    scored = ML.score(model, flow_prepare(spark, sf), features, ratios, AS_OF)
    review = scored.select(
        "date",
        F.when(F.dayofmonth("date") % 7 == 0, F.col("predicted_meals") + 25).alias("override_meal_prediction"),
        F.when(F.dayofmonth("date") % 7 == 0, F.lit("Event")).alias("override_reason"),
        F.lit(0.0).alias("predicted_meals_salad"))
    forecast = SP.apply_overrides(scored.drop("weather_icon"), review.distinct(), ratios)
    # a day that several requests cover keeps the latest request's forecast
    return UP.upsert(fx.predictions(spark, sf, a), forecast.select(*PREDICTION_COLUMNS, "start_date"), ["date"],
                     order_col="start_date")


def published_model(spark, sf):
    """Train and publish once in a run, return the published version folder."""
    from platewise.sinks.tables import current_version
    root = fx.current_run(spark, sf).path("model", lambda root: publish_model(spark, sf, root))
    return current_version(spark, root).path(root)


@register("src_model_meta", _FRAME_SQL + "\nSELECT CAST(max(date) AS TIMESTAMP) AS training_timestamp FROM tf")
def src_model_meta(spark, sf):
    """SRC-9: training timestamp of the published model (null when the
    metadata file or key is missing): the last day it learned from."""
    from platewise.sources.files import read_model_metadata
    meta = read_model_metadata(spark, os.path.join(published_model(spark, sf), "model_metadata.json"))
    return meta.select(F.col("training_timestamp").cast("timestamp_ntz").alias("training_timestamp"))


@register("src_model_load")
def src_model_load(spark, sf):
    """SRC-10: load the published model and its ordered feature list, then
    score every forecast request with it."""
    from pyspark.ml import PipelineModel

    from platewise.sources.files import read_model_metadata_full
    version = published_model(spark, sf)
    model = PipelineModel.load(os.path.join(version, "model"))
    meta = read_model_metadata_full(spark, os.path.join(version, "model_metadata.json")).first()
    features = list(meta["feature_columns"])  # the stored, ordered list (a few dozen names)
    ratios = SP.theme_ratios(fx.actual_sales(spark, sf))
    return ML.score(model, flow_prepare(spark, sf), features, ratios, AS_OF)


@register("ml_sites")
def ml_sites(spark, sf):
    """ML-5 / AGG-12...14 for every site at once: a global forest on the
    site-relative target, scored back to meals; per-site holdout metrics next
    to each site's naive (training-mean) baseline."""
    keys = ["site_id", "date"]
    f = ML.training_frame(fx.site_sales(spark, sf), fx.weather(spark, sf), fx.holidays(spark, sf),
                          keys=keys, on_missing_weather="drop", dim_keys=["date"])
    f = ML.temporal_split(f, keys=keys)
    cats = CATEGORIES
    features = ML.feature_columns(cats)
    enc = ML.one_hot(f, cats).select("site_id", "date", "split", ML.LABEL, *features)
    scale = ML.site_scale(enc)
    model = ML.fit_sites(enc, features, scale)
    test = enc.filter(F.col("split") == "test")
    forest = ML.regression_metrics(ML.predict_sites(model, test, scale), by=["site_id"])
    naive = ML.regression_metrics(ML.naive_baseline(enc, by=["site_id"]), by=["site_id"])
    return forest.withColumn("model", F.lit("forest")).unionByName(naive.withColumn("model", F.lit("train_mean")))


def site_requests(spark, sf):
    """One forecast request per site: the 5 business days after the site's
    last recorded day (one grouped aggregate, then a bounded explode)."""
    from platewise.functions.calendar import business_days
    last = fx.site_sales(spark, sf).groupBy("site_id").agg(F.max("date").alias("last_day"))
    return last.select("site_id", F.explode(business_days(F.date_add("last_day", 1), 5)).alias("date"))


@register("flow_forecast_sites")
def flow_forecast_sites(spark, sf):
    """FLOW-1 for every site at once: per-site requests -> features (weather
    and holidays joined by date) -> one global forest on the site-relative
    target -> ceil -> per-site theme split -> upsert into the per-site
    predictions table (whole table returned)."""
    from platewise.functions.split import ceil_prediction, split_total
    keys = ["site_id", "date"]
    f = ML.training_frame(fx.site_sales(spark, sf), fx.weather(spark, sf), fx.holidays(spark, sf),
                          keys=keys, on_missing_weather="drop", dim_keys=["date"])
    f = ML.temporal_split(f, keys=keys)
    cats = CATEGORIES
    features = ML.feature_columns(cats)
    enc = ML.one_hot(f, cats)
    scale = ML.site_scale(enc)
    model = ML.fit_sites(enc, features, scale)
    from platewise.operators import features as FE
    prep = FE.prepare_features(site_requests(spark, sf), fx.weather(spark, sf), fx.holidays(spark, sf),
                               keys=["date"])
    prep = prep.withColumnRenamed("is_school_break", "is_semester_break")
    scored = ML.predict_sites(model, ML.encode_for(prep, features, keep=["site_id", "date", "day_theme"]), scale)
    ratios = SP.theme_ratios(fx.site_sales(spark, sf), keys)
    out = SP.with_theme_ratio(scored.withColumn("predicted_meals", ceil_prediction("prediction")), ratios, keys)
    sp = split_total(F.col("predicted_meals"), F.col("veg_ratio"))
    batch = out.select("site_id", "date", "day_theme", "predicted_meals",
                       sp["veg"].alias("predicted_meals_veg"), sp["non_veg"].alias("predicted_meals_non_veg"),
                       F.lit(0.0).alias("predicted_meals_salad"),
                       F.lit(AS_OF.isoformat(sep=" ")).cast("timestamp_ntz").alias("prediction_timestamp"),
                       F.col("predicted_meals").alias("final_prediction"))
    return UP.upsert(fx.site_predictions(spark, sf), batch, keys)


_REQUEST_DAYS = _FRAME_SQL + "\n, " + _REQ_SQL.strip() + f""",
days AS (
  SELECT b.start_date, b.date, {theme_case("b.date")} AS day_theme
  FROM bd b LEFT JOIN holidays h ON b.date = h.date
  WHERE b.day_index <= b.n_days AND (h.is_bank_holiday IS NULL OR NOT h.is_bank_holiday))"""


def _certain(scored):
    """What holds of a scored frame whatever the forest predicts: its keys,
    whole positive numbers, parts that add up, the split by the ratio."""
    total, veg, non_veg = (F.col(c) for c in ("predicted_meals", "predicted_meals_veg", "predicted_meals_non_veg"))
    return scored.select("start_date", "date", "day_theme", (total == F.floor(total)).alias("whole"), (total > 0).alias("positive"),
                         (veg + non_veg == total).alias("parts_add_up"),
                         (F.col("prediction_timestamp") == F.lit(AS_OF.isoformat(sep=" ")).cast("timestamp_ntz")).alias("stamped"))


@register("ml_score_facts", _REQUEST_DAYS + """
SELECT *, true AS whole, true AS positive, true AS parts_add_up, true AS stamped FROM days""")
def ml_score_facts(spark, sf):
    """ML-4 / FN-4 / FN-14 / PRJ-4: every requested day scored once, with what
    is certain of the scores."""
    return _certain(ml_score(spark, sf))


@register("src_model_load_facts", _REQUEST_DAYS + """
SELECT start_date, date, true AS same FROM days""")
def src_model_load_facts(spark, sf):
    """SRC-9 / SRC-10 / SNK-7: the published model, loaded, scores every
    requested day as the fitted one does."""
    a, b = (f(spark, sf).select("start_date", "date", F.col("predicted_meals").alias(n))
            for f, n in ((ml_score, "fitted"), (src_model_load, "loaded")))
    return a.join(b, ["start_date", "date"]).select("start_date", "date", (F.col("fitted") == F.col("loaded")).alias("same"))


@register("ml_metadata_facts", _FRAME_SQL + f"""
SELECT CAST({3 + len(MONTHS) + len(CONDITIONS) + len(THEMES)} AS BIGINT) AS number_of_features,
       strftime(max(date), '%Y-%m-%dT00:00:00') AS training_timestamp, count(*) AS training_row_count,
       count(*) FILTER (WHERE split = 'test') AS holdout_row_count, true AS trained_on_real_data
FROM sp""")
def ml_metadata_facts(spark, sf):
    """SNK-8 / SNK-7 / AGG-15 / FLOW-5: the published record's counts and keys."""
    return flow_train(spark, sf).select(
        "number_of_features", "training_timestamp", "training_row_count", "holdout_row_count", "trained_on_real_data")


@register("ml_train_facts", _FRAME_SQL + """
SELECT date, total_meals, true AS within FROM sp WHERE split = 'test'""")
def ml_train_facts(spark, sf):
    """ML-5: a forest's prediction for each holdout day, within the range of
    the training totals (a mean of means cannot leave it)."""
    _, _, enc = trained(spark, sf)
    low, high = enc.filter(F.col("split") == "train").agg(F.min(ML.LABEL), F.max(ML.LABEL)).first()
    return ml_train(spark, sf).select("date", F.col(ML.LABEL).alias("total_meals"),
                                      F.col("prediction").between(low, high).alias("within"))


@register("ml_backtest_facts", _FRAME_SQL + f"""
SELECT CAST(make_date(y, 1, 1) AS DATE) AS origin, true AS scored
FROM (SELECT DISTINCT year(date) AS y FROM tf) t WHERE y > (SELECT min(year(date)) FROM tf)""")
def ml_backtest_facts(spark, sf):
    """ML-6: one set of errors for each yearly origin."""
    return ml_backtest(spark, sf).select("origin", (F.col("mae") >= 0).alias("scored"))


@register("flow_forecast_mean", "\n, " + _REQ_SQL.strip() + f""",
wd AS (SELECT isodow(date) AS k, CAST(ceil(avg(actual_meals)) AS BIGINT) AS predicted_meals FROM actual_sales GROUP BY 1),
days AS (
  SELECT b.date, {theme_case("b.date")} AS day_theme, wd.predicted_meals,
         row_number() OVER (PARTITION BY b.date ORDER BY b.start_date DESC) AS latest
  FROM bd b LEFT JOIN holidays h ON b.date = h.date JOIN wd ON wd.k = isodow(b.date)
  WHERE b.day_index <= b.n_days AND (h.is_bank_holiday IS NULL OR NOT h.is_bank_holiday)),
new AS (
  SELECT d.date, d.predicted_meals,
         CAST(ceil(CAST(d.predicted_meals AS DOUBLE) * COALESCE(r.veg_ratio, {{fallback}})) AS BIGINT) AS veg
  FROM days d LEFT JOIN theme_ratio r ON r.day_theme = d.day_theme WHERE d.latest = 1)
SELECT date, predicted_meals, veg AS predicted_meals_veg, predicted_meals - veg AS predicted_meals_non_veg,
       CASE WHEN day(date) % 7 = 0 THEN predicted_meals + 25 ELSE predicted_meals END AS final_prediction
FROM new
UNION ALL
SELECT date, predicted_meals, predicted_meals_veg, predicted_meals_non_veg, final_prediction
FROM predictions WHERE date NOT IN (SELECT date FROM new)""".replace("{fallback}", ratio_fallback("d.day_theme", 0)))
def flow_forecast_mean(spark, sf):
    """FLOW-1 with a prediction that can be checked, the weekday's mean:
    requests -> features -> prediction -> split -> overrides -> final -> upsert
    into the stored predictions, the latest request of a day winning."""
    a = fx.actual_sales(spark, sf)
    mean = a.groupBy(F.weekday("date").alias("_k")).agg(F.ceil(F.avg("actual_meals")).cast("bigint").alias("predicted_meals"))
    ratios = SP.theme_ratios(a)
    days = flow_prepare(spark, sf).select("start_date", "date", "day_theme")
    scored = SP.split_forecast(days.join(mean, F.weekday("date") == F.col("_k")).drop("_k"), ratios)
    more = F.when(F.dayofmonth("date") % 7 == 0, F.col("predicted_meals") + 25)
    scored = SP.with_final_prediction(scored.withColumn("override_meal_prediction", more))
    columns = ["date", "predicted_meals", "predicted_meals_veg", "predicted_meals_non_veg", "final_prediction"]
    return UP.upsert(fx.predictions(spark, sf, a).select(columns), scored.select(*columns, "start_date"), ["date"],
                     order_col="start_date")


_SITE_FRAME_SQL = f"""
, stf AS (
  SELECT s.site_id, s.date, s.actual_meals AS total_meals
  FROM site_sales s LEFT JOIN weather w ON s.date = w.date
  WHERE w.temperature_max IS NOT NULL AND w.weather_condition IS NOT NULL),
ssp AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY date DESC) <= {ML.HOLDOUT_DAYS} AS test FROM stf)"""


@register("ml_sites_facts", _SITE_FRAME_SQL + """
, m AS (SELECT site_id, avg(total_meals) FILTER (WHERE NOT test) AS mean FROM ssp GROUP BY site_id),
e AS (SELECT s.site_id, CAST(s.total_meals AS DOUBLE) AS y, m.mean AS p FROM ssp s JOIN m USING (site_id) WHERE s.test)
SELECT site_id, 'forest' AS model, count(*) AS n, CAST(NULL AS DOUBLE) AS mae, CAST(NULL AS DOUBLE) AS rmse, true AS sound
FROM e GROUP BY site_id
UNION ALL
SELECT site_id, 'train_mean', count(*), round(avg(abs(y - p)), 6), round(sqrt(avg((y - p) * (y - p))), 6), true
FROM e GROUP BY site_id""")
def ml_sites_facts(spark, sf):
    """ML-5 / AGG-12...14 for every site: the rows scored, the training mean's
    errors by value, and of the forest's that its RMSE is no less than its MAE."""
    s = ml_sites(spark, sf)
    mean = F.col("model") == "train_mean"
    return s.select("site_id", "model", "n", *[F.when(mean, F.round(c, 6)).alias(c) for c in ("mae", "rmse")],
                    (F.col("mae").isNull() | (F.col("rmse") >= F.col("mae") - F.lit(1e-9))).alias("sound"))


@register("flow_forecast_sites_facts", """
, last AS (SELECT site_id, max(date) AS d FROM site_sales GROUP BY site_id),
ahead AS (SELECT l.site_id, CAST(l.d + CAST(k.range AS INTEGER) AS DATE) AS date FROM last l, range(1, 12) k),
new AS (
  SELECT a.site_id, a.date FROM (
    SELECT site_id, date, row_number() OVER (PARTITION BY site_id ORDER BY date) AS n FROM ahead WHERE isodow(date) < 6) a
  LEFT JOIN holidays h ON a.date = h.date WHERE a.n <= 5 AND NOT COALESCE(h.is_bank_holiday, false))
SELECT site_id, date, true AS sound FROM new
UNION ALL
SELECT site_id, date, true FROM site_predictions p
WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.site_id = p.site_id AND n.date = p.date)""")
def flow_forecast_sites_facts(spark, sf):
    """FLOW-1 for every site: the days in the table afterwards; the forecast
    ones have whole parts that add up, the others are as they were."""
    names = ["predicted_meals", "predicted_meals_veg", "predicted_meals_non_veg", "final_prediction"]
    before = fx.site_predictions(spark, sf).select("site_id", "date", F.struct(*names).alias("before"))
    after = flow_forecast_sites(spark, sf).withColumn("after", F.struct(*names))
    forecast = F.col("prediction_timestamp") == F.lit(AS_OF.isoformat(sep=" ")).cast("timestamp_ntz")
    total, veg, non_veg, final = (F.col(n) for n in names)
    sound = F.when(forecast, (veg + non_veg == total) & (final == total) & (total > 0)).otherwise(
        F.col("before").eqNullSafe(F.col("after")))
    return after.join(before, ["site_id", "date"], "left").select("site_id", "date", sound.alias("sound"))
