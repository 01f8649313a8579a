"""Model training, evaluation and scoring with MLlib (ML-1...7, WIN-1,
AGG-12...15, SNK-7, SNK-8).

* The training frame is one row per (site?, day): already aggregated.
* The temporal holdout uses a cutoff date found with a bounded top-N
  (``orderBy(desc).limit(N)`` is a per-partition top-N plus a merge, not a
  global sort); with sites it is a window per site.
* One-hot categories are discovered with one ``collect_set`` aggregate over
  three low-cardinality columns (months, five weather conditions, five
  themes): at most 22 values reach the driver.
* With many sites one global forest learns a site-relative target; site
  means are one grouped aggregate joined back by key.
* The forest is MLlib's distributed ``RandomForestRegressor``; scoring is
  ``PipelineModel.transform`` (JVM, no Python UDF).
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from platewise.functions.split import ceil_prediction
from platewise.operators.features import add_calendar, join_holidays, join_weather, missing_weather
from platewise.operators.split import split_forecast

CATEGORICAL = ["month", "weather_condition", "day_theme"]
NUMERIC = ["temperature_max", "is_semester_break", "is_bridge_day"]
LABEL = "total_meals"
HOLDOUT_DAYS = 10

# Forest settings of the published model: 200 trees, depth 4, min leaf 3,
# seed 0, every feature considered at each split.
FOREST = dict(numTrees=200, maxDepth=4, minInstancesPerNode=3, seed=0,
              featureSubsetStrategy="all", bootstrap=True, subsamplingRate=1.0)


def training_frame(sales: DataFrame, weather: DataFrame, holidays: DataFrame,
                   keys: Sequence[str] = ("date",), on_missing_weather: str = "raise",
                   dim_keys: Sequence[str] | None = None) -> DataFrame:
    """ML-1: daily totals + calendar + weather + holidays.

    ``sales`` has ``keys`` and ``actual_meals`` (or ``total_meals``). The
    school-break flag is named ``is_semester_break`` for the model, at both
    training and scoring time (Q2 is not reproduced). Days without weather
    are refused (``on_missing_weather='raise'``, FLT-6) or left out
    (``'drop'``; ``features.missing_weather`` reports them).
    """
    keys = list(keys)
    dims = list(dim_keys) if dim_keys else keys  # e.g. ["date"] when weather is regional, not per site
    total = "total_meals" if "total_meals" in sales.columns else "actual_meals"
    df = sales.select(*keys, F.col(total).alias(LABEL))
    df = add_calendar(df)
    df = join_weather(df, weather, dims, columns=("temperature_max", "weather_condition"))
    df = join_holidays(df, holidays, dims).drop("holiday_desc", "is_bank_holiday")
    df = df.withColumnRenamed("is_school_break", "is_semester_break").withColumns({
        "is_semester_break": F.coalesce(F.col("is_semester_break"), F.lit(False)),
        "is_bridge_day": F.coalesce(F.col("is_bridge_day"), F.lit(False)),
    })
    if on_missing_weather == "raise":
        missing_weather(df, strict=True)
        return df
    if on_missing_weather == "drop":
        return df.filter(F.col("temperature_max").isNotNull() & F.col("weather_condition").isNotNull())
    raise ValueError("on_missing_weather must be 'raise' or 'drop'")


def holdout_cutoff(frame: DataFrame, n: int = HOLDOUT_DAYS) -> dt.date | None:
    """The earliest of the last ``n`` dates: a top-N (per-partition top-N
    and a merge, no global sort); ``n`` dates reach the driver."""
    rows = frame.select("date").orderBy(F.col("date").desc()).limit(n).collect()
    return min(r[0] for r in rows) if rows else None


def temporal_split(frame: DataFrame, n: int = HOLDOUT_DAYS, keys: Sequence[str] = ("date",)) -> DataFrame:
    """WIN-1: tag the last ``n`` rows (by date) of each site ``test``, the
    rest ``train``; never shuffled."""
    site = [k for k in keys if k != "date"]
    if site:
        w = Window.partitionBy(*site).orderBy(F.col("date").desc())
        return frame.withColumn("split", F.when(F.row_number().over(w) <= n, F.lit("test"))
                                .otherwise(F.lit("train")))
    cutoff = holdout_cutoff(frame, n)
    return frame.withColumn("split", F.when(F.col("date") >= F.lit(cutoff), F.lit("test"))
                            .otherwise(F.lit("train")))


def categories(frame: DataFrame, columns: Sequence[str] = CATEGORICAL) -> dict[str, list[str]]:
    """Observed values per categorical column, in one aggregate job
    (bounded: 12 months, 5 weather conditions, 5 themes)."""
    row = frame.agg(*[F.collect_set(c).alias(c) for c in columns]).first()
    return {c: sorted(row[c] or []) for c in columns}


def feature_columns(cats: dict[str, list[str]]) -> list[str]:
    """Stored feature order: numeric columns, then ``<column>_<value>`` per
    categorical column, values sorted."""
    return list(NUMERIC) + [f"{c}_{v}" for c in CATEGORICAL for v in cats.get(c, [])]


def one_hot(frame: DataFrame, cats: dict[str, list[str]]) -> DataFrame:
    """ML-2: numeric flags as doubles plus one 0/1 column per observed category
    (the weekday is not encoded: it is the theme under another name)."""
    cols = {c: F.col(c).cast("double") for c in NUMERIC}
    for c in CATEGORICAL:
        for v in cats.get(c, []):
            cols[f"{c}_{v}"] = F.when(F.col(c) == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0))
    return frame.withColumns(cols)


def align(frame: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """ML-3: exactly the stored feature columns, in order; features the frame
    lacks (a category never seen at scoring time) are 0 (Q3), extras dropped."""
    have = set(frame.columns)
    return frame.select(*keep, *[(F.col(c).cast("double") if c in have else F.lit(0.0)).alias(c)
                                 for c in features])


def encode_for(frame: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One-hot with the categories named in ``features``, then ML-3."""
    cats: dict[str, list[str]] = {}
    for f in features:
        for c in CATEGORICAL:
            if f.startswith(c + "_"):
                cats.setdefault(c, []).append(f[len(c) + 1:])
    return align(one_hot(frame, cats), features, keep)


def fit_forest(train: DataFrame, features: Sequence[str], label: str = LABEL, **overrides) -> PipelineModel:
    """ML-5: assemble + random forest on the training rows."""
    params = {**FOREST, **overrides}
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    rf = RandomForestRegressor(featuresCol="features", labelCol=label, predictionCol="prediction", **params)
    # the forest makes several passes over its input (metadata, split
    # candidates, one pass per tree level): keep the joined training rows
    # instead of recomputing them each time (recomputed from lineage if an
    # executor is lost)
    data = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return Pipeline(stages=[asm, rf]).fit(data)
    finally:
        data.unpersist()


def regression_metrics(df: DataFrame, label: str = LABEL, pred: str = "prediction",
                       by: Sequence[str] = ()) -> DataFrame:
    """AGG-13 / AGG-14: MAE, RMSE, R², MAPE (denominator: the actual, zero
    actuals skipped) in one aggregate."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.sqrt(F.avg(F.pow(y - p, 2))).alias("rmse"),
        F.sum(F.pow(y - p, 2)).alias("_sse"),
        F.var_pop(y).alias("_var"),
        F.avg(F.abs((y - p) / F.nullif(y, F.lit(0.0)))).alias("mape"),
    )
    r2 = F.lit(1.0) - F.col("_sse") / F.nullif(F.col("_var") * F.col("n"), F.lit(0.0))
    return g.withColumn("r2", r2).drop("_sse", "_var")


def naive_baseline(split_frame: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AGG-12: predict the training mean for every holdout row (per site
    when ``by`` is given: a join on the site key; otherwise the single mean
    is a scalar literal)."""
    train = split_frame.filter(F.col("split") == "train")
    test = split_frame.filter(F.col("split") == "test")
    if by:
        means = train.groupBy(*by).agg(F.avg(LABEL).alias("train_mean"))
        j = test.join(means, list(by), "left")
    else:
        mean = train.agg(F.avg(LABEL)).first()[0]
        j = test.withColumn("train_mean", F.lit(mean).cast("double"))
    return j.withColumn("prediction", F.col("train_mean"))


def score(model: PipelineModel, frame: DataFrame, features: Sequence[str], ratios: DataFrame,
          as_of, keys: Sequence[str] = ("date",)) -> DataFrame:
    """ML-4: one-hot + align, predict, ceil (FN-4), stamp (FN-14), split (FN-3).

    ``as_of`` is the prediction timestamp (a parameter, not the wall clock).
    The scoring frame's ``is_school_break`` feeds the model's
    ``is_semester_break`` feature (one name for both, unlike Q2).
    """
    renamed = "is_school_break" in frame.columns and "is_semester_break" not in frame.columns
    x = frame.withColumnRenamed("is_school_break", "is_semester_break") if renamed else frame
    keep = [c for c in x.columns if c not in features]
    scored = model.transform(encode_for(x, features, keep=keep))
    restored = [F.col(c).cast("boolean").alias(c) if c in ("is_semester_break", "is_bridge_day") else F.col(c)
                for c in NUMERIC if c in x.columns]
    out = scored.select(*keep, *restored, ceil_prediction("prediction").alias("predicted_meals"))
    if renamed:
        out = out.withColumnRenamed("is_semester_break", "is_school_break")
    # a wall-clock literal parsed from text: independent of the session time zone
    ts = as_of if isinstance(as_of, F.Column) else F.lit(
        as_of.isoformat(sep=" ") if isinstance(as_of, dt.datetime) else str(as_of)).cast("timestamp_ntz")
    out = out.withColumn("prediction_timestamp", ts)
    return split_forecast(out, ratios, keys)


def feature_importances(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    imp = model.stages[-1].featureImportances
    return sorted(zip(features, imp.toArray().tolist()), key=lambda kv: -kv[1])


# --- out-of-bag score: bagging by weights that follow from the key ----------
# MLlib's forest draws its bootstrap inside and keeps no record of it, so the
# rows that a tree has not seen cannot be told. Here a row's weight in a tree
# is a Poisson(1) number taken from a hash of the row's key and the tree: the
# bootstrap of large samples, known afterwards, the same on any partitioning.

#: Poisson(1) is at least k + 1 when a number below 2^32 is at least the k-th of these.
POISSON = [round(2 ** 32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(9)]


def bag_weight(key: Column, tree: Column) -> Column:
    """How often a row counts in a tree: 0 to 9, from the first 32 bits of the
    md5 of ``key:tree``."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", key, tree)), 1, 8), 16, 10).cast("bigint")
    return sum((F.when(drawn >= x, 1).otherwise(0) for x in POISSON), F.lit(0))


def tree_arrays(model: DecisionTreeRegressionModel, depth: int) -> tuple[list[int], list[float], list[float]]:
    """A regression tree filled up to ``depth``: feature and threshold of its
    inner nodes (the children of i are 2 i + 1, where the value is at most the
    threshold, and 2 i + 2) and the leaves' values. All features are numbers
    (the one-hot ones 0 and 1), so all splits have thresholds."""
    feature, threshold, value = [0] * (2 ** depth - 1), [math.inf] * (2 ** depth - 1), [0.0] * 2 ** depth

    def fill(node, i: int) -> None:
        if i >= len(feature):
            value[i - len(feature)] = float(node.prediction())
        elif node.getClass().getSimpleName() == "InternalNode":
            feature[i], threshold[i] = node.split().featureIndex(), float(node.split().threshold())
            fill(node.leftChild(), 2 * i + 1)
            fill(node.rightChild(), 2 * i + 2)
        else:  # a leaf above: all below it have its value
            fill(node, 2 * i + 1)
            fill(node, 2 * i + 2)

    fill(model._call_java("rootNode"), 0)
    return feature, threshold, value


def fit_bagged(train: DataFrame, features: Sequence[str], key: Column, label: str = LABEL,
               trees: int = FOREST["numTrees"], threads: int = 8) -> list[DecisionTreeRegressionModel]:
    """ML-5 with known bags: ``trees`` regression trees of the forest's depth
    and leaf size, each on its own weights, ``threads`` of them at a time."""
    asm = VectorAssembler(inputCols=list(features), outputCol="features")
    data = asm.transform(train.withColumn("bag_key", key)).select("bag_key", "features", F.col(label).cast("double").alias("label"))
    data = data.persist(StorageLevel.MEMORY_AND_DISK)

    def fit(tree: int) -> DecisionTreeRegressionModel:
        rows = data.withColumn("weight", bag_weight(F.col("bag_key"), F.lit(tree)).cast("double")).filter("weight > 0")
        return DecisionTreeRegressor(featuresCol="features", labelCol="label", weightCol="weight", seed=FOREST["seed"],
                                     maxDepth=FOREST["maxDepth"], minInstancesPerNode=FOREST["minInstancesPerNode"]).fit(rows)

    try:
        data.count()
        with ThreadPoolExecutor(threads) as pool:
            return list(pool.map(inheritable_thread_target(data.sparkSession)(fit), range(trees)))
    finally:
        data.unpersist()


def bag_predictions(rows: DataFrame, models: Sequence[DecisionTreeRegressionModel], features: Sequence[str],
                    key: Column, keep: Sequence[str]) -> DataFrame:
    """(``keep``, tree, weight, prediction): every row with every tree."""
    depth = FOREST["maxDepth"]
    trees = F.array(*[F.struct(F.lit(t).alias("tree"), *[F.lit(x).alias(n) for n, x in zip(
        ("feature", "threshold", "value"), tree_arrays(m, depth))]) for t, m in enumerate(models)])
    out = rows.select(*keep, key.alias("_key"), F.array(*features).alias("_x"), F.inline(trees))

    def down(i: Column, _: Column) -> Column:
        right = F.get("_x", F.get("feature", i)) > F.get("threshold", i)
        return 2 * i + F.when(right, 2).otherwise(1)

    leaf = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), down) - (2 ** depth - 1)
    return out.select(*keep, "tree", bag_weight(F.col("_key"), F.col("tree")).alias("weight"),
                      F.get("value", leaf).alias("prediction"))


def out_of_bag(predictions: DataFrame, keep: Sequence[str]) -> DataFrame:
    """ML-6: one row per row: ``oob_trees``, the trees that have not seen it,
    and their mean ``prediction`` (null where every tree has)."""
    unseen = F.col("weight") == 0
    return predictions.groupBy(*keep).agg(
        F.count_if(unseen).alias("oob_trees"), F.avg(F.when(unseen, F.col("prediction"))).alias("prediction"))


def oob_score(oob: DataFrame, label: str = LABEL, by: Sequence[str] = ()) -> DataFrame:
    """ML-6: the out-of-bag errors and R² (rows that every tree has seen left out)."""
    return regression_metrics(oob.filter(F.col("prediction").isNotNull()), label, by=by)


# --- many sites: one global forest on a per-site normalised target ----------
# With thousands of sites one model per site cannot be trained in parallel
# with MLlib, and the calendar / weather features cannot tell sites apart.
# The global forest therefore learns the *relative* demand (total divided by
# the site's mean over its training days) from every site's rows at once;
# each prediction is scaled back by its site's mean. The site means are one
# grouped aggregate (one row per site), joined back by key.

NORM_LABEL = "relative_meals"


def site_scale(split_frame: DataFrame, site: Sequence[str] = ("site_id",)) -> DataFrame:
    """Mean daily total per site over its training rows. A site without any
    (too short a history) gets the mean over all sites' training rows, flagged
    ``fallback``."""
    train = F.when(F.col("split") == "train", F.col(LABEL))
    by = split_frame.groupBy(*site).agg(F.avg(train).alias("own"))
    every = split_frame.agg(F.avg(train)).first()[0]  # one scalar
    return by.select(*site, F.coalesce(F.col("own"), F.lit(every)).alias("site_mean"),
                     F.col("own").isNull().alias("fallback"))


def with_relative_label(split_frame: DataFrame, scale: DataFrame, site: Sequence[str] = ("site_id",)) -> DataFrame:
    j = split_frame.join(scale.drop("fallback"), list(site), "left")
    return j.withColumn(NORM_LABEL, F.col(LABEL) / F.nullif(F.col("site_mean"), F.lit(0.0)))


def fit_sites(split_frame: DataFrame, features: Sequence[str], scale: DataFrame,
              site: Sequence[str] = ("site_id",), **overrides) -> PipelineModel:
    """ML-5 across sites: one forest on the relative target."""
    train = with_relative_label(split_frame.filter(F.col("split") == "train"), scale, site)
    return fit_forest(train.filter(F.col(NORM_LABEL).isNotNull()), features, label=NORM_LABEL, **overrides)


def predict_sites(model: PipelineModel, encoded: DataFrame, scale: DataFrame,
                  site: Sequence[str] = ("site_id",)) -> DataFrame:
    """Relative prediction x site mean -> ``prediction`` in meals; no site
    drops out (see ``site_scale``), and ``fallback`` tells those scaled by the
    mean over all."""
    j = encoded.join(scale, list(site), "left")
    return model.transform(j).withColumn("prediction", F.col("prediction") * F.col("site_mean"))
