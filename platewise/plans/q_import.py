"""Queries: import validation and manual correction (VAL-1...6, WIN-2,
PRJ-12, JON-7, FLOW-3, FLOW-4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise import fixtures as fx
from platewise.operators import upsert as UP
from platewise.operators import validate as V
from platewise.operators.compare import missing_actuals
from platewise.plans.catalog import register
from platewise.plans.q_split import EDITS_SQL, edits
from platewise.sources.files import read_csv_files

HEADERS = {"date": "Datum", "actual_meals": "Gesamt", "actual_meals_veg": "Veg",
           "actual_meals_non_veg": "Non-Veg", "actual_meals_salad": "SALAT"}


def import_files(spark, sf):
    """The ``import_rows`` view: actual_sales as uploaded text, one file per
    month (``batch``), German / mixed-case headers. Every 17th day of the
    year is broken, the kind cycling with ``dayofyear / 17``: 0 bad date
    format, 1 half meals, 2 missing veg, 3 wrong total, 4 decimal salad,
    5 integral float (valid). Some days come twice, first with ten more:
    every day with ``dayofyear % 17 = 1`` in one file (``seq`` 0 stands before
    1), every one with 2 also in the file of the month before."""
    a = fx.actual_sales(spark, sf).withColumn("seq", F.lit(1)).withColumn("bdate", F.col("date"))
    doy = F.dayofyear("date")
    more = a.withColumns({"actual_meals": F.col("actual_meals") + 10, "actual_meals_veg": F.col("actual_meals_veg") + 10,
                          "seq": F.lit(0)})
    a = a.unionByName(more.filter(doy % 17 == 1)).unionByName(
        more.filter(doy % 17 == 2).withColumn("bdate", F.add_months("date", -1)))
    broken = (doy % 17) == 0
    kind = F.floor(doy / 17) % 6

    def s(c):
        return F.col(c).cast("string")

    return a.select(
        F.date_format("bdate", "yyyy-MM").alias("batch"), "seq",
        F.when(broken & (kind == 0), F.date_format("date", "dd.MM.yyyy"))
         .otherwise(F.date_format("date", "yyyy-MM-dd")).alias(HEADERS["date"]),
        F.when(broken & (kind == 1), F.concat(s("actual_meals"), F.lit(".5")))
         .when(broken & (kind == 3), (F.col("actual_meals") + 1).cast("string"))
         .when(broken & (kind == 5), F.concat(s("actual_meals"), F.lit(".0")))
         .otherwise(s("actual_meals")).alias(HEADERS["actual_meals"]),
        F.when(broken & (kind == 2), F.lit(None).cast("string"))
         .otherwise(s("actual_meals_veg")).alias(HEADERS["actual_meals_veg"]),
        s("actual_meals_non_veg").alias(HEADERS["actual_meals_non_veg"]),
        F.when(broken & (kind == 4), s("actual_meals_salad"))
         .otherwise(F.floor("actual_meals_salad").cast("string")).alias(HEADERS["actual_meals_salad"]),
    )


def resolved(spark, sf):
    return V.resolve_columns(import_files(spark, sf), keep=["batch", "seq"]).drop("seq")


SEPARATORS = {0: ";", 1: ",", 2: "\t"}


def write_import_files(spark, sf, root: str) -> None:
    """One CSV per monthly batch; the separator cycles ``;`` / ``,`` / tab by month."""
    f = import_files(spark, sf).withColumn("_m", F.substring("batch", 6, 2).cast("int") % 3)
    for k, sep in SEPARATORS.items():
        part = f.filter(F.col("_m") == k).drop("_m")
        (part.repartition("batch").sortWithinPartitions("batch", "Datum", "seq").drop("seq")
             .write.mode("append").partitionBy("batch").option("header", True).option("sep", sep)
             .option("quoteAll", k == 1).csv(root))


def landed(spark, sf):
    """The folder of the uploaded files, written once in a run."""
    return fx.current_run(spark, sf).path("import_files", lambda p: write_import_files(spark, sf, p))


def batch_of(path_col):
    return F.regexp_extract(path_col, r"batch=([0-9]{4}-[0-9]{2})", 1)


def uploaded(spark, sf):
    """The rows of all uploaded files: batch, position in the file, five columns."""
    out = None
    for _, df in read_csv_files(spark, landed(spark, sf)):
        r = V.resolve_columns(df, keep=["_file", "ordinal"])
        r = r.withColumn("batch", batch_of(F.col("_file"))).drop("_file")
        out = r if out is None else out.unionByName(r)
    if out is None:
        return spark.createDataFrame([], "ordinal bigint, date string, " + "".join(f"{c} string, " for c in V.VALUE_COLUMNS) + "batch string")
    return out


def checked(spark, sf):
    return V.validate_rows(uploaded(spark, sf).withColumn("raw_date", F.col("date")))


IMPORT_SQL = """
landed AS (
  SELECT *, 1 AS seq, date AS bdate FROM actual_sales
  UNION ALL
  SELECT date, actual_meals + 10, actual_meals_veg + 10, actual_meals_non_veg, actual_meals_salad, 0, date
  FROM actual_sales WHERE dayofyear(date) % 17 = 1
  UNION ALL
  SELECT date, actual_meals + 10, actual_meals_veg + 10, actual_meals_non_veg, actual_meals_salad, 0,
         CAST(date - INTERVAL 1 MONTH AS DATE)
  FROM actual_sales WHERE dayofyear(date) % 17 = 2),
import_rows AS (
  SELECT strftime(bdate, '%Y-%m') AS batch, seq,
         CASE WHEN dayofyear(date) % 17 = 0 AND (dayofyear(date) // 17) % 6 = 0 THEN strftime(date, '%d.%m.%Y')
              ELSE strftime(date, '%Y-%m-%d') END AS date,
         CASE WHEN dayofyear(date) % 17 = 0 AND (dayofyear(date) // 17) % 6 = 1 THEN CAST(actual_meals AS VARCHAR) || '.5'
              WHEN dayofyear(date) % 17 = 0 AND (dayofyear(date) // 17) % 6 = 3 THEN CAST(actual_meals + 1 AS VARCHAR)
              WHEN dayofyear(date) % 17 = 0 AND (dayofyear(date) // 17) % 6 = 5 THEN CAST(actual_meals AS VARCHAR) || '.0'
              ELSE CAST(actual_meals AS VARCHAR) END AS actual_meals,
         CASE WHEN dayofyear(date) % 17 = 0 AND (dayofyear(date) // 17) % 6 = 2 THEN NULL
              ELSE CAST(actual_meals_veg AS VARCHAR) END AS actual_meals_veg,
         CAST(actual_meals_non_veg AS VARCHAR) AS actual_meals_non_veg,
         CASE WHEN dayofyear(date) % 17 = 0 AND (dayofyear(date) // 17) % 6 = 4 THEN CAST(actual_meals_salad AS VARCHAR)
              ELSE CAST(CAST(floor(actual_meals_salad) AS BIGINT) AS VARCHAR) END AS actual_meals_salad,
         date AS true_date
  FROM landed),
checked AS (
  SELECT *,
         CAST(row_number() OVER (PARTITION BY batch ORDER BY date, seq) - 1 AS BIGINT) AS ordinal,
         concat_ws(',',
           CASE WHEN NOT COALESCE(regexp_full_match(trim(date), '\\d{4}-\\d{2}-\\d{2}')
                                  AND try_strptime(trim(date), '%Y-%m-%d') IS NOT NULL, false) THEN 'date' END,
           CASE WHEN NOT COALESCE(TRY_CAST(trim(actual_meals) AS DOUBLE) = floor(TRY_CAST(trim(actual_meals) AS DOUBLE)), false) THEN 'actual_meals' END,
           CASE WHEN NOT COALESCE(TRY_CAST(trim(actual_meals_veg) AS DOUBLE) = floor(TRY_CAST(trim(actual_meals_veg) AS DOUBLE)), false) THEN 'actual_meals_veg' END,
           CASE WHEN NOT COALESCE(TRY_CAST(trim(actual_meals_non_veg) AS DOUBLE) = floor(TRY_CAST(trim(actual_meals_non_veg) AS DOUBLE)), false) THEN 'actual_meals_non_veg' END,
           CASE WHEN NOT COALESCE(TRY_CAST(trim(actual_meals_salad) AS DOUBLE) = floor(TRY_CAST(trim(actual_meals_salad) AS DOUBLE)), false) THEN 'actual_meals_salad' END
         ) AS errors,
         CAST(try_strptime(trim(date), '%Y-%m-%d') AS DATE) AS t_date,
         CAST(trunc(TRY_CAST(trim(actual_meals) AS DOUBLE)) AS BIGINT) AS t_meals,
         CAST(trunc(TRY_CAST(trim(actual_meals_veg) AS DOUBLE)) AS BIGINT) AS t_veg,
         CAST(trunc(TRY_CAST(trim(actual_meals_non_veg) AS DOUBLE)) AS BIGINT) AS t_non_veg,
         TRY_CAST(trim(actual_meals_salad) AS DOUBLE) AS t_salad
  FROM import_rows),
checked2 AS (
  SELECT *, errors = '' AND NOT COALESCE(t_meals = t_veg + t_non_veg, false) AS sum_error FROM checked),
verdicts AS (
  SELECT batch, count(*) AS rows,
         count(*) FILTER (WHERE errors <> '') AS value_error_rows,
         count(*) FILTER (WHERE sum_error) AS sum_error_rows,
         CASE WHEN count(*) FILTER (WHERE errors <> '') > 0 THEN 'invalid_values'
              WHEN count(*) FILTER (WHERE sum_error) > 0 THEN 'sum_mismatch' ELSE 'ok' END AS status,
         CASE WHEN count(*) FILTER (WHERE errors <> '') = 0 AND count(*) FILTER (WHERE sum_error) > 0
              THEN min(ordinal) FILTER (WHERE sum_error) END AS first_bad_row,
         CASE WHEN count(*) FILTER (WHERE errors <> '') = 0 AND count(*) FILTER (WHERE sum_error) = 0
              THEN count(*) ELSE 0 END AS published_rows
  FROM checked2 GROUP BY batch)"""


def _sql(body: str) -> str:
    return f"\n, {IMPORT_SQL.strip()}\n{body}"


@register("val_columns", _sql("""
SELECT batch, date, actual_meals, actual_meals_veg, actual_meals_non_veg, actual_meals_salad FROM import_rows"""))
def val_columns(spark, sf):
    """VAL-1: header aliases resolved (Datum, Gesamt, Veg, Non-Veg, SALAT)."""
    return resolved(spark, sf)


@register("val_values", _sql("""
SELECT batch, ordinal, date AS raw_date, errors FROM checked WHERE errors <> ''"""))
def val_values(spark, sf):
    """VAL-2 / WIN-2: rows with invalid values, their in-file position and
    the offending columns."""
    c = checked(spark, sf)
    return c.filter(F.size("value_errors") > 0).select(
        "batch", "ordinal", "raw_date", F.array_join("value_errors", ",").alias("errors"))


@register("val_sum", _sql("""
SELECT batch, ordinal, t_date AS date, t_meals AS actual_meals, t_veg AS actual_meals_veg,
       t_non_veg AS actual_meals_non_veg
FROM checked2 WHERE sum_error"""))
def val_sum(spark, sf):
    """VAL-3 / VAL-4: valid rows whose total is not veg + non-veg."""
    c = checked(spark, sf)
    return c.filter("sum_error").select("batch", "ordinal", "date", "actual_meals", "actual_meals_veg",
                                        "actual_meals_non_veg")


@register("val_manual", _sql("""
SELECT t_date AS date, t_meals AS actual_meals, t_veg AS actual_meals_veg, t_non_veg AS actual_meals_non_veg
FROM checked WHERE t_meals <> t_veg + t_non_veg"""))
def val_manual(spark, sf):
    """VAL-5: entry-grid check; rows with a null part are not mismatches."""
    t = V.typed(resolved(spark, sf))
    return V.manual_mismatches(t).select("date", "actual_meals", "actual_meals_veg", "actual_meals_non_veg")


@register("val_batch", _sql("SELECT * FROM verdicts"))
def val_batch(spark, sf):
    """VAL-6: one verdict per monthly file, short-circuit order, all or nothing."""
    return V.validate_batches(checked(spark, sf))


@register("flow_import", _sql("""
, good AS (SELECT c.t_date AS date, c.t_meals AS actual_meals, c.t_veg AS actual_meals_veg,
                  c.t_non_veg AS actual_meals_non_veg, c.t_salad AS actual_meals_salad
           FROM checked2 c JOIN verdicts v ON c.batch = v.batch WHERE v.status = 'ok'
           QUALIFY row_number() OVER (PARTITION BY c.t_date ORDER BY c.batch DESC, c.ordinal DESC) = 1),
db AS (SELECT * FROM actual_sales WHERE day(date) > 7 AND date NOT IN (SELECT date FROM good)
       UNION ALL SELECT * FROM good)
SELECT p.date, p.final_prediction, p.day_theme, p.predicted_meals_veg, p.predicted_meals_non_veg,
       p.predicted_meals_salad, CAST(NULL AS BIGINT) AS actual_meals, CAST(NULL AS BIGINT) AS actual_meals_veg,
       CAST(NULL AS BIGINT) AS actual_meals_non_veg, CAST(NULL AS DOUBLE) AS actual_meals_salad
FROM predictions p WHERE p.date NOT IN (SELECT date FROM db)"""))
def flow_import(spark, sf):
    """FLOW-3: monthly files -> resolve -> validate -> upsert the files that
    pass (all or nothing per file) into a table lacking each month's first
    week -> the refreshed list of days still missing actuals."""
    a = fx.actual_sales(spark, sf)
    rows = checked(spark, sf)
    verdicts = V.validate_batches(rows)
    good = V.good_rows(rows, verdicts).select("date", *V.VALUE_COLUMNS, F.struct("batch", "ordinal").alias("_order"))
    db = UP.upsert(a.filter(F.dayofmonth("date") > 7), good, ["date"], order_col="_order")
    return missing_actuals(fx.predictions(spark, sf, a), db)


@register("val_import_upsert", _sql("""
SELECT c.t_date AS date, c.t_meals AS actual_meals, c.t_veg AS actual_meals_veg,
       c.t_non_veg AS actual_meals_non_veg, c.t_salad AS actual_meals_salad
FROM checked2 c JOIN verdicts v ON c.batch = v.batch WHERE v.status = 'ok'
QUALIFY row_number() OVER (PARTITION BY c.t_date ORDER BY c.batch DESC, c.ordinal DESC) = 1"""))
def val_import_upsert(spark, sf):
    """SNK-2 / WIN-4: the days of all good files; of a day that comes twice,
    in one file or in two, the last row counts even when it is lower."""
    rows = checked(spark, sf)
    good = V.good_rows(rows, V.validate_batches(rows)).select(
        "date", *V.VALUE_COLUMNS, F.struct("batch", "ordinal").alias("_order"))
    return UP.last_wins(good, ["date"], "_order").drop("_order")


@register("val_bad_rows", _sql("""
SELECT batch, ordinal, date, actual_meals, actual_meals_veg, actual_meals_non_veg, actual_meals_salad,
       CASE WHEN sum_error THEN 'sum' ELSE errors END AS errors
FROM (SELECT c.batch, c.ordinal, c.sum_error, c.errors, CAST(c.t_date AS VARCHAR) AS date, CAST(c.t_meals AS VARCHAR) AS actual_meals,
             CAST(c.t_veg AS VARCHAR) AS actual_meals_veg, CAST(c.t_non_veg AS VARCHAR) AS actual_meals_non_veg,
             c.t_salad AS actual_meals_salad FROM checked2 c) x
WHERE sum_error OR errors <> ''"""))
def val_bad_rows(spark, sf):
    """VAL-4: every offending row of every file with its errors."""
    from platewise.streaming.ingest import bad_rows
    return bad_rows(checked(spark, sf)).withColumn("actual_meals_salad", F.col("actual_meals_salad").cast("double"))


@register("prj_auto_total", f"""
, {EDITS_SQL.strip()}
SELECT e.date,
       CASE WHEN e.actual_meals_veg IS DISTINCT FROM a.actual_meals_veg
              OR e.actual_meals_non_veg IS DISTINCT FROM a.actual_meals_non_veg
            THEN COALESCE(e.actual_meals_veg, 0) + COALESCE(e.actual_meals_non_veg, 0)
            ELSE e.actual_meals END AS actual_meals,
       e.actual_meals_veg, e.actual_meals_non_veg, e.actual_meals_salad
FROM edits e LEFT JOIN actual_sales a ON e.date = a.date""")
def prj_auto_total(spark, sf):
    """PRJ-12: totals follow edited veg / non-veg cells."""
    return V.auto_total(edits(spark, sf), fx.actual_sales(spark, sf))


@register("jon_changed_rows", f"""
, {EDITS_SQL.strip()}
SELECT e.* FROM edits e LEFT JOIN actual_sales a ON e.date = a.date
WHERE e.actual_meals IS DISTINCT FROM a.actual_meals OR e.actual_meals_veg IS DISTINCT FROM a.actual_meals_veg
   OR e.actual_meals_non_veg IS DISTINCT FROM a.actual_meals_non_veg
   OR e.actual_meals_salad IS DISTINCT FROM a.actual_meals_salad""")
def jon_changed_rows(spark, sf):
    """JON-7: edited rows that differ from the stored ones (null = null)."""
    return V.changed_rows(edits(spark, sf), fx.actual_sales(spark, sf))


@register("flow_manual", f"""
, {EDITS_SQL.strip()},
fixed AS (
  SELECT e.date,
         CASE WHEN e.actual_meals_veg IS DISTINCT FROM a.actual_meals_veg
                OR e.actual_meals_non_veg IS DISTINCT FROM a.actual_meals_non_veg
              THEN COALESCE(e.actual_meals_veg, 0) + COALESCE(e.actual_meals_non_veg, 0)
              ELSE e.actual_meals END AS actual_meals,
         e.actual_meals_veg, e.actual_meals_non_veg, e.actual_meals_salad
  FROM edits e LEFT JOIN actual_sales a ON e.date = a.date),
changed AS (
  SELECT f.* FROM fixed f LEFT JOIN actual_sales a ON f.date = a.date
  WHERE f.actual_meals IS DISTINCT FROM a.actual_meals OR f.actual_meals_veg IS DISTINCT FROM a.actual_meals_veg
     OR f.actual_meals_non_veg IS DISTINCT FROM a.actual_meals_non_veg
     OR f.actual_meals_salad IS DISTINCT FROM a.actual_meals_salad)
SELECT * FROM actual_sales WHERE date NOT IN (SELECT date FROM changed)
UNION ALL SELECT * FROM changed""")
def flow_manual(spark, sf):
    """FLOW-4 / AGG-16: auto total -> mismatch check -> changed rows only -> upsert.

    The mismatch check is a ``limit(1)`` probe; a mismatch aborts the save
    (nothing is written), as in the entry grid.
    """
    original = fx.actual_sales(spark, sf)
    fixed = V.auto_total(edits(spark, sf), original)
    if V.manual_mismatches(fixed).limit(1).count() > 0:
        raise ValueError("actual_meals must equal veg + non-veg")
    return UP.upsert(original, V.changed_rows(fixed, original), ["date"])
