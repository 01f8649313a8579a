"""Queries: file sources and the incremental ingest (SRC-1, SRC-2, SRC-3,
AIM-2). Each writes files that Spark derives from the test tables into a
fresh folder under the shared checkpoint folder, then reads them back with
the source operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise import fixtures as fx
from platewise.operators import validate as V
from platewise.plans.catalog import register
from platewise.plans.q_import import IMPORT_SQL, uploaded, write_import_files
from platewise.session import scratch_dir
from platewise.sinks.tables import publish, read_table, upsert_into
from platewise.sources import files as SRC
from platewise.streaming.ingest import landing_layout, start_ingest

@register("src_holidays", "SELECT * FROM holidays")
def src_holidays(spark, sf):
    """SRC-1: the holiday table written as CSV (TRUE / FALSE flags, columns in
    another order, one more, quoted header) and read back by name."""
    path = scratch_dir(spark, "holidays")
    h = fx.holidays(spark, sf)
    h.select(F.lit("seed").alias("origin"),
             *[F.upper(F.col(c).cast("string")).alias(c) for c in ("is_bridge_day", "is_bank_holiday",
                                                                    "is_school_break")],
             "description", F.date_format("date", "yyyy-MM-dd").alias("date")) \
     .write.option("header", True).option("quoteAll", True).csv(path)
    return SRC.read_holidays(spark, path)


@register("src_sales", """
SELECT date, actual_meals AS total_meals, actual_meals_veg AS veg, actual_meals_non_veg AS non_veg
FROM actual_sales""")
def src_sales(spark, sf):
    """SRC-2: history as ``;`` CSV with ``m/d/yy`` dates without leading zeros,
    columns in another order and one more, read back by name (1995-1999 dates
    keep their century)."""
    path = scratch_dir(spark, "sales")
    a = fx.actual_sales(spark, sf)
    a.select(F.col("actual_meals_veg").alias("veg"), F.col("actual_meals_non_veg").alias("non_veg"),
             F.dayofweek("date").alias("weekday"), F.date_format("date", "M/d/yy").alias("date"),
             F.col("actual_meals").alias("total_day")) \
     .write.option("header", True).option("sep", ";").csv(path)
    return SRC.read_sales(spark, path)


@register("src_sniff", f"""
, {IMPORT_SQL.strip()}
SELECT batch, ordinal, date, actual_meals, actual_meals_veg, actual_meals_non_veg, actual_meals_salad
FROM checked""")
def src_sniff(spark, sf):
    """SRC-3 + VAL-1 + WIN-2: files of unknown separator and German headers,
    read in one scan per header variant, each row with its in-file position."""
    return uploaded(spark, sf).select("batch", "ordinal", "date", *V.VALUE_COLUMNS)


@register("src_sniff_quoted", """
SELECT date_part('year', date)::BIGINT AS year, strftime(date, '%Y-%m-%d') AS "Datum, Tag", CAST(actual_meals AS VARCHAR) AS "Gesamt",
       replace(CAST(actual_meals_salad AS VARCHAR), '.', ',') AS "Salat; kg"
FROM actual_sales
UNION ALL
SELECT date_part('year', date)::BIGINT, strftime(date, '%Y-%m-%d'), NULL, NULL FROM holidays""")
def src_sniff_quoted(spark, sf):
    """SRC-3: files whose quoted names and decimals hold other separators, and
    files of one column, read with the separator their lines agree on."""
    root = scratch_dir(spark, "quoted")
    a, h = fx.actual_sales(spark, sf), fx.holidays(spark, sf)
    day = F.date_format("date", "yyyy-MM-dd").alias("Datum, Tag")
    salad = F.replace(F.col("actual_meals_salad").cast("string"), F.lit("."), F.lit(",")).alias("Salat; kg")
    for kind, sep in (("semicolon", ";"), ("comma", ","), ("pipe", "|")):
        part = a.filter(F.year("date") % 3 == ["semicolon", "comma", "pipe"].index(kind))
        (part.select(F.year("date").alias("year"), day, F.col("actual_meals").alias("Gesamt"), salad)
         .repartition("year").write.partitionBy("year").option("header", True).option("sep", sep)
         .option("quoteAll", True).csv(f"{root}/{kind}"))
    h.select(F.year("date").alias("year"), day).repartition("year").write.partitionBy("year").option(
        "header", True).option("quoteAll", True).csv(f"{root}/one")
    out = None
    for kind in ("semicolon", "comma", "pipe", "one"):
        for _, df in SRC.read_csv_files(spark, f"{root}/{kind}"):
            year = F.regexp_extract("_file", r"year=([0-9]+)", 1).cast("bigint").alias("year")
            df = df.select(year, *[F.col(f"`{c}`") for c in df.columns if c not in ("_file", "_file_time", "ordinal")])
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


@register("aim_ingest", f"""
, {IMPORT_SQL.strip()},
good AS (SELECT c.t_date AS date, c.t_meals AS actual_meals, c.t_veg AS actual_meals_veg,
                c.t_non_veg AS actual_meals_non_veg, c.t_salad AS actual_meals_salad
         FROM checked2 c JOIN verdicts v ON c.batch = v.batch WHERE v.status = 'ok'
         QUALIFY row_number() OVER (PARTITION BY c.t_date  -- files are written by month modulo 3
                                    ORDER BY CAST(substr(c.batch, 6, 2) AS INTEGER) % 3 DESC, c.ordinal DESC) = 1)
SELECT * FROM actual_sales WHERE day(date) > 7 AND date NOT IN (SELECT date FROM good)
UNION ALL SELECT * FROM good""")
def aim_ingest(spark, sf):
    """AIM-2: monthly files land in a folder; a Structured Streaming job
    (availableNow) validates each file and upserts the ones that pass into
    the actuals table (which lacks every month's first week). Of a day that
    comes twice, the row further down or in the later file counts."""
    paths = landing_layout(scratch_dir(spark, "ingest"))
    write_import_files(spark, sf, paths["landing"])
    ok, err = publish(fx.actual_sales(spark, sf).filter(F.dayofmonth("date") > 7), paths["table"])
    if not ok:
        raise RuntimeError(err)
    q = start_ingest(spark, paths["landing"], paths["table"], paths["quarantine"], paths["checkpoint"])
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return read_table(spark, paths["table"])


@register("aim_ingest_sites", """
, bad AS (SELECT DISTINCT site_id FROM site_sales WHERE site_id % 7 = 3),
good AS (SELECT site_id, date, actual_meals + 1 AS actual_meals, actual_meals_veg + 1 AS actual_meals_veg,
                actual_meals_non_veg, floor(actual_meals_salad) AS actual_meals_salad
         FROM site_sales WHERE site_id NOT IN (SELECT site_id FROM bad) AND day(date) < 15)
SELECT site_id, date, actual_meals, actual_meals_veg, actual_meals_non_veg, actual_meals_salad
FROM site_sales s WHERE day(date) > 7 AND NOT EXISTS (SELECT 1 FROM good g WHERE g.site_id = s.site_id AND g.date = s.date)
UNION ALL SELECT * FROM good""")
def aim_ingest_sites(spark, sf):
    """AIM-2 / FLOW-3 by (site, date): every site's folder gets a file of each
    month's first two weeks, every third site's names its site in a column
    instead; a site's wrong total rejects its file. The rest is upserted into
    a table that lacks each month's first week."""
    paths = landing_layout(scratch_dir(spark, "ingest-sites"))
    s = fx.site_sales(spark, sf)
    files = s.filter(F.dayofmonth("date") < 15).select(
        "site_id", F.date_format("date", "yyyy-MM-dd").alias("Datum"), (F.col("actual_meals") + 1).alias("Gesamt"),
        (F.col("actual_meals_veg") + F.when(F.col("site_id") % 7 == 3, 2).otherwise(1)).alias("Veg"),
        F.col("actual_meals_non_veg").alias("Non-Veg"), F.floor("actual_meals_salad").alias("SALAT"))
    files.filter("site_id % 3 > 0").repartition("site_id").write.partitionBy("site_id").option("header", True).option(
        "sep", ";").csv(paths["landing"] + "/by_site")
    files.filter("site_id % 3 = 0").select(
        F.col("site_id").alias("k"), F.col("site_id").alias("SITE_ID"), "Datum", "Gesamt", "Veg", "Non-Veg", "SALAT").repartition(
        "k").write.partitionBy("k").option("header", True).csv(paths["landing"] + "/in_file")
    keys = ["site_id", "date"]
    ok, err = upsert_into(spark, paths["table"], s.filter(F.dayofmonth("date") > 7), keys)
    if not ok:
        raise RuntimeError(err)
    q = start_ingest(spark, paths["landing"], paths["table"], paths["quarantine"], paths["checkpoint"], keys=keys)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return read_table(spark, paths["table"])


@register("snk_overwrite", """
SELECT * FROM actual_sales
WHERE date NOT IN (SELECT date FROM holidays WHERE is_bank_holiday)""")
def snk_overwrite(spark, sf):
    """SNK-4 / SNK-12: publish the actuals table, then replace it wholesale
    (delete all, reload without bank holidays) as a new version; readers see
    the last complete version only."""
    from platewise.operators.upsert import delete_keys
    root = scratch_dir(spark, "overwrite")
    ok1, e1 = publish(fx.actual_sales(spark, sf), root)
    current = read_table(spark, root)
    ok2, e2 = publish(delete_keys(current, fx.holidays(spark, sf).filter("is_bank_holiday")), root)
    if not (ok1 and ok2):
        raise RuntimeError(e1 or e2)
    return read_table(spark, root)
