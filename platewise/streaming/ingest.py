"""AIM-2: incremental actuals ingest.

New CSV files landing in a folder are discovered by a Structured Streaming
file source (exactly once, tracked in the checkpoint); each micro-batch is
validated per file (VAL-1...6, all or nothing per file) and the passing
files are upserted (SNK-2) into the actuals table as a new published
version. Failed files are appended to a quarantine table with their
verdict. A micro-batch that dies midway leaves the previous version
published; the checkpoint replays it and the upsert is idempotent.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.operators import validate as V
from platewise.sinks.tables import upsert_into
from platewise.sources.files import POSITION, file_ordinals, read_csv_files


def validate_files(spark: SparkSession, paths: list[str], keys: Sequence[str] = ("date",)) -> tuple[DataFrame, DataFrame]:
    """Rows (with ``batch`` = file) and per-file verdicts for a set of files.

    Of each file its head is read, then its rows once: they are written
    (checkpointed) with their place in their split, and positions, verdicts
    and the upsert read that. Keys besides the date (a site) are columns of
    the file or, where it has none of that name, stand in its folder's name
    (``site_id=7``); a row without one is an invalid value.

    Files whose headers lack a required column (or repeat one) get a
    ``missing_columns`` (``duplicate_columns``) verdict without a value
    check, the ordered short circuit; files without a header line get
    ``unreadable``."""
    rows, bad_cols = None, []
    unreadable: list[str] = []
    others = [k for k in keys if k != "date"]
    for header, df in read_csv_files(spark, paths, unreadable, position=True):
        lower = {c.lower(): c for c in df.columns}
        for k in others:
            folder = F.regexp_extract("_file", rf"/{re.escape(k)}=([^/]+)/", 1)
            df = df.withColumnRenamed(lower[k.lower()], k) if k.lower() in lower else df.withColumn(k, folder)
        try:
            r = V.resolve_columns(df, keep=[*POSITION, *others])
        except V.ColumnError as e:
            status = "duplicate_columns" if str(e).startswith("duplicate") else "missing_columns"
            files = df.select("_file").distinct()
            bad_cols.append(files.select(F.col("_file").alias("batch"), F.lit(status).alias("status"),
                                         F.lit(str(e)).alias("message")))
            continue
        rows = r if rows is None else rows.unionByName(r)
    if unreadable:
        bad_cols.append(spark.createDataFrame([(p, "unreadable", "empty or unreadable file") for p in unreadable],
                                              "batch string, status string, message string"))
    verdicts = None
    if rows is not None:
        from platewise.session import cut_lineage
        rows = cut_lineage(V.validate_rows(rows, keys=others))  # the one scan of the files
        rows = file_ordinals(rows, few=True).withColumnRenamed("_file", "batch")  # bounded by the files of one step
        verdicts = V.validate_batches(rows).withColumn("message", F.lit(None).cast("string"))
    for b in bad_cols:
        v = b.select("batch", F.lit(0).cast("bigint").alias("rows"), F.lit(0).cast("bigint").alias("value_error_rows"),
                     F.lit(0).cast("bigint").alias("sum_error_rows"), "status",
                     F.lit(None).cast("bigint").alias("first_bad_row"), F.lit(0).cast("bigint").alias("published_rows"),
                     "message")
        verdicts = v if verdicts is None else verdicts.unionByName(v)
    return rows, verdicts


#: Which of a day's rows is the last: the file written last, files written
#: together by name, and in a file the row further down.
UPLOAD_ORDER = ("_file_time", "batch", "ordinal")


def bad_rows(rows: DataFrame) -> DataFrame:
    """VAL-4: every offending row of the files, with its file, position, text
    and errors (``sum`` where the total is not veg + non-veg)."""
    errors = F.when(F.col("sum_error"), F.array(F.lit("sum"))).otherwise(F.col("value_errors"))
    return rows.filter(F.size(errors) > 0).select(
        "batch", "ordinal", F.col("date").cast("string").alias("date"),
        *[F.col(c).cast("string").alias(c) for c in V.VALUE_COLUMNS], F.array_join(errors, ",").alias("errors"))


def ingest_paths(spark: SparkSession, paths: list[str], table_root: str, quarantine_root: str,
                 keys: Sequence[str] = ("date",), epoch_id: int | None = None,
                 keep_versions: int = 10) -> tuple[bool, str | None]:
    """One ingest step (batch or micro-batch): validate, upsert good files,
    publish a new table version, record rejected files (their verdicts, and
    in the folder ``<quarantine>_rows`` all offending rows). Of a day that comes twice the
    last row counts (``UPLOAD_ORDER``).

    Both writes are idempotent for a replayed micro-batch: the upsert of the
    same files gives the same table, and rejected files go to the epoch's own
    quarantine folder, overwritten on replay. The table's newest
    ``keep_versions`` versions stay.
    """
    rows, verdicts = validate_files(spark, paths, keys)
    if verdicts is None:
        return True, None
    verdicts = verdicts.cache()  # read twice: good-file join and quarantine write
    try:
        if rows is not None:
            good = V.good_rows(rows, verdicts).select(*keys, *V.VALUE_COLUMNS, F.struct(*UPLOAD_ORDER).alias("_order"))
            ok, err = upsert_into(spark, table_root, good, keys, order_col="_order", keep=keep_versions)
            if not ok:
                return False, err
        rejected = verdicts.filter(F.col("status") != "ok")
        if epoch_id is None:
            rejected.write.mode("append").parquet(quarantine_root)
        else:
            rejected.write.mode("overwrite").parquet(os.path.join(quarantine_root, f"epoch={epoch_id}"))
        if rows is not None:
            bad = bad_rows(rows).write.mode("append" if epoch_id is None else "overwrite")
            bad.parquet(quarantine_root.rstrip("/") + "_rows" + ("" if epoch_id is None else f"/epoch={epoch_id}"))
        return True, None
    finally:
        verdicts.unpersist()


def start_ingest(spark: SparkSession, landing: str, table_root: str, quarantine_root: str,
                 checkpoint: str, max_files_per_trigger: int = 1000, available_now: bool = True,
                 keys: Sequence[str] = ("date",)):
    """Start the streaming ingest; ``available_now`` processes everything that
    has landed and stops (scheduled runs), otherwise it keeps running. The
    stream brings the files' paths alone: it reads none of their bytes."""
    files = (spark.readStream.format("binaryFile")
             .schema("path string, modificationTime timestamp, length bigint, content binary")
             .option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.[cC][sS][vV]")
             .option("maxFilesPerTrigger", max_files_per_trigger)
             .load(landing).select("path"))

    def process(batch: DataFrame, epoch_id: int) -> None:
        paths = [r[0] for r in batch.select("path").distinct().collect()]  # bounded by maxFilesPerTrigger
        if paths:
            ok, err = ingest_paths(batch.sparkSession, paths, table_root, quarantine_root, keys, epoch_id=epoch_id)
            if not ok:
                raise RuntimeError(f"ingest of epoch {epoch_id} failed: {err}")

    w = files.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def landing_layout(root: str) -> dict[str, str]:
    return {k: os.path.join(root, k) for k in ("landing", "table", "quarantine", "checkpoint")}
