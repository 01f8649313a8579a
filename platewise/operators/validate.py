"""Validation of imported and hand-edited actuals (VAL-1...6, WIN-2,
PRJ-12, JON-7).

Every check is a column expression evaluated inside the scan's tasks; the
batch verdict is a grouped aggregate (one row per uploaded file / batch),
so nothing but verdicts and offending rows ever leaves the executors.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from platewise.constants import IMPORT_ALIASES

VALUE_COLUMNS = ["actual_meals", "actual_meals_veg", "actual_meals_non_veg", "actual_meals_salad"]
CHECK_COLUMNS = ["actual_meals", "actual_meals_veg", "actual_meals_non_veg", "actual_meals_salad"]


class ColumnError(ValueError):
    """Required columns missing (or ambiguous) in an import file."""


def resolve_columns(df: DataFrame, aliases: dict[str, list[str]] = IMPORT_ALIASES,
                    keep: Sequence[str] = ()) -> DataFrame:
    """VAL-1 / PRJ-10: rename accepted headers (any case) to internal names,
    keep the five columns in order (plus ``keep``). Metadata only: no Spark job.

    Raises ``ColumnError`` listing every missing column, or naming both
    headers when two aliases of one column are present (Q5).
    """
    # repeated headers arrive renamed ``<name>__dup<n>`` (Spark refuses
    # duplicate column names); any repeat is an error for the whole file
    lowered = [re.sub(r"__dup\d+$", "", c.lower()) for c in df.columns]
    dupes = sorted({c for c in lowered if lowered.count(c) > 1})
    if dupes:
        raise ColumnError("duplicate columns: " + ", ".join(dupes))
    lower = {c.lower(): c for c in df.columns}
    chosen, missing = {}, []
    for internal, accepted in aliases.items():
        hits = [lower[a] for a in accepted if a in lower]
        if not hits:
            missing.append(internal)
        elif len(hits) > 1:
            raise ColumnError(f"ambiguous columns for {internal}: {', '.join(hits)}")
        else:
            chosen[internal] = hits[0]
    if missing:
        raise ColumnError("missing columns: " + ", ".join(missing))
    return df.select(*keep, *[F.col(f"`{src}`").alias(internal) for internal, src in chosen.items()])


def _positions(df: DataFrame) -> DataFrame:
    """Partition id and in-partition position of every row, materialised
    once (reliable checkpoint in the shared folder), so that every later use
    sees the same partitioning: recomputing a shuffle under adaptive
    execution may coalesce or split its partitions differently."""
    from platewise.session import cut_lineage
    x = df.select("*", F.spark_partition_id().alias("_pid"),
                  (F.monotonically_increasing_id()
                   - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)).alias("_pos"))
    return cut_lineage(x)


def with_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """WIN-2: dense 0-based row position in partition order (file order for a
    file scan, sort order after ``orderBy``).

    Per-partition counts (one number per partition comes to the driver) are
    summed into offsets and joined back; no window or sort holds rows.
    """
    x = _positions(df)
    counts = sorted(x.groupBy("_pid").agg(F.count(F.lit(1))).collect())
    before = accumulate([0, *[n for _, n in counts]])
    offsets = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before)], "_pid int, _off bigint")
    return x.join(offsets, "_pid").withColumn(name, F.col("_off") + F.col("_pos")).drop("_pid", "_pos", "_off")


ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


def _whole_number(c: Column) -> Column:
    """Text that is an integer, or an integral float such as ``12.0`` (Q7).

    Plain integers take one cast; only other text goes down the double path
    (bround keeps doubles, so no bigint overflow; the last test rejects
    values outside the bigint range and infinities).
    """
    d = c.try_cast("double")
    as_double = d.isNotNull() & ~F.isnan(d) & (d == F.bround(d, 0)) & d.try_cast("bigint").isNotNull()
    return F.when(c.try_cast("bigint").isNotNull(), F.lit(True)).otherwise(as_double)


def value_errors(df: DataFrame, salad_integer: bool = True, keys: Sequence[str] = ()) -> Column:
    """VAL-2: ``array<string>`` of problems in one row (empty when valid).
    ``keys`` besides the date (a site) must be whole numbers.

    date: ISO ``yyyy-MM-dd`` shape and a real calendar day (a bare cast would
    accept ``2026`` or ``2026-6-3``); counts: present and whole numbers;
    salad: whole number by default, any number with ``salad_integer=False``.
    """
    d = F.trim(F.col("date").cast("string"))
    # text already shaped yyyy-MM-dd only needs the calendar check, which the
    # built-in date cast does without a pattern formatter
    checks = [F.when(~F.coalesce(d.rlike(ISO_DATE) & d.try_cast("date").isNotNull(),
                                 F.lit(False)), F.lit("date"))]
    for c in VALUE_COLUMNS:
        v = F.trim(F.col(c).cast("string"))
        if c == "actual_meals_salad" and not salad_integer:
            ok = v.try_cast("double").isNotNull()
        else:
            ok = _whole_number(v)
        checks.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(c)))
    for k in keys:
        if k != "date":
            checks.append(F.when(F.trim(F.col(k).cast("string")).try_cast("int").isNull(), F.lit(k)))
    return F.array_compact(F.array(*checks))


def typed(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cast validated text to the table types (date, bigint x3, double; other
    ``keys`` to int)."""
    d = F.trim(F.col("date").cast("string"))
    out = {k: F.trim(F.col(k).cast("string")).try_cast("int") for k in keys if k != "date"}
    out["date"] = F.when(d.rlike(ISO_DATE), d.try_cast("date"))
    for c in VALUE_COLUMNS:
        t = F.trim(F.col(c).cast("string"))
        out[c] = t.try_cast("double") if c == "actual_meals_salad" else \
            F.coalesce(t.try_cast("bigint"), t.try_cast("double").try_cast("bigint"))
    return df.withColumns(out)


def sum_ok(meals="actual_meals", veg="actual_meals_veg", non_veg="actual_meals_non_veg") -> Column:
    """VAL-3: ``meals == veg + non_veg``; a null anywhere is a mismatch."""
    return F.coalesce(F.col(meals) == F.col(veg) + F.col(non_veg), F.lit(False))


def sum_mismatches(df: DataFrame) -> DataFrame:
    """VAL-3 / VAL-4: offending rows (with their ordinal when present)."""
    return df.filter(~sum_ok())


def manual_mismatches(df: DataFrame) -> DataFrame:
    """VAL-5: hand-edited rows whose total differs from veg + non-veg; a null
    comparison is *not* a mismatch (SQL three-valued logic). AGG-16 (any
    mismatch?) is ``manual_mismatches(df).limit(1).count() > 0``."""
    return df.filter(F.col("actual_meals") != F.col("actual_meals_veg") + F.col("actual_meals_non_veg"))


def validate_rows(df: DataFrame, salad_integer: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """VAL-2 + VAL-3 per row: adds ``value_errors``, ``sum_error`` and the
    typed columns. ``sum_error`` is only meaningful when values are valid."""
    x = df.withColumn("value_errors", value_errors(df, salad_integer, keys))
    x = typed(x, keys)
    return x.withColumn("sum_error", (F.size("value_errors") == 0) & ~sum_ok())


def validate_batches(rows: DataFrame, batch_col: str = "batch") -> DataFrame:
    """VAL-6: one verdict per batch with the ordered short circuit
    columns -> values -> sum. A batch with a value error reports
    ``invalid_values`` (its sums are not checked); otherwise any sum
    mismatch gives ``sum_mismatch`` with the first offending ordinal; else
    ``ok``. All or nothing: ``published_rows`` is the row count only for
    ``ok``. The verdict is a fixed-size summary per batch; the complete list
    of offending rows is ``sum_mismatches`` (a DataFrame, never collected).
    """
    bad_vals = F.size("value_errors") > 0
    g = rows.groupBy(batch_col).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(bad_vals).alias("value_error_rows"),
        F.count_if(F.col("sum_error")).alias("sum_error_rows"),
        F.min(F.when(F.col("sum_error"), F.col("ordinal"))).alias("_first_bad"),
    )
    status = (F.when(F.col("value_error_rows") > 0, F.lit("invalid_values"))
               .when(F.col("sum_error_rows") > 0, F.lit("sum_mismatch"))
               .otherwise(F.lit("ok")))
    return g.select(
        batch_col, "rows", "value_error_rows", "sum_error_rows", status.alias("status"),
        F.when(status == "sum_mismatch", F.col("_first_bad")).alias("first_bad_row"),
        F.when(status == "ok", F.col("rows")).otherwise(F.lit(0)).alias("published_rows"),
    )


def good_rows(rows: DataFrame, verdicts: DataFrame, batch_col: str = "batch") -> DataFrame:
    """Rows of the batches that passed (all-or-nothing publish)."""
    ok = verdicts.filter(F.col("status") == "ok").select(batch_col)
    return rows.join(ok, batch_col, "left_semi")


def auto_total(edited: DataFrame, original: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    """PRJ-12: where veg or non-veg was edited, total := veg + non_veg
    (nulls count as 0); other rows keep their total."""
    keys = list(keys)
    o = original.select(*keys, F.col("actual_meals_veg").alias("_ov"), F.col("actual_meals_non_veg").alias("_onv"))
    j = edited.join(o, keys, "left")
    touched = ~F.col("actual_meals_veg").eqNullSafe(F.col("_ov")) | \
              ~F.col("actual_meals_non_veg").eqNullSafe(F.col("_onv"))
    total = F.coalesce(F.col("actual_meals_veg"), F.lit(0)) + F.coalesce(F.col("actual_meals_non_veg"), F.lit(0))
    return j.withColumn("actual_meals", F.when(touched, total.cast("bigint")).otherwise(F.col("actual_meals"))) \
            .drop("_ov", "_onv")


def changed_rows(edited: DataFrame, original: DataFrame, keys: Sequence[str] = ("date",),
                 columns: Sequence[str] = CHECK_COLUMNS) -> DataFrame:
    """JON-7: edited rows that differ from the original in any column, null
    equal to null (by key, not by position: Q8)."""
    keys = list(keys)
    o = original.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in columns])
    j = edited.join(o, keys, "left")
    diff = None
    for c in columns:
        d = ~F.col(c).eqNullSafe(F.col(f"_o_{c}"))
        diff = d if diff is None else diff | d
    return j.filter(diff).select(*keys, *columns)



def ordinal_within(df: DataFrame, batch_col: str, order_cols: Sequence[str], name: str = "ordinal") -> DataFrame:
    """WIN-2 per batch: 0-based position of each row inside its batch (file)
    in ``order_cols`` order.

    After a distributed range sort on (batch, order) a batch's rows are
    contiguous inside each partition. Per (partition, batch) counts and first
    positions form a small frame (partitions x batches); a running sum over
    the partitions of each batch gives the rows that precede in earlier
    partitions. No window ever holds a batch's rows, so a batch with a third
    of all rows still spreads over the cluster. Positions are materialised
    once (``_positions``) so both uses agree on the partitioning.
    """
    x = _positions(df.orderBy(batch_col, *order_cols))
    parts = x.groupBy("_pid", batch_col).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    w = Window.partitionBy(batch_col).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_pid", batch_col, "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (x.join(parts, ["_pid", batch_col])
             .withColumn(name, F.col("_off") + F.col("_pos") - F.col("_first"))
             .drop("_pid", "_pos", "_first", "_off"))
