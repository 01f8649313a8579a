"""Keyed writes as DataFrame plans (WIN-4, SNK-1, SNK-2, SNK-3, SNK-5, SNK-11).

A parquet table supports neither MERGE nor DELETE, so an upsert is the new
table version ``target ▷ updates ∪ updates`` (left-anti on the keys, then a
union), written to a new version directory by ``platewise.sinks.tables``.

Scale notes: duplicate keys in one batch are resolved with ``max_by``, a
partial (map-side) aggregate, so even a key repeated in a third of the batch
collapses to one row per task before the shuffle. The anti-join only needs
the update *keys*; with a small batch AQE turns it into a broadcast and the
target is never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def last_wins(updates: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """WIN-4: one row per key, the one with the greatest ``order_col``."""
    keys = list(keys)
    rest = [c for c in updates.columns if c not in keys]
    g = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order_col)).alias("_row"))
    return g.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def one_per_key(updates: DataFrame, keys: Sequence[str], order_col: str | None = None,
                count: str | None = None) -> DataFrame:
    """One row per key: the last by ``order_col`` (which is dropped), without
    it the greatest; ``count`` names a column for the rows that a key had."""
    rest = [c for c in updates.columns if c not in keys and c != order_col]
    row = F.struct(*rest)
    g = updates.groupBy(*keys).agg((F.max_by(row, F.col(order_col)) if order_col else F.max(row)).alias("_row"),
                                   F.count(F.lit(1)).alias("_n"))
    return g.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest], *([F.col("_n").alias(count)] if count else []))


def aligned(rows: DataFrame, schema: T.StructType, besides: Sequence[str] = ()) -> DataFrame:
    """``rows`` by name and type as ``schema`` has them, NaN as null; columns
    it lacks become null, columns the schema lacks are an error, but for those
    named ``besides``, which stay at the end."""
    extra = [c for c in rows.columns if c not in schema.names and c not in besides]
    if extra:
        raise ValueError(f"columns not in target: {extra}")
    rows = nan_to_null(rows)
    return rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns
                         else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields], *besides)


def repeated_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that a batch holds more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")


def nan_to_null(df: DataFrame) -> DataFrame:
    """SNK-11: NaN doubles become nulls before a write."""
    cols = {f.name: F.when(~F.isnan(f.name), F.col(f.name))
            for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(cols) if cols else df


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str] = ("date",),
           order_col: str | None = None) -> DataFrame:
    """SNK-1: insert new keys; on a key conflict replace every non-key column.

    ``order_col`` (an input ordinal, or a struct of file time, file and
    ordinal) resolves duplicate keys inside the batch, last one winning (Q14).
    Without it a batch carries no order: callers that take rows from users
    pass one or refuse repeated keys (``repeated_keys``), and what is left
    resolves deterministically to the greatest row, so the table never holds a
    key twice. Columns are aligned by name to the
    target; update columns missing from the target are an error, target
    columns missing from the updates become null.
    """
    keys = list(keys)
    u = aligned(one_per_key(updates, keys, order_col), target.schema)
    kept = target.join(u.select(*keys), keys, "left_anti")
    return kept.unionByName(u)


def append(target: DataFrame, rows: DataFrame) -> DataFrame:
    """SNK-3: append rows (no key check), aligned by name."""
    return target.unionByName(rows, allowMissingColumns=True)


def delete_keys(target: DataFrame, doomed: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    """SNK-5: the table without the rows whose keys appear in ``doomed``."""
    keys = list(keys)
    return target.join(doomed.select(*keys), keys, "left_anti")  # anti-joins never fan out
