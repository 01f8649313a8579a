"""Helpers the operators of this subpackage share: tables in the shared
folder, joins whose small side is checked before it is broadcast, and the
filter that makes per-row decisions take effect on documents."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.session import scratch_dir

#: A side of a join is broadcast only when its counted rows are at most this
#: many (rows of a few dozen bytes: some 20 MB); beyond it the join shuffles.
BROADCAST_ROWS = 300_000
#: Rows of whole texts that go to a Python worker at a time, a few MB; the
#: copies of a batch that the executor and its workers hold are all bounded so.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder named by
    ``spark.checkpoint.dir`` and read it back: the lineage is cut and a lost
    executor costs a re-read only."""
    path = scratch_dir(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile hands its Python workers ``ARROW_ROWS`` rows
    at a time (or fewer, if the session says so)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) < ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def sized_join(big: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """``big`` joined with ``small``; ``small`` (a written table: counting it
    is cheap) is broadcast while its row count is bounded, else both sides
    shuffle and adaptive execution splits skewed keys."""
    if small.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return big.join(small, on, how)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def row_key(col: str = "text"):
    """64-bit hash of the text; (doc_id, row_key) tells rows that share a
    doc_id apart."""
    return F.xxhash64(text_or_empty(col))


def helper_names(*names: str) -> list[str]:
    """Column names that no table of a user has, one for each of ``names``."""
    mark = uuid.uuid4().hex
    return [f"_{n}_{mark}" for n in names]


def keep_decided(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose decision is ``kept``.

    ``decisions`` has one row (doc_id, row_key, kept, once) per row of
    ``docs``; null doc_ids compare as equal. Rows that repeat both doc_id and
    text stay when any of them is kept: one of them where ``once`` holds, else
    all. The text is shuffled only when the lists of dropped or repeated keys
    are too large to broadcast."""
    id_, key, own = helper_names("id", "key", "own")
    keys = materialise(
        decisions.groupBy("doc_id", "row_key")
        .agg(F.max("kept").alias("kept"), F.max("once").alias("once"), F.count(F.lit(1)).alias("n"))
        .filter(~F.col("kept") | (F.col("once") & (F.col("n") > 1)))
        .select(F.col("doc_id").alias(id_), F.col("row_key").alias(key), "kept"), "decided")
    dropped, repeated = (keys.filter(x).drop("kept") for x in (~F.col("kept"), F.col("kept")))
    rows = docs.withColumn(own, row_key())
    match = [F.col("doc_id").eqNullSafe(F.col(id_)), F.col(own) == F.col(key)]

    def against(side: DataFrame, small: DataFrame, how: str) -> DataFrame:
        return side.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, match, how)

    out = against(rows, dropped, "left_anti")
    if not repeated.isEmpty():
        once = against(out, repeated, "left_semi").dropDuplicates(["doc_id", own])
        out = against(out, repeated, "left_anti").unionByName(once)
    return out.drop(own)


def slices(batches: Iterator[pa.RecordBatch], text_col: str = "text",
           max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The record batches cut so that the texts of one piece hold at most
    ``max_bytes`` (a single longer text makes a piece of its own)."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(b.column(text_col)), 0).to_numpy(zero_copy_only=False)
        start = used = 0
        for i, n in enumerate(sizes):
            if used + n > max_bytes and i > start:
                yield b.slice(start, i - start)
                start, used = i, 0
            used += int(n)
        yield b.slice(start)
    give_back()


def give_back() -> None:
    """At the end of a task: freed memory goes back to the system, so that a
    worker that waits for its next task keeps none of this one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not the GNU library
        pass
