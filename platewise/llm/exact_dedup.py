"""Exact dedup by an exchange of Golomb-coded fingerprints.

Every partition sends the sorted 48-bit fingerprints of its texts, Golomb
coded, to the owner of their range; owners answer with one bit per
fingerprint (seen elsewhere too, or repeated in the partition); partitions
mark their suspects with it, and only suspects' texts are shuffled, to be
compared byte by byte. A unique text never leaves its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import keep_decided, materialise, slices, text_or_empty
from platewise.llm.golomb import golomb_decode, golomb_encode
from platewise.llm.mail import collected, post

#: Bits of a fingerprint. A false match only makes a suspect more to verify.
BITS = 48
#: Fingerprints one owner holds at a time, about.
PER_OWNER = 4_000_000
WHITE = r"[\x20\x09-\x0D]+"

_MARKED = "doc_id long, h long, text_sha256 string, row_key long, part int, pos long, text string"


def _fingerprints(h: np.ndarray, bits: int) -> np.ndarray:
    return (h.astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _send(owners: int, bits: int):
    """Per partition: (part, rows, owner, n, code, repeated); ``repeated``
    has a bit per fingerprint that the partition holds more than once."""
    span = -(-(1 << bits) // owners)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        got = [_fingerprints(f["h"].to_numpy(), bits) for f in frames]
        rows = sum(map(len, got))
        if not rows:
            return
        values, times = np.unique(np.concatenate(got), return_counts=True)
        cuts = np.searchsorted(values, np.arange(1, owners) * span)
        out = []
        for owner, (v, t) in enumerate(zip(np.split(values, cuts), np.split(times, cuts))):
            if len(v):
                out.append((part, rows, owner, len(v), golomb_encode(v - owner * span, span),
                            np.packbits(t > 1).tobytes()))
        yield pd.DataFrame(out, columns=["part", "n_rows", "owner", "n", "code", "repeated"])

    return send


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """An owner's reply: ``repeated`` becomes the bitmap of the fingerprints
    that occur more than once anywhere."""
    lists = [golomb_decode(c, n) for c, n in zip(group["code"], group["n"])]
    local = [np.unpackbits(np.frombuffer(r, np.uint8), count=n) for r, n in zip(group["repeated"], group["n"])]
    values = np.concatenate(lists)
    distinct, where = np.unique(values, return_inverse=True)
    times = np.bincount(where, weights=1 + np.concatenate(local), minlength=len(distinct))
    twice = times[where] > 1
    ends = np.cumsum([len(x) for x in lists])[:-1]
    lists = np.split(twice, ends)
    out = group.assign(repeated=[np.packbits(x).tobytes() for x in lists])
    return out[[bool(x.any()) for x in lists]]


def _mark(folder: str, owners: int, bits: int):
    """The rows with their place (part, pos); only suspects keep their text."""
    span = -(-(1 << bits) // owners)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = TaskContext.get().partitionId(), 0
        mail = collected(folder, part, ["n_rows", "owner", "n", "code", "repeated"])
        found, expected = [np.zeros(0, np.int64)], None
        for r in mail.to_pylist() if mail else ():
            again = np.unpackbits(np.frombuffer(r["repeated"], np.uint8), count=r["n"]).astype(bool)
            found.append(golomb_decode(r["code"], r["n"])[again] + r["owner"] * span)
            expected = r["n_rows"]
        suspects = np.sort(np.concatenate(found))
        for b in slices(batches):
            mine = np.isin(_fingerprints(b.column("h").to_numpy(), bits), suspects)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("h"), b.column("text_sha256"), b.column("row_key"),
                pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(rows, rows + b.num_rows)),
                b.column("text").take(pa.array(np.arange(b.num_rows), mask=~mine))],
                names=["doc_id", "h", "text_sha256", "row_key", "part", "pos", "text"])
            rows += b.num_rows
        if expected not in (None, rows):
            raise RuntimeError("the table's partitions changed between two passes")

    return mark


def exact_dedup(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored):
    doc_id, keep_id, group_size, kept, text_sha256, row_key.

    Texts are equal when identical after each run of white space becomes one
    space; a null text counts as empty, and empty texts are equal. The row
    with the smallest doc_id of a group is kept; null doc_ids come last, and
    of rows that tie (one doc_id, equal texts) exactly one is kept. An empty
    table gives an empty result. ``docs`` must be a table read from files, so
    that both passes see the same partitions (the second pass fails, rather
    than err, when they differ). ``bits`` are those of a fingerprint."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("raw"))
    rows = rows.withColumn("text", F.regexp_replace("raw", WHITE, " "))
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("text_sha256"),
                       F.xxhash64("raw").alias("row_key"), "text")

    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // PER_OWNER))
    sent = rows.select("h").mapInPandas(
        _send(owners, bits), "part int, n_rows long, owner int, n int, code binary, repeated binary")
    replies = sent.groupBy("owner").applyInPandas(_answer, sent.schema)

    answers = post(replies, "exact-answers")
    marked = rows.mapInArrow(_mark(answers, owners, bits), _MARKED)
    seen = materialise(marked, "exact-marked")

    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "part", "pos")
    suspects = seen.filter(F.col("text").isNotNull())
    verified = (suspects.groupBy("h", "text_sha256", "text")  # byte for byte
                .agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size"))
                .drop("text"))
    copies = suspects.drop("text").join(verified, ["h", "text_sha256"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        ((F.col("part") == F.col("first.part")) & (F.col("pos") == F.col("first.pos"))).alias("kept"),
        "text_sha256", "row_key")
    single = seen.filter(F.col("text").isNull()).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256", "row_key")
    return copies.unionByName(single)


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the copies: one row of each group of equal texts, that
    of the smallest doc_id (null doc_ids last; of rows that repeat doc_id and
    text, any one). Null and empty texts are equal. ``docs`` may have any other
    columns; they come back as they are."""
    return keep_decided(docs, exact_dedup(docs).withColumn("once", F.lit(True)))
