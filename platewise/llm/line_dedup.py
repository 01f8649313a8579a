"""Line dedup with two Bloom filters, for lines seen once and seen twice.

Partitions send the hashes of their lines to the owners of the hashes'
segments. An owner puts a hash that its first filter lacks into the first, one
that it has into the second; all that it then finds in the second it answers
as suspected. With the answers a second pass picks out the suspected lines:
only they shuffle, to be compared letter by letter and to find the document
that keeps them. A last pass drops the others' lines. Texts never shuffle, and
a filter has a fixed number of bits for each line of its segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import materialise, sized_join, slices, text_or_empty
from platewise.llm.mail import collected, post

#: Code points of a line that counts, and documents that make it repeated.
LEAST_CHARS, LEAST_DOCUMENTS = 20, 3
#: Lines of a segment, at most about; bits of a filter for each, and probes.
#: Of the lines seen once some 0.3 % are suspected by chance.
SEGMENT_LINES, BITS_PER_LINE, PROBES = 1 << 19, 16, 4
#: Hashes that a task holds before it sends them.
HELD = 1 << 20
_WHITE = b" \t\n\x0b\x0c\r"

_MESSAGES = "part int, rows bigint, segment int, hashes binary, twice binary"
_ANSWERS = "part int, rows bigint, hashes binary"
_SUSPECTS = "part int, pos bigint, lines bigint, doc_id bigint, key string, at array<int>"
_CLEANED = "doc_id bigint, text string, n_lines bigint, n_dropped bigint"


def _keys(text: bytes, least: int) -> dict[bytes, list[int]]:
    """The numbers of the lines with each key that is long enough."""
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate(text.split(b"\n")):
        if len(line) >= least:
            key = line.strip(_WHITE).lower()  # bytes: only A-Z are lowered
            if len(key) >= least and (key.isascii() or len(key.decode()) >= least):
                found.setdefault(key, []).append(i)
    return found


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for b in slices(batches):
        yield b, b.column("text").cast(pa.binary()).to_pylist()


def _send(segments: int, least: int):
    """A partition's messages: its distinct hashes by segment, and a bit for
    each that says whether two of its documents hold it."""

    def messages(part: int, rows: int, held: list[int]) -> Iterator[pa.RecordBatch]:
        hashes, times = np.unique(np.array(held, np.uint64), return_counts=True)
        of = segment_of(hashes, segments)
        cuts = np.flatnonzero(np.diff(of)) + 1
        if len(hashes):
            pieces = list(zip(of[np.concatenate([[0], cuts])], np.split(hashes, cuts), np.split(times > 1, cuts)))
            yield pa.RecordBatch.from_arrays([
                pa.array([part] * len(pieces), pa.int32()), pa.array([rows] * len(pieces), pa.int64()),
                pa.array([s for s, _, _ in pieces], pa.int32()), pa.array([h.tobytes() for _, h, _ in pieces], pa.binary()),
                pa.array([np.packbits(t).tobytes() for _, _, t in pieces], pa.binary())],
                names=["part", "rows", "segment", "hashes", "twice"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, held = TaskContext.get().partitionId(), 0, []
        for b, texts in _texts(batches):
            rows += b.num_rows
            for text in texts:
                held += [xxhash.xxh3_64_intdigest(k) for k in _keys(text, least)]
            if len(held) > HELD:
                yield from messages(part, -1, held)  # the last message has the partition's rows
                held = []
        yield from messages(part, rows, held)

    return send


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    """The segment of each hash, ascending with it."""
    return (((hashes >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)).astype(np.int64)


class Filter:
    """A Bloom filter of a power of two of bits over 64-bit hashes."""

    def __init__(self, bits: int):
        self.mask, self.bits = np.uint64(bits - 1), np.zeros(bits, bool)

    def probes(self, hashes: np.ndarray) -> np.ndarray:
        mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        start, step = mixed >> np.uint64(32), (mixed & np.uint64(0xFFFFFFFF)) | np.uint64(1)
        return (start[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & self.mask

    def has(self, hashes: np.ndarray) -> np.ndarray:
        return self.bits[self.probes(hashes)].all(axis=1)

    def put(self, hashes: np.ndarray) -> None:
        self.bits[self.probes(hashes).ravel()] = True


def _answer(bits: int):
    """The owner of a segment: which hashes of each message it suspects."""

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        once, twice = Filter(bits), Filter(bits)
        lists = [np.frombuffer(h, np.uint64) for h in group["hashes"]]
        for hashes, again in zip(lists, group["twice"]):
            again = np.unpackbits(np.frombuffer(again, np.uint8), count=len(hashes)).astype(bool)
            twice.put(hashes[again | once.has(hashes)])
            once.put(hashes)
        found = [h[twice.has(h)].tobytes() for h in lists]
        out = group[["part", "rows"]].assign(hashes=found)
        return out[out["hashes"].str.len() > 0]

    return answer


def _suspected(folder: str, least: int):
    """Documents' suspected lines: a row per document and key."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = TaskContext.get().partitionId(), 0
        mail = collected(folder, part, ["rows", "hashes"])
        suspects = set()
        for h in mail.column("hashes").to_pylist() if mail else ():
            suspects.update(np.frombuffer(h, np.uint64).tolist())
        for b, texts in _texts(batches):
            found = []
            for k, (doc_id, text) in enumerate(zip(b.column("doc_id").to_pylist(), texts)):
                of = {key: at for key, at in _keys(text, least).items() if xxhash.xxh3_64_intdigest(key) in suspects}
                if of:
                    lines = text.count(b"\n") + 1
                    found += [(part, rows + k, lines, doc_id, key, at) for key, at in of.items()]
            rows += b.num_rows
            if found:
                part_, pos, lines, ids, keys, at = map(list, zip(*found))
                yield pa.RecordBatch.from_arrays([
                    pa.array(part_, pa.int32()), pa.array(pos, pa.int64()), pa.array(lines, pa.int64()),
                    pa.array(ids, pa.int64()), pa.array(keys, pa.binary()).cast(pa.string()), pa.array(at, pa.list_(pa.int32()))],
                    names=["part", "pos", "lines", "doc_id", "key", "at"])
        if mail and max(mail.column("rows").to_pylist()) not in (-1, rows):
            raise RuntimeError("the table's partitions changed between two passes")

    return pick


def _drop(folder: str):
    """Documents without the lines that the partition's mail names."""

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mail = collected(folder, TaskContext.get().partitionId(), ["pos", "lines", "at"])
        gone: dict[int, tuple[int, set[int]]] = {}
        for pos, lines, at in zip(*(mail.column(c).to_pylist() for c in ("pos", "lines", "at"))) if mail else ():
            gone.setdefault(pos, (lines, set()))[1].update(at)
        rows = 0
        for b, texts in _texts(batches):
            kept, n_lines, n_dropped = [], [], []
            for pos, text in enumerate(texts, rows):
                lines, out = text.count(b"\n") + 1, gone.get(pos)
                if out:
                    if out[0] != lines:
                        raise RuntimeError("the table's partitions changed between two passes")
                    text = b"\n".join([x for i, x in enumerate(text.split(b"\n")) if i not in out[1]])
                kept.append(text)
                n_lines.append(lines)
                n_dropped.append(len(out[1]) if out else 0)
            rows += b.num_rows
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()),
                pa.array(n_dropped, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])

    return cleaned


def drop_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS,
                        least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored):
    doc_id, text (what is left of it), n_lines (before), n_dropped.

    Lines end at a line feed; a null or empty text is one empty line. Lines
    are the same when equal after white space at both ends is stripped and A-Z
    are lower-cased; shorter ones than ``least_chars`` code points always stay.
    Of lines found in at least ``least_documents`` (2 or more) rows, only the
    row with the largest doc_id keeps its own, all of them; null doc_ids are
    smaller than others, and rows that share the largest doc_id (or are all
    null) each keep theirs. A text that loses all lines becomes empty. An empty
    table gives an empty result. ``docs`` must be a table read from files, so
    that all passes see the same partitions (a pass fails, rather than err,
    when they differ)."""
    if least_documents < 2:
        raise ValueError("a repeated line is one of at least two documents")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    lines = rows.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    segments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines // SEGMENT_LINES))
    bits = 1 << max(10, (BITS_PER_LINE * -(-lines // segments) - 1).bit_length())

    sent = rows.select("text").mapInArrow(_send(segments, least_chars), _MESSAGES)
    answers = post(sent.groupBy("segment").applyInPandas(_answer(bits), _ANSWERS), "line-answers")
    suspects = rows.mapInArrow(_suspected(answers, least_chars), _SUSPECTS)
    suspects = materialise(suspects.withColumn("digest", F.sha2("key", 256)), "line-suspects")
    repeated = (suspects.groupBy("digest", "key")  # letter by letter
                .agg(F.count(F.lit(1)).alias("documents"), F.max("doc_id").alias("last"))
                .filter(F.col("documents") >= least_documents).select("digest", "last"))
    dropped = sized_join(suspects.drop("key"), materialise(repeated, "line-repeated"), ["digest"], "inner")
    dropped = post(dropped.filter(~F.col("doc_id").eqNullSafe(F.col("last"))).select("part", "pos", "lines", "at"),
                   "line-dropped")
    return rows.mapInArrow(_drop(dropped), _CLEANED)
