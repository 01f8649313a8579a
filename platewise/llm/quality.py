"""Quality by compression: a zstandard dictionary is built from good text and
one from bad text, and a document is compressed with either, in blocks of one
size that each start afresh from the dictionary, so that every part of a long
text has the same say. How many bytes per byte of text the bad dictionary
costs more is calibrated to the probability of label 1."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import materialise, row_key, slices, text_or_empty
from platewise.llm.labelled import calibrate, labelled_sample, sigmoid

#: The bounded training sample: documents of either class. Half of them make
#: the dictionaries, the other half, compressed whole, the calibration. Bytes
#: that a text gives to its dictionary (from its whole length, in pieces).
TRAIN_DOCS, TRAIN_BYTES, PIECE = 1500, 8192, 1024
#: Bytes compressed at a time; a text's own history is forgotten between.
BLOCK = 4096
DICTIONARY_BYTES, LEVEL = 112_640, 3
THRESHOLD = 0.7


@dataclass(frozen=True)
class Judge:
    """Two dictionaries and the calibration of the difference they make."""

    good: bytes = b""
    bad: bytes = b""
    slope: float = 0.0
    shift: float = 0.0

    def differences(self, texts: list[str]) -> np.ndarray:
        """(sizes of all blocks with the bad dictionary - those with the good
        one) / bytes of the whole text, 0 for an empty text."""
        if not (self.good and self.bad):
            return np.zeros(len(texts))
        good, bad = (zstandard.ZstdCompressor(LEVEL, dict_data=_dictionary(d)) for d in (self.good, self.bad))
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            raw = memoryview(t.encode("utf-8", "surrogatepass"))
            more = 0
            for s in range(0, len(raw), BLOCK):
                more += len(bad.compress(raw[s:s + BLOCK])) - len(good.compress(raw[s:s + BLOCK]))
            out[i] = more / max(1, len(raw))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.slope * self.differences(texts) + self.shift)


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    d = zstandard.ZstdCompressionDict(raw)  # trained or, without its magic number, plain content
    d.precompute_compress(level=LEVEL)
    return d


def build_dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; of too few texts to train on, their content."""
    pieces = [p for t in texts for p in _pieces(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[-DICTIONARY_BYTES:]


def _pieces(text: str) -> list[bytes]:
    """``TRAIN_BYTES`` of a text at most, in pieces spread over all of it."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= TRAIN_BYTES:
        return [raw] if raw else []
    return [raw[s:s + PIECE] for s in np.linspace(0, len(raw) - PIECE, TRAIN_BYTES // PIECE).astype(int)]


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each text in place of the text: what reaches the driver
    is bounded, however long texts are."""
    for b in batches:
        pieces = [[p.decode("utf-8", "ignore") for p in _pieces(t)] for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("y"), pa.array(pieces, pa.list_(pa.string()))], ["doc_id", "y", "pieces"])


def _measured(judge: Judge, ids: set[int]):
    """The differences of the whole texts of the named documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array([i in ids for i in b.column("doc_id").to_pylist()], pa.bool_()))
            for part in slices([b]):
                z = judge.differences(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(z)], ["doc_id", "y", "z"])

    return run


def train(docs: DataFrame, labels: DataFrame, held_out_mod: int = 4, held_out: int = 2) -> Judge:
    """Dictionaries and calibration from at most ``TRAIN_DOCS`` documents of
    either class. Rows with crc32(doc_id) mod ``held_out_mod`` = ``held_out``
    are never learned from. Without both classes every document gets the
    share of label 1 (0.5 without any label). The calibration is on the
    differences of whole texts, which the tasks compute."""
    texts, share = labelled_sample(docs, labels, "quality", held_out_mod, held_out, TRAIN_DOCS)
    texts = materialise(texts, "quality-sample")
    rows = sorted((r["doc_id"], r["y"], r["pieces"]) for r in texts.mapInArrow(
        _shortened, "doc_id long, y int, pieces array<string>").collect())
    second = set(sorted({i for i, _, _ in rows})[1::2])
    by = [["".join(p) for i, y, p in rows if y == c and i not in second] for c in (0, 1)]
    if not (any(by[0]) and any(by[1]) and second):
        return Judge(shift=calibrate(np.zeros((1, 1)), np.zeros(1), share)[1])
    judge = Judge(build_dictionary(by[1]), build_dictionary(by[0]))
    found = sorted((r["doc_id"], r["z"], r["y"]) for r in texts.mapInArrow(
        _measured(judge, second), "doc_id long, y int, z double").collect())
    (slope,), shift = calibrate(np.array([[z] for _, z, _ in found]), np.array([y for _, _, y in found], float), share)
    return Judge(judge.good, judge.bad, slope, shift)


def score_documents(docs: DataFrame, judge: Judge) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored):
    doc_id, score, predicted, row_key. Whole texts are compressed, block by
    block. A null or empty text has difference 0 and the score that goes with
    it."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = judge.scores(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), b.column("row_key")],
                ["doc_id", "score", "predicted", "row_key"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"),
                       text_or_empty().alias("text"))
    return rows.mapInArrow(score, "doc_id long, score double, predicted int, row_key long")
