"""What the two classifiers share: the bounded sample of labelled documents
they learn from, and the calibration of their scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import row_key, text_or_empty


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int,
                    most: int) -> tuple[DataFrame, float]:
    """(doc_id, y, text) of at most ``most`` documents of either class, drawn
    by a hash of the doc_id, and the share of label 1 among all labelled rows
    that may be learned from (0.5 without any). Rows with crc32(doc_id) mod
    ``mod`` = ``held_out`` are never learned from. Null labels and ids are
    left out; of several labels of a document the highest counts, and of
    several texts the one with the smallest hash."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.filter("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(mod)) != held_out)
    share = known.agg(F.avg("y")).first()[0]
    drawn = [known.filter(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c in (0, 1)]
    ids = drawn[0].unionByName(drawn[1])  # at most 2 * most rows, so it can be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    texts = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(
        F.min_by("text", F.struct(row_key(), F.col("text"))).alias("text"))
    return texts, 0.5 if share is None else float(share)


def calibrate(x: np.ndarray, y: np.ndarray, share: float, damping: Sequence[float] = (1e-3,)) -> tuple[list[float], float]:
    """(slopes, shift) of the log-odds of label 1 given the columns of ``x``:
    logistic regression by damped Newton steps. The sample is weighted so that
    label 1 has its ``share`` of all labelled rows. ``damping`` draws each
    column's slope (per standard deviation) to 0, as so many rows would. With
    one class the shift alone gives that share."""
    if len(np.unique(y)) < 2:
        share = min(max(share, 0.01), 0.99)
        return [0.0] * x.shape[1], float(np.log(share / (1 - share)))
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    middle, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    x = np.column_stack([(x - middle) / scale, np.ones(len(x))])
    a = np.array([1.0] + [0.0] * (x.shape[1] - 1))
    damp = np.array([*damping, 0.0])  # not of the shift
    for _ in range(200):
        p = sigmoid(x @ a)
        r, q = weight * (p - y), weight * p * (1 - p) + 1e-9
        a = a - 0.5 * np.linalg.solve((x * q[:, None]).T @ x + np.diag(np.maximum(damp, 1e-3)), x.T @ r + damp * a)
    slopes = a[:-1] / scale
    return slopes.tolist(), float(a[-1] - slopes @ middle)
